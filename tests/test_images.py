"""Blocks, resampling and multi-crop detection against plain NumPy over whole images."""

import random

import numpy as np
import pytest

from trackloom.operators import blocks, detect, resample


def table(spark, images, keys):
    """Images by their keys (a tuple each) as a DataFrame of whole images."""
    rows = [(*k, x.shape[0], x.shape[1], x.shape[2], x.astype(float).ravel().tolist()) for k, x in images.items()]
    return spark.createDataFrame(rows, ", ".join(f"{k} int" for k in keys) + ", height int, width int, channels int, pix array<double>")


def whole(rows, keys):
    """Tiles put together again."""
    out = {}
    for r in rows:
        k = tuple(r[x] for x in keys)
        image = out.setdefault(k, np.full((r.height, r.width, r.channels), np.nan))
        image[r.row0 : r.row0 + r.h, r.col0 : r.col0 + r.w] = np.reshape(r.pix, (r.h, r.w, r.channels))
    return out


def local(block):
    """Looks two pixels around: a weighted sum and a maximum."""
    wide = np.pad(block, ((2, 2), (2, 2), (0, 0)))
    n, m = block.shape[:2]
    parts = [wide[i : i + n, j : j + m] for i in range(5) for j in range(5)]
    return np.concatenate([sum((k + 1) * p for k, p in enumerate(parts)), np.maximum.reduce(parts)], axis=2)


@pytest.mark.parametrize("size", [1, 3, 7, 20, 64])
def test_block_functions_do_not_depend_on_the_tiles(spark, size):
    rng = np.random.default_rng(1)
    images = {(0,): rng.normal(size=(17, 23, 2)), (1,): rng.normal(size=(1, 5, 2)), (2,): rng.normal(size=(20, 20, 2))}
    tiles = blocks.cut(table(spark, images, ["image"]).repartition(3), 6)
    found = whole(blocks.apply_blocks(tiles, size, local, border=2).collect(), ["image"])
    assert found.keys() == images.keys()
    for k, x in images.items():
        np.testing.assert_allclose(found[k], local(x), atol=1e-12)


def test_partial_blocks_are_filled_with_zeros_and_cut_again(spark):
    rng = np.random.default_rng(2)
    image, seen = rng.normal(size=(10, 7, 1)), (4 + 2 * 1, 4 + 2 * 1, 1)

    def mean(block):
        assert block.shape == seen
        return np.full(block.shape[:2], block.sum())

    found = whole(blocks.apply_blocks(blocks.cut(table(spark, {(0,): image}, ["image"]), 3), 4, mean, border=1).collect(), ["image"])[0,]
    wide = np.pad(image, ((1, 8), (1, 8), (0, 0)))
    for r in range(0, 10, 4):
        for c in range(0, 7, 4):
            assert np.allclose(found[r : r + 4, c : c + 4], wide[r : r + 6, c : c + 6].sum())


def test_network_blocks(spark):
    image = np.random.default_rng(3).random((12, 12, 3))
    function = blocks.network_block(lambda x: x * 2, side=6)
    found = whole(blocks.apply_blocks(blocks.cut(table(spark, {(0,): image}, ["image"]), 5), 6, function).collect(), ["image"])[0,]
    np.testing.assert_allclose(found, 2 * image, atol=1e-12)  # blocks of the network's own side


@pytest.mark.parametrize("block, stride, size", [(1, 1, 4), (2, 1, 3), (5, 2, 4), (6, 4, 50), (9, 3, 2)])
def test_checked_blocks(spark, block, stride, size):
    rng = np.random.default_rng(4)
    images = {(0,): rng.normal(size=(14, 11, 2)), (1,): rng.normal(size=(4, 30, 2))}
    found = {(r.image, r.row, r.col, r.channel): r.value for r in blocks.check_blocks(blocks.cut(table(spark, images, ["image"]), 5), size, block, stride, lambda b: b.std(axis=(0, 1))).collect()}
    steps, expected = blocks.around(block), {}
    for (i,), x in images.items():
        for r in range(1 - steps[0], x.shape[0] - steps[-1] + 1, stride):
            for c in range(1 - steps[0], x.shape[1] - steps[-1] + 1, stride):
                for k, v in enumerate(x[np.ix_(r - 1 + steps, c - 1 + steps)].std(axis=(0, 1))):
                    expected[i, r, c, k] = v
    assert found.keys() == expected.keys()
    assert all(abs(found[k] - expected[k]) < 1e-12 for k in expected)


def test_blocks_of_an_even_side_have_no_center():
    assert blocks.around(224).tolist() == [*range(-112, 0), *range(1, 113)]
    assert blocks.around(5).tolist() == [-2, -1, 0, 1, 2]


def test_summed_areas_count_blocks():
    rng = np.random.default_rng(5)
    marked = rng.random((9, 13, 2)) > 0.6
    for block in (1, 2, 4, 5, 8):
        steps = blocks.around(block)
        rows, cols = np.array(blocks.centers(9, block, 1)), np.array(blocks.centers(13, block, 1))
        total = 0
        for r in range(0, 9, 4):  # the parts of tiles add up
            for c in range(0, 13, 4):
                total = total + detect.window_counts(marked[r : r + 4, c : c + 4], r, c, rows, cols, block)
        for a, r in enumerate(rows):
            for b, c in enumerate(cols):
                assert (total[a, b] == marked[np.ix_(r - 1 + steps, c - 1 + steps)].sum(axis=(0, 1))).all()


def region(scales, least, block, stride):
    """The crop by the rules, over whole maps: best scale, hits, center and rectangle from 1."""
    gated = []
    for heat in scales:
        h, w, _ = heat.shape
        d = int(0.02 * max(h, w) + 0.5)
        clear = heat.copy()
        clear[:d], clear[h - d - 1 :], clear[:, :d], clear[:, w - d - 1 :] = 0, 0, 0, 0
        gated.append(clear * (clear[:, :, -1:] > least))
    peaks = np.array([g.max(axis=(0, 1)) for g in gated])
    best = int(np.argmax(np.round(peaks[:, :-1].sum(axis=1), 9)))
    mosaic = sum(gated[int(np.argmax(peaks[:, k]))][:, :, k] for k in range(peaks.shape[1]))
    hits = int((mosaic > least).sum())
    if hits < 2:
        return best, hits, None
    steps, found = blocks.around(block), []
    h, w, _ = gated[best].shape
    for r in range(1 - steps[0], h - steps[-1] + 1, stride):
        for c in range(1 - steps[0], w - steps[-1] + 1, stride):
            box = gated[best][np.ix_(r - 1 + steps, c - 1 + steps)][:, :, :-1]
            found.append((int(((box > least).sum(axis=(0, 1)) > 0).sum()), r, c))
    top = [(r, c) for n, r, c in found if n == max(f[0] for f in found)] if found else [((h + 1) / 2, (w + 1) / 2)]
    center = [int(np.floor(np.mean([t[i] for t in top]) + 0.5)) for i in (0, 1)]
    spans = []
    for x, side in zip(center, (h, w)):
        a, b = x - int(np.floor(0.75 * block + 0.5)), x + int(np.floor(1.5 * (block / 2 - 1) + 0.5))
        if a < 1:
            a, b = 1, b - a + 1
        if b > side:
            a, b = a - b + side, side
        spans.append((max(1, a), b))
    return best, hits, (*center, *spans[1], *spans[0])


def pyramids(n=14):
    rng, out = np.random.default_rng(6), {}
    for frame in range(n):
        h, w = int(rng.integers(12, 40)), int(rng.integers(12, 40))
        for scale in range(3):
            heat = rng.random((h, w, 4)) * (rng.random((h, w, 1)) < (0.0, 0.002, 0.03, 0.3)[frame % 4])
            heat[:, :, -1] += 0.5 * (rng.random((h, w)) < (0.0, 0.5, 0.5, 0.5)[frame % 4])
            out[frame, scale] = heat
    return out


@pytest.mark.parametrize("block, size", [(8, 64), (8, 5), (11, 7)])
def test_multi_crop_regions(spark, block, size):
    heat = pyramids()
    found = {r.frame: r for r in detect.regions(blocks.cut(table(spark, heat, ["frame", "scale"]), size), 0.4, block).collect()}
    kinds = set()
    for frame in {k[0] for k in heat}:
        best, hits, place = region([heat[frame, s] for s in range(3)], 0.4, block, max(1, int(block / 4 + 0.5)))
        r = found[frame]
        assert (r.best, r.hits) == (best, hits)
        assert (r.row, r.col, r.x0, r.x1, r.y0, r.y1) == (place or (None,) * 6)
        kinds.add(place is None)
    assert kinds == {True, False}


def test_detections_look_again_at_the_crop(spark):
    heat = pyramids()
    rng = np.random.default_rng(7)
    images = {(f,): rng.random((*heat[f, 0].shape[:2], 3)) for f, s in heat if s == 0}
    crops = detect.regions(blocks.cut(table(spark, heat, ["frame", "scale"]), 9), 0.4, 8)
    network = lambda crop: np.concatenate([crop[:, :, :2] ** 2, crop[:, :, :1] * 0], axis=2)
    found = {(r.frame, r.channel): (r.u, r.v, r.quality) for r in detect.detections(blocks.cut(table(spark, images, ["frame"]), 6), crops, network, 3, 0.1, side=16).collect()}
    assert len(found) == 3 * len(images)
    for (f,), image in images.items():
        _, _, place = region([heat[f, s] for s in range(3)], 0.4, 8, 2)
        for k in range(3):
            expected = (0.0, 0.0, 0.0)
            if place and k < 2:
                x0, x1, y0, y1 = place[2:]
                crop = image[y0 - 1 : y1, x0 - 1 : x1]
                plane = network(resample.resize(crop, 16, 16))[:, :, k]
                col, row = divmod(int(np.argmax(plane.T)), 16)
                expected = ((col + 1) * crop.shape[1] / 16 + x0, (row + 1) * crop.shape[0] / 16 + y0, plane.max())
            assert found[f, k] == pytest.approx(expected)


def test_resize():
    rng = np.random.default_rng(8)
    image = rng.random((9, 14, 2))
    np.testing.assert_allclose(resample.resize(image, 9, 14), image, atol=1e-12)
    np.testing.assert_allclose(resample.resize(np.full((7, 5), 3.0), 20, 2), 3.0)
    ramp = np.arange(40.0)[:, None] * np.ones((1, 3))
    doubled = resample.resize(ramp, 80, 3)
    np.testing.assert_allclose(doubled[8:-8, 0], (np.arange(80)[8:-8] + 0.5) / 2 - 0.5, atol=1e-9)  # cubics reproduce lines
    np.testing.assert_allclose(resample.resize(ramp, 20, 3)[4:-4, 0], np.arange(20)[4:-4] * 2 + 0.5, atol=1e-9)
    # half the size by the kernel at twice its width: the weights by hand
    x = np.array([-3.5, -2.5, -1.5, -0.5, 0.5, 1.5, 2.5, 3.5]) / 2
    hand = resample.cubic(x) / resample.cubic(x).sum()
    one = rng.random(32)
    np.testing.assert_allclose(resample.resize(one[:, None], 16, 1)[8, 0], hand @ one[13:21], atol=1e-12)


def test_rotate():
    image = np.random.default_rng(9).random((8, 13, 1))
    np.testing.assert_allclose(resample.rotate(image, 0), image, atol=1e-12)
    np.testing.assert_allclose(resample.rotate(image, 90)[:, :, 0], np.rot90(image[:, :, 0]), atol=1e-9)
    np.testing.assert_allclose(resample.rotate(image, 180)[:, :, 0], image[::-1, ::-1, 0], atol=1e-9)
    yy, xx = np.mgrid[:41, :61]
    spot = np.exp(-((xx - 45) ** 2 + (yy - 12) ** 2) / 18.0)
    for angle in random.Random(1).sample(range(-100, 100), 5):
        turned = resample.rotate(spot, angle)
        c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
        u, v = 45 - 30, 12 - 20
        row, col = np.unravel_index(np.argmax(turned), turned.shape)
        assert abs(col - ((turned.shape[1] - 1) / 2 + c * u + s * v)) < 1 and abs(row - ((turned.shape[0] - 1) / 2 - s * u + c * v)) < 1
        assert abs(turned.sum() - spot.sum()) < 0.01 * spot.sum()


def test_empty_images(spark):
    empty = spark.createDataFrame([(1, 0, 0, 1, []), (2, 3, 3, 1, None)], "image int, height int, width int, channels int, pix array<double>")
    assert blocks.apply_blocks(blocks.cut(empty, 4), 4, lambda b: b).count() == 0


def test_a_task_holds_a_handful_of_tiles(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from trackloom.operators import blocks, detect

    calls, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **k: calls.append((self, f)) or plain(self, f, *a, **k))
    heat = spark.range(700).selectExpr("id AS frame", "0 AS scale", *[f"{n} AS {c}" for c, n in zip(blocks.PLACE, (0, 0, 8, 8, 8, 8, 2))], "transform(sequence(1, 128), x -> (x + id) % 7 / 7.0D) AS pix")
    detect.regions(heat, 0.5, 4)
    for given, f in calls[:1]:  # the gate
        batch = given.toArrow().combine_chunks().to_batches()[0]
        made = list(f(iter([batch])))
        assert sum(b.num_rows for b in made) == batch.num_rows == 700 and max(b.num_rows for b in made) <= 256
    big = batch.select(["pix"])
    assert [b.num_rows for b in blocks.handfuls(iter([big]), 256, 1)] == [1] * 700  # large tiles: one by one
