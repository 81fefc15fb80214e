"""Samples, pictures and heat maps of training batches against plain NumPy; the edit journal against tables kept aside."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import edits, journal, resample, training as T

IMAGES = "movie string, frame int, height int, width int, channels int, pix array<double>"


def test_exact_samples_do_not_depend_on_partitions(spark):
    index = spark.createDataFrame([(f"m{i % 7}", i, float(i)) for i in range(3000)], "movie string, frame int, x double")
    picked = {}
    for n in (0, 1, 20, 500, 2999, 3000):
        for parts in (1, 5, 40):
            rows = T.exact_sample(index.repartition(parts), n, 3).collect()
            assert sorted(r.draw for r in rows) == list(range(1, n + 1)) and len({(r.movie, r.frame) for r in rows}) == n
            found = {(r.draw, r.movie, r.frame, r.x) for r in rows}
            assert picked.setdefault(n, found) == found
    assert picked[20] <= picked[500] <= picked[3000]  # smaller samples begin larger ones
    assert {r[1:] for r in picked[500]} != {(r.movie, r.frame, r.x) for r in T.exact_sample(index, 500, 4).collect()}
    many = T.exact_sample(index.limit(30), 100, 3).collect()
    assert sorted(r.draw for r in many) == list(range(1, 101)) and len({r.frame for r in many[:]}) == 30
    assert T.exact_sample(index.where("false"), 5, 3).count() == 0
    shares = [sum(r[2] < 1500 for r in picked[500]) / 500]
    assert 0.4 < shares[0] < 0.6


def test_labelled_frames(spark):
    obs = spark.createDataFrame([("a", 1, 1, 5.0, 6.0), ("a", 1, 3, 7.0, 8.0), ("a", 2, 3, None, 1.0), ("b", 1, 2, 1.0, 2.0)], "movie string, frame int, point int, u double, v double")
    found = {(r.movie, r.frame): r.uv for r in T.labelled(obs).collect()}
    assert found.keys() == {("a", 1), ("b", 1)}
    np.testing.assert_equal(found["a", 1], [5.0, 6.0, np.nan, np.nan, 7.0, 8.0])
    assert {(r.movie, r.frame) for r in T.labelled(obs, [3]).collect()} == {("a", 1)}


def plain_heat(u, v, h, w):
    image = np.zeros((h, w))
    if not np.isfinite(u + v):
        return image
    for r in range(int(v) - 2, int(v) + 3):
        for c in range(int(u) - 2, int(u) + 3):
            if 1 <= r <= h and 1 <= c <= w:
                image[r - 1, c - 1] = 1
    if not image.any():
        return image
    kernel = np.array([[np.exp(-(a * a + b * b) / 8) for a in range(-4, 5)] for b in range(-4, 5)])
    wide, out = np.pad(image, 4, mode="edge"), np.zeros((h, w))
    for r in range(h):
        for c in range(w):
            out[r, c] = (wide[r : r + 9, c : c + 9] * kernel).sum() / kernel.sum()
    return out / out.max()


def test_heat_maps():
    points = np.array([[10.0, 12.0], [1.0, 20.0], [np.nan, 3.0], [40.0, 2.0], [19.0, -1.0]])
    maps = T.heat(points, 24, 20)
    for k, (u, v) in enumerate(points):
        np.testing.assert_allclose(maps[:, :, k], plain_heat(u, v, 24, 20), atol=1e-12)
    assert maps[11, 9, 0] == 1 and maps[:, :, 2].max() == 0 and maps[:, :, 3].max() == 0


def rows_of(batch):
    return {(r.movie, r.frame, r.draw): (np.reshape(r.input, (r.height, r.width, r.channels)), np.reshape(r.response, (r.height, r.width, r.maps))) for r in batch.collect()}


def table(spark, images):
    return spark.createDataFrame([(m, f, *x.shape, x.ravel().tolist()) for (m, f), x in images.items()], IMAGES)


def sample(spark, rows):
    return spark.createDataFrame(rows, "movie string, frame int, draw int, uv array<double>")


def test_whole_pictures(spark):
    rng = np.random.default_rng(1)
    images = {("a", 1): rng.random((30, 40, 1)) * 255, ("a", 2): rng.random((25, 20, 3)) * 255}
    uv = {("a", 1): [10.0, 12.0, np.nan, np.nan], ("a", 2): [3.4, 20.0, 15.5, 6.0]}
    back = {"a": rng.random((30, 40, 1)) * 100}
    df = table(spark, images).unionByName(spark.createDataFrame([("a", 3, 2, 2, 1, None)], IMAGES))
    samples = sample(spark, [(*k, 1, v) for k, v in uv.items()] + [("a", 3, 1, [1.0, 1.0]), ("z", 1, 1, [1.0, 1.0])])
    found = rows_of(T.training_batch(samples, df, side=16, augment=False))
    assert found.keys() == {("a", 1, 1), ("a", 2, 1)}
    for k, image in images.items():
        made, response = found[*k, 1]
        expected = resample.resize(image / 255, 16, 16)
        np.testing.assert_allclose(made, np.repeat(expected, 3 // image.shape[2], axis=2), atol=1e-6)
        h, w, _ = image.shape
        maps = [plain_heat(np.floor(u * 16 / w + 0.5), np.floor(v * 16 / h + 0.5), 16, 16) for u, v in np.reshape(uv[k], (-1, 2))]
        np.testing.assert_allclose(response, np.stack([*maps, sum(maps)], 2), atol=1e-6)
    one = rows_of(T.training_batch(samples.where("frame = 1"), df, side=16, augment=False, grouped=True, backgrounds=spark.createDataFrame([("a", back["a"].ravel().tolist())], "movie string, pix array<double>")))
    np.testing.assert_allclose(one["a", 1, 1][0][:, :, 0], resample.resize((images["a", 1] - back["a"]) / 255, 16, 16)[:, :, 0], atol=1e-6)
    assert one["a", 1, 1][1].shape == (16, 16, 2)


def spotted(h, w, u, v):
    yy, xx = np.mgrid[1 : h + 1, 1 : w + 1]
    return 255 * np.exp(-((xx - u) ** 2 + (yy - v) ** 2) / 8)[:, :, None]


@pytest.mark.parametrize("kind, side", [("whole", 48), ("crop", 32), ("resized", 32)])
def test_augmented_pictures_keep_points_where_their_maps_are(spark, kind, side):
    """After turning, moving and resizing, the bright spot of the input lies under the peak of the response."""
    images, rows, rng = {}, [], random.Random(2)
    for f in range(30):
        u, v = rng.uniform(25, 55), rng.uniform(25, 50)
        images["m", f] = spotted(78, 84, u, v)
        rows.append(("m", f, 1, [u, v]))
    samples, df = sample(spark, rows), table(spark, images)
    found = rows_of(T.training_batch(samples.repartition(3), df.repartition(5), kind, side=side, seed=5))
    again = rows_of(T.training_batch(samples.repartition(1), df.repartition(2), kind, side=side, seed=5))
    assert found.keys() == again.keys() and all((found[k][0] == again[k][0]).all() and (found[k][1] == again[k][1]).all() for k in found)
    assert len(found) > 15 and (kind != "whole" or len(found) == 30)
    near = 0
    for made, response in found.values():
        assert made.shape == (side, side, 3) and response.shape == (side, side, 2)
        if response.max() == 0:
            continue
        a, b = (np.array(np.unravel_index(np.argmax(x), x.shape)) for x in (made[:, :, 0], response[:, :, 0]))
        assert abs(a - b).max() <= 3
        near += 1
    assert near > 10


def plain_span(center, low, high, side):
    a, b = center + low, center + high
    if a < 1:
        a, b = 1, b - a + 1
    if b > side:
        a, b = a - (b - side), side
    return max(a, 1), b


def test_crops_without_augmentation(spark):
    rng = np.random.default_rng(3)
    image = rng.random((50, 60, 1)) * 255
    rows = [("a", 1, d, [u, v]) for d, (u, v) in enumerate([(30.0, 25.0), (2.0, 2.0), (59.0, 49.0), (30.4, 10.6), (np.nan, np.nan)], 1)]
    found = rows_of(T.training_batch(sample(spark, rows), table(spark, {("a", 1): image}), "crop", side=32, augment=False))
    assert sorted(k[2] for k in found) == [1, 2, 3, 4]
    for _, _, d, (u, v) in rows[:4]:
        (x0, x1), (y0, y1) = plain_span(int(np.floor(u + 0.5)), -16, 15, 60), plain_span(int(np.floor(v + 0.5)), -16, 15, 50)
        made, response = found["a", 1, d]
        np.testing.assert_allclose(made[:, :, 0], image[y0 - 1 : y1, x0 - 1 : x1, 0] / 255, atol=1e-6)
        a, b = np.floor(u - x0 + 0.5), np.floor(v - y0 + 0.5)
        np.testing.assert_allclose(response[:, :, 0], plain_heat(np.nan if not 3 <= a <= 29 else a, np.nan if not 3 <= b <= 29 else b, 32, 32), atol=1e-6)
    assert T.training_batch(sample(spark, rows[:1]), table(spark, {("a", 1): image[:20]}), "crop", side=32, augment=False).count() == 0


def test_resized_crops_reject_points_on_the_edge(spark):
    rng = np.random.default_rng(4)
    image, rows, expected = rng.random((200, 220, 3)) * 255, [], {}
    for d in range(1, 60):
        points = rng.uniform(1, 200, (2, 2))
        rows.append(("a", 1, d, points.ravel().tolist()))
        low, high = points.min(axis=0), points.max(axis=0)
        half = int(np.floor(max(*(high - low), 32) / 2 + 0.5))
        center = np.floor((low + high) / 2 + 0.5)
        a, b = -int(np.floor(1.5 * half + 0.5)), int(np.floor(1.5 * (half - 1) + 0.5))
        (x0, x1), (y0, y1) = plain_span(int(center[0]), a, b, 220), plain_span(int(center[1]), a, b, 200)
        at = np.floor(np.floor(points - [x0, y0] + 0.5) * 32 / np.array([x1 - x0 + 1, y1 - y0 + 1]) + 0.5)
        if not ((at > -5) & (at < 0) | (at > 27) & (at < 37)).any():
            expected[d] = (resample.resize(image[y0 - 1 : y1, x0 - 1 : x1] / 255, 32, 32), at)
    found = rows_of(T.training_batch(sample(spark, rows), table(spark, {("a", 1): image}), "resized", side=32, augment=False))
    assert {k[2] for k in found} == expected.keys() and 0 < len(expected) < 59
    for d, (made, at) in expected.items():
        np.testing.assert_allclose(found["a", 1, d][0], made, atol=1e-5)
        maps = [plain_heat(*(p if ((p > 2) & (p < 30)).all() else (np.nan, 0)), 32, 32) for p in at]
        np.testing.assert_allclose(found["a", 1, d][1], np.stack([*maps, sum(maps)], 2), atol=1e-6)


KEYS = ["trial", "frame", "point", "cam"]
OBS = "trial string, frame int, point int, cam int, u double, v double"


def test_journal_gives_the_table_as_of_every_version_and_takes_edits_back(spark):
    rng = random.Random(3)
    base = spark.createDataFrame([("t", f, p, c, rng.random() if rng.random() < 0.8 else None, rng.random()) for f in range(1, 30) for p in range(1, 6) for c in (1, 2) if rng.random() < 0.9], OBS)
    clicks = spark.createDataFrame([("t", 3, 1, 1, 9.0, 9.0), ("t", 4, 1, 1, None, 1.0), ("t", 99, 2, 1, 7.0, 7.0)], OBS)
    steps = [("nudge", lambda t: edits.nudge(t, F.col("point") == 2, "left")), ("set", lambda t: edits.set_points(t, clicks)), ("delete", lambda t: edits.delete_point(t, 3)), ("swap", lambda t: edits.swap_points(t, 1, 2, 5, 9)), ("nothing", lambda t: t), ("join", lambda t: edits.join_points(t, 1, 3)), ("split", lambda t: edits.split_point(t, 1, 2, 3, 8, 4))]
    kept, table_ = [base], base
    for _, step in steps:
        table_ = step(table_).select(base.columns)
        kept.append(table_)
    kept = [sorted(map(tuple, t.collect()), key=str) for t in kept]
    log = journal.edited(base, KEYS, steps)
    log = spark.createDataFrame(log.collect(), log.schema)  # as if written
    for version, rows in enumerate(kept):
        assert sorted(map(tuple, journal.as_of(base, log, KEYS, version).collect()), key=str) == rows
    # undo of the last edit, of the one before, and so on
    for k in range(len(steps), 0, -1):
        upto = log.where(F.col("version") <= k)
        back = upto.unionByName(journal.undo(upto, KEYS, k, k + 1))
        assert sorted(map(tuple, journal.as_of(base, back, KEYS).collect()), key=str) == kept[k - 1]
        again = back.unionByName(journal.undo(back, KEYS, k + 1, k + 2))  # undo of undo
        assert sorted(map(tuple, journal.as_of(base, again, KEYS).collect()), key=str) == kept[k]
        assert journal.conflicts(upto, KEYS, k).count() == 0
    later, rest = journal.folded(base, log, KEYS, 3)
    assert sorted(map(tuple, journal.as_of(later, rest, KEYS, 6).collect()), key=str) == kept[6]
    counts = {r.version: (r.added, r.changed, r.removed) for r in journal.history(log).collect()}
    assert 5 not in counts and counts[2][0] >= 1 and counts[1][0] == counts[1][2] == 0


def test_an_edit_below_later_ones_is_taken_back_where_they_left_it(spark):
    base = spark.createDataFrame([("t", f, 1, 1, float(f), 0.0) for f in range(1, 7)], OBS)
    steps = [("up", lambda t: edits.nudge(t, F.col("frame") <= 4, "right", 10.0)), ("more", lambda t: edits.nudge(t, F.col("frame") >= 4, "right", 100.0))]
    log = journal.edited(base, KEYS, steps)
    back = log.unionByName(journal.undo(log, KEYS, 1, 3))
    assert {r.frame: r.u for r in journal.as_of(base, back, KEYS).collect()} == {1: 1.0, 2: 2.0, 3: 3.0, 4: 114.0, 5: 105.0, 6: 106.0}
    assert [(r.frame, r.by) for r in journal.conflicts(log, KEYS, 1).collect()] == [(4, 2)]


def test_queries_of_the_journal_read_their_table_once(spark, monkeypatch):
    from trackloom.plans import track_queries

    noise = F.udf(lambda: random.random(), "double").asNondeterministic()  # as means of rows that arrive in another order
    base = spark.sql("SELECT 't' AS trial, frame, point, cam FROM (SELECT explode(sequence(1, 200)) AS frame), (SELECT explode(sequence(1, 5)) AS point), (SELECT explode(sequence(1, 2)) AS cam)").select("*", noise().alias("u"), noise().alias("v"))
    monkeypatch.setattr(track_queries.X, "observations", lambda *a: base)
    counts = {r.operation: (r.added, r.changed, r.removed) for r in track_queries.edit_history(spark, "").collect()}
    assert counts == {"nudge": (0, 200, 0), "swap": (0, 404, 0), "delete": (0, 800, 400)}
    rows = {(r.version, r.point, r.cam): (r.u, r.v) for r in track_queries.edit_versions(spark, "").collect()}
    assert rows[2, 2, 1] == rows[0, 2, 1] and rows[2, 5, 2] == rows[0, 5, 2] and rows[4, 3, 1] == rows[0, 3, 1]


def test_row_edits_are_followed_in_one_pass(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, 0.5, 1.0, rng.random()])
    base = spark.createDataFrame([("t", f, p, c, value(), value()) for f in range(1, 40) for p in range(1, 6) for c in (1, 2) if rng.random() < 0.8], OBS)
    steps = [("nudge", edits.nudged(F.col("u") > 0.4, "left")), ("swap", edits.swapped(1, 4, 5, 20)), ("delete", edits.deleted(3)), ("again", edits.swapped(1, 2)), ("back", edits.swapped(1, 2))]
    plain = [(name, lambda t, edit=edit: edit(t)) for name, edit in steps]  # by joins
    one, joined = journal.edited(base, KEYS, steps), journal.edited(base, KEYS, plain)
    assert one.dtypes == joined.dtypes and sorted(map(str, one.collect())) == sorted(map(str, joined.collect()))
    book = journal.versions(base, KEYS, steps)
    log = spark.createDataFrame(joined.collect(), joined.schema)
    for k in range(1, 6):
        back = log.unionByName(journal.undo(log, KEYS, k, 6))
        tables = [journal.as_of(base, back, KEYS, v).select(F.lit(v).alias("version"), *base.columns) for v in range(7)]
        expected = sorted(str(tuple(r)) for t in tables for r in t.collect())
        found = journal.every_version(journal.taken_back(book, ["u", "v"], k, 6), KEYS, ["u", "v"], 6)
        assert sorted(str(tuple(r)) for r in found.select("version", *base.columns).collect()) == expected


@pytest.mark.parametrize("name", ["edit_versions", "edit_history"])
def test_versions_shuffle_the_input_alone(spark, name):
    from trackloom.plans.queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2 and "Join" not in plan.replace("BroadcastNestedLoopJoin", "")  # the input by frame, and the few counts
