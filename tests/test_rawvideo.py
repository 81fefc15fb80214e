"""Raw recordings of every kind and depth, written byte by byte and read by ranges of frames."""

import struct

import numpy as np
import pytest

from trackloom.sources import rawvideo, video


@pytest.fixture(scope="module")
def reader(spark):
    rawvideo.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda path, **o: spark.read.format("rawvideo").options(**o).load(str(path))
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def cine(path, frames, w, h, bits, pad=1640, n=None, first=-3):
    words = [0] * 410
    for name, value in {"first_frame": first, "n_frames": n or len(frames), "header_pad": pad, "width": w, "height": h, "bytes": w * h * bits // 8, "frame_rate": 500, "exposure": 7, "camera": 8, "software": 9}.items():
        words[video.CINE_WORDS[name] - 1] = value
    with open(path, "wb") as f:
        f.write(struct.pack("<410i", *words).ljust(pad, b"\1"))
        f.write(b"\2" * 8 * (n or len(frames)))
        for x in frames:
            f.write(b"\3" * 8 + x)


def mrf(path, frames, w, h, bits, pad=300):
    head = b"REDLAKE1" + struct.pack("<iiiiiiiiihhi", 0, pad - 12, len(frames), w, h, bits, 1, 0, 0, 0, 0, 250)
    path.write_bytes(head.ljust(pad, b"\1") + b"".join(frames))


def pack10(values):
    bits = "".join(f"{x:010b}" for x in values)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def images(w, h, bits, n=5, seed=1):
    rng = np.random.default_rng(seed)
    top = 1 << min(bits, 16)
    return [rng.integers(0, 256, (h, w, 3)) if bits == 24 else rng.integers(0, top, (h, w)) for _ in range(n)]


def stored(image, bits):
    return image.astype(np.uint8).tobytes() if bits in (8, 24) else pack10(image.ravel()) if bits == 10 else image.astype("<u2").tobytes()


def pixels(rows):
    return {r.frame: np.reshape(r.pix, (r.height, r.width) if r.channels == 1 else (r.height, r.width, r.channels)) for r in rows}


@pytest.mark.parametrize("bits", [8, 10, 16, 24])
def test_cine(reader, tmp_path, bits):
    shown = images(8, 3, bits)
    # the format stores rows from below, except packed ones
    cine(tmp_path / "a.CINE", [stored(x if bits == 10 else x[::-1], bits) for x in shown], 8, 3, bits)
    found = pixels(reader(tmp_path, framesPerPartition=2).collect())
    assert found.keys() == set(range(1, 6))
    for i, x in enumerate(shown, 1):
        np.testing.assert_allclose(found[i], x / 255 if bits == 24 else x)
    head = reader(tmp_path, mode="headers").first()
    assert (head.kind, head.width, head.height, head.n_frames, head.first_frame, head.bit_depth, head.frame_rate, head.exposure, head.camera, head.software, head.header_pad, head.variable_timing) == ("cine", 8, 3, 5, -3, bits, 500.0, 7, 8, 9, 1640, False)
    assert head.compression == f"{bits}-bit raw"


@pytest.mark.parametrize("bits", [8, 12, 16, 24])
def test_mrf(reader, tmp_path, bits):
    shown = images(4, 3, bits)
    mrf(tmp_path / "a.mrf", [stored(x, 16 if 8 < bits < 24 else bits) for x in shown], 4, 3, bits)
    found = pixels(reader(tmp_path / "a.mrf").collect())
    for i, x in enumerate(shown, 1):
        np.testing.assert_allclose(found[i], x / 255 if bits == 24 else x)
    assert rawvideo.header_at(str(tmp_path / "a.mrf"))["header_pad"] == 300


@pytest.mark.parametrize("bits, recorded, side, shift", [(8, 8, "Lower", 0), (16, 12, "Lower", 4), (16, 12, "Higher", 0), (16, 16, "Lower", 0), (24, 24, "Lower", 0)])
def test_mraw(reader, tmp_path, bits, recorded, side, shift):
    shown = images(4, 3, bits if bits == 24 else recorded)
    (tmp_path / "a.cih").write_text(f"#Camera Information Header\n\nDate : 2020/1/1\nRecord Rate(fps) : 1000\nTotal Frame : 5\nImage Width : 4\nImage Height : 3\nColor Bit : {bits}\nFile Format : MRaw\nEffectiveBit Depth : {recorded}\nEffectiveBit Side : {side}\nEND\nImage Width : 99\n")
    (tmp_path / "a.mraw").write_bytes(b"".join(stored(x, bits) for x in shown))
    found = pixels(reader(tmp_path).collect())
    for i, x in enumerate(shown, 1):
        np.testing.assert_allclose(found[i], x / 255 if bits == 24 else x << shift)
    head = reader(tmp_path, mode="headers").first()
    assert (head.kind, head.n_frames, head.bit_depth, head.recorded_depth, head.frame_rate) == ("mraw", 5, bits, recorded, 1000.0)


def test_filters_reach_the_reader(spark, reader, tmp_path):
    for name in ("a", "b"):
        cine(tmp_path / f"{name}.cine", [bytes([i] * 12) for i in range(20)], 4, 3, 8)
    all_ = reader(tmp_path, framesPerPartition=3)
    few = all_.where("frame > 4 AND frame <= 6")
    assert sorted((r.path[-6:], r.frame, r.pix[0]) for r in few.collect()) == [(f"{n}.cine", f, f - 1.0) for n in "ab" for f in (5, 6)]
    assert few.rdd.getNumPartitions() == 2  # one range a file
    assert [r.frame for r in all_.where(f"path = '{tmp_path}/b.cine' AND frame IN (2, 3, 9, 77)").orderBy("frame").collect()] == [2, 3, 9]
    assert all_.where("frame = 99").count() == 0 and all_.where("frame % 7 = 0").count() == 4
    made = rawvideo.RawVideoReader(all_.schema, {"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, LessThan, StringContains

    assert list(made.pushFilters([EqualTo(("frame",), 7), StringContains(("path",), "a"), LessThan(("width",), 3)])) == [StringContains(("path",), "a"), LessThan(("width",), 3)]
    assert [(p.first, p.last) for p in made.partitions()] == [(7, 7), (7, 7)]


def test_a_schema_without_pixels_reads_no_frames(spark, reader, tmp_path):
    cine(tmp_path / "a.cine", [], 4, 3, 8, n=7)  # a header whose frames are not there
    found = spark.read.format("rawvideo").schema("path string, frame int").load(str(tmp_path))
    assert sorted(r.frame for r in found.collect()) == list(range(1, 8))
    with pytest.raises(Exception, match="cut off"):
        reader(tmp_path).collect()
    with pytest.raises(Exception, match="colour"):
        spark.read.format("rawvideo").schema("colour int").load(str(tmp_path)).collect()


def test_a_recording_beyond_two_gigabytes_is_read_by_one_seek(reader, tmp_path):
    w, h, n = 1024, 1024, 3000
    path = tmp_path / "big.cine"
    cine(path, [], w, h, 8, n=n)
    at, size, _ = video.place_of(rawvideo.header_at(str(path)), 2900)
    shown = np.random.default_rng(3).integers(0, 256, (h, w)).astype(np.uint8)
    with open(path, "r+b") as f:  # a sparse file
        f.truncate(1640 + 8 * n + (8 + size) * n)
        f.seek(at)
        f.write(shown[::-1].tobytes())
    assert path.stat().st_size > 2 << 30
    row = reader(path).where("frame = 2900").first()
    assert (np.reshape(row.pix, (h, w)) == shown).all()
    assert (rawvideo.read_frame(str(path), 2900) == shown).all()
    path.unlink()


def test_patterns_folders_and_wrong_files(spark, reader, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a.cine", "in/b.cin", "c.mrf"):
        (mrf if name.endswith("mrf") else cine)(tmp_path / name, [bytes(12)], 4, 3, 8)
    (tmp_path / "d.txt").write_text("no video")
    assert reader(tmp_path).count() == 3 and reader(f"{tmp_path}/*.cine").count() == 1 and reader(f"file://{tmp_path}/c.mrf").count() == 1
    assert reader(f"file://{tmp_path}/c.mrf").first().path == f"file://{tmp_path}/c.mrf"
    with pytest.raises(Exception, match="no raw recording"):
        reader(tmp_path / "d.txt").collect()
    with pytest.raises(IndexError):
        rawvideo.read_frame(str(tmp_path / "a.cine"), 2)
    (tmp_path / "e.cih").write_text("File Format : AVI\n")
    with pytest.raises(ValueError, match="AVI"):
        rawvideo.header_at(str(tmp_path / "e.cih"))
