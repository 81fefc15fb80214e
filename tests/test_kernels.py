"""Kernels and files against properties and hand-made fixtures."""

import inspect
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import calibrate, edits, kernels, solve, tables, timeseries, uncertainty
from trackloom.plans import fixtures as X
from trackloom.plans import queries
from trackloom.sources import files, video
from trackloom.streaming import tracker


def clicks(spark, points, noise=0.0):
    rows = [(p, cam, *(calibrate.projected(np.array(c), np.array([xyz]))[0] + noise).tolist()) for p, xyz in points.items() for cam, c in X.CAMERAS]
    return spark.createDataFrame(rows, "pt int, cam int, u double, v double")


CUBE = {i + 1: (float(i % 3 - 1), float(i // 3 % 3 - 1), float(i // 9 - 1)) for i in range(27)}


def test_calibration_round_trip_and_left_out(spark):
    obj = spark.createDataFrame([(p, *x) for p, x in CUBE.items()], "pt int, x double, y double, z double")
    for method in ("space", "modified"):
        for r in calibrate.calibrate(clicks(spark, CUBE), obj, method).collect():
            assert np.allclose(r.c, dict(X.CAMERAS)[r.cam], rtol=1e-4, atol=1e-5) and r.rmse < 1e-3
    bad = clicks(spark, CUBE).withColumn("u", F.when((F.col("pt") == 5) & (F.col("cam") == 1), F.col("u") + 20).otherwise(F.col("u")))
    left = {r.pt: r.rmse for r in calibrate.leave_one_out(bad, obj).where("cam = 1").collect()}
    assert min(left, key=left.get) == 5 and left[5] < 1e-6
    with pytest.raises(Exception, match="calibration points"):
        calibrate.calibrate(clicks(spark, {p: CUBE[p] for p in range(1, 6)}), obj).collect()
    few = calibrate.calibrate(clicks(spark, {p: CUBE[p] for p in range(1, 6)}), obj, strict=False).collect()
    assert [(r.c, r.rmse, r.n_points) for r in few] == [(None, None, 5)] * 3


def test_many_rigs_are_calibrated_apart(spark):
    rng = np.random.default_rng(2)
    points = {rig: rng.random((12, 3)) * 2 - 1 for rig in range(5)}
    rows, made = [], {}
    for rig, p in points.items():
        for cam, c in X.CAMERAS:
            uv = calibrate.projected(np.array(c), p) + rng.normal(size=(12, 2)) * 0.1
            made[rig, cam] = uv
            rows += [(rig, cam, i, float(u) if i else None, float(v)) for i, (u, v) in enumerate(uv)]
    obj = spark.createDataFrame([(rig, i, *map(float, x)) for rig, p in points.items() for i, x in enumerate(p)], "rig int, pt int, x double, y double, z double")
    seen = spark.createDataFrame(rows, "rig int, cam int, pt int, u double, v double")
    for r in calibrate.calibrate(seen, obj).collect():
        a, b = calibrate.design(points[r.rig][1:], made[r.rig, r.cam][1:])
        assert r.n_points == 11 and np.allclose(r.c, np.linalg.solve(a.T @ a, a.T @ b), rtol=1e-5)  # the normal equations
    left = {(r.rig, r.cam, r.pt): r.rmse for r in calibrate.leave_one_out(seen, obj).collect()}
    assert len(left) == 180 and left[0, 1, 0] is None
    keep = [i for i in range(1, 12) if i != 4]
    assert left[3, 2, 4] == pytest.approx(calibrate.fit(points[3][keep], made[3, 2][keep])[1])


def test_triangulation_edges(spark):
    point = (0.3, -0.2, 0.5)
    uv = {cam: calibrate.projected(np.array(c), np.array([point]))[0].tolist() for cam, c in X.CAMERAS}
    rows = [("t", f, 1, cam, *uv[cam]) for f, cams in enumerate([(), (1,), (1, 2), (1, 2, 3)]) for cam in cams] + [("t", 9, 1, 1, uv[1][0], None), ("t", 9, 1, 2, *uv[2])]
    obs = spark.createDataFrame(rows, "trial string, frame int, point int, cam int, u double, v double")
    got = {r.frame: r for r in solve.reconstruct(obs, X.cameras(spark)).collect()}
    assert set(got) == {2, 3} and all(np.allclose((r.x, r.y, r.z), point) and r.rmse < 1e-6 for r in got.values())
    plain = solve.triangulate(obs, X.cameras(spark))
    assert {r.frame for r in plain.collect()} == {2, 3}
    assert all(r.rmse < 1e-6 for r in solve.reprojection_rmse(obs, plain, X.cameras(spark)).collect())


def test_points_are_solved_among_their_sorted_rows(spark):
    """Against least squares point by point; null coordinates count for nothing, and nothing is collected or joined by point."""
    rng, cameras = np.random.default_rng(4), dict(X.CAMERAS)
    rows = []
    for trial in ("a", None):
        for f in range(1, 40):
            for p in (1, 2):
                for cam in rng.permutation([1, 2, 3, 4])[: rng.integers(1, 5)].tolist():  # camera 4 has no coefficients
                    u, v = calibrate.projected(np.array(cameras.get(cam, cameras[1])), np.array([(0.1 * p, 0.01 * f, 0.3)]))[0] + rng.normal(size=2)
                    rows.append((trial, f, p, cam, float(u), None if rng.random() < 0.1 else float(v)))
    obs = spark.createDataFrame(rows, edits_schema()).repartition(5)
    expected = {}
    for key in {r[:3] for r in rows}:
        mine = sorted(r[3:] for r in rows if r[:3] == key and r[3] in cameras and r[5] is not None)
        if len(mine) < 2:
            continue
        a, b = [], []
        for cam, u, v in mine:
            c = np.array(cameras[cam])
            a += [u * c[8:11] - c[:3], v * c[8:11] - c[4:7]]
            b += [c[3] - u, c[7] - v]
        x = np.linalg.lstsq(np.array(a), np.array(b), rcond=None)[0]
        off = [calibrate.projected(np.array(cameras[cam]), x[None])[0] - (u, v) for cam, u, v in mine]
        expected[key] = (*x, math.sqrt(np.sum(np.square(off)) / (2 * len(mine) - 3))), mine
    found = solve.sightings(obs, X.cameras(spark))  # nulls stay in, as a lens may leave them
    for got in (solve.reconstruct(obs, X.cameras(spark)), found):
        got = {(r.trial, r.frame, r.point): r for r in got.collect()}
        assert set(got) == set(expected)
        for key, (values, mine) in expected.items():
            r = got[key]
            assert np.allclose((r.x, r.y, r.z, r.rmse), values, rtol=1e-6, atol=1e-6) and r.n_cams == len(mine)
            assert "seen" not in r or [tuple(s) for s in r.seen] == mine  # by camera
    for df in (found, solve.reconstruct(obs, X.cameras(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and not [line for line in plan.splitlines() if "ObjectHashAggregate(keys=[" in line and "keys=[]" not in line]


def test_a_point_that_a_camera_can_not_see_again_has_no_residual(spark):
    rig = spark.createDataFrame([(1, X.CAMERAS[0][1]), (2, [*X.CAMERAS[1][1][:3], None, *X.CAMERAS[1][1][4:]]), (3, X.CAMERAS[2][1])], "cam int, c array<double>")
    rows = [("t", 1, 1, cam, *calibrate.projected(np.array(c), np.array([(0.1, 0.2, 0.3)]))[0].tolist()) for cam, c in X.CAMERAS]
    r = solve.reconstruct(spark.createDataFrame(rows, edits_schema()), rig).first()
    assert r.n_cams == 3 and r.rmse is None and r.x is not None


def test_touched_points_are_named_by_rows_or_by_a_condition(spark):
    rows = [("t", f, p if p < 3 else None, cam, *calibrate.projected(np.array(c), np.array([(0.1 * p, 0.01 * f, 0.3)]))[0].tolist()) for f in range(1, 9) for p in (1, 2, 3) for cam, c in X.CAMERAS]
    obs, camera = spark.createDataFrame(rows, edits_schema()), X.cameras(spark)
    moved = edits.nudge(obs, (F.col("point") == 1) & (F.col("cam") == 2), "up", 7.0)
    gone = moved.where("NOT (frame = 4 AND point <=> 1 AND cam > 1)")  # is cleared
    points = solve.reconstruct(obs, camera)
    near = lambda df: sorted((str(tuple(r[:3])), r.n_cams, *[round(x, 6) for x in (r.x, r.y, r.z, r.rmse)]) for r in df.collect())
    named = edits.retriangulated(points, gone, obs.where("point = 1"), camera)
    asked = edits.retriangulated(points, gone, F.col("point") == 1, camera)
    assert asked.columns == named.columns == points.columns and near(asked) == near(named) == near(solve.reconstruct(gone, camera))
    assert len(near(asked)) == 23


def test_a_nudge_is_computed_without_joining_points(spark):
    plan = queries.nudge_recomputed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("FileScan") == plan.count("Exchange hashpartitioning") == 2


def test_camera_pose_and_flip(spark):
    for r in solve.camera_pose(X.supplier_cameras(spark, "/root/testdata/sf0.001")).collect():
        assert r.cx == pytest.approx(12 + r.cam % 9) and r.cy == pytest.approx(-10 + r.cam * 7 % 21) and r.fv == pytest.approx(X.FOCAL)
    for r in solve.camera_pose(X.cameras(spark)).collect():
        assert np.allclose((r.cx, r.cy, r.cz), X.PLACES[r.cam - 1]) and math.isclose(r.fu, X.FOCAL) and math.isclose(r.uo, X.CENTER)
    heights = spark.createDataFrame([(i, 1024.0) for i in (1, 2, 3)], "cam int, height double")
    for r in solve.flip_vertical(X.cameras(spark), heights).collect():
        p = np.array([[0.2, 0.4, -0.1]])
        a, b = calibrate.projected(np.array(dict(X.CAMERAS)[r.cam]), p)[0], calibrate.projected(np.array(r.c), p)[0]
        assert np.allclose((a[0], 1024 - a[1]), b)


def test_splines():
    x, at = np.arange(8.0), np.array([-1.0, 2.5, 8.5])
    for curve in (kernels.spline_at, kernels.monotone_at):
        assert np.allclose(curve(x, 3 * x + 1, at), 3 * at + 1)
    assert np.allclose(kernels.spline_at(x, x**3 - x, at), at**3 - at)


def test_registered_smoothing_keeps_late_frames(spark, monkeypatch):
    track = spark.createDataFrame([("a", i, math.sin(i)) for i in range(1, 601)], "track string, frame int, u double")
    monkeypatch.setattr(X, "series", lambda *_: track)
    assert queries.smoothed(spark, "").where("smooth IS NOT NULL").agg(F.count("*"), F.max("frame")).first() == (600, 600)


def test_predictors_and_ladder(spark):
    assert kernels.kalman_next(np.full(11, 5.0)) == pytest.approx(5.0)
    assert kernels.kalman_next(np.array([1.0, np.nan, 3.0])) == 3.0 and math.isnan(kernels.kalman_next(np.full(4, np.nan)))
    assert kernels.double_exponential(np.arange(10.0))[0] == pytest.approx(10.0, abs=0.5)
    rows = [(str(n), i + 1, float(i)) for n in (1, 2, 3, 7, 8, 11, 12) for i in range(n)]
    last = {r.track: (r.mode, r.linear) for r in timeseries.predict(spark.createDataFrame(rows, "track string, frame int, u double")).where("frame = cast(track as int)").collect()}
    assert [last[k][0] for k in ("1", "2", "3", "7", "8", "11", "12")] == [1, 1, 2, 2, 2, 3, 3] and last["3"][1] == 3.0
    short = spark.createDataFrame([("a", i, None if i in (2, 5) else float(i)) for i in range(1, 6)], "track string, frame int, u double")
    assert [r.filled for r in timeseries.fill_gaps(short, least=3).orderBy("frame").collect()] == [1.0, 2.0, 3.0, 4.0, None]
    assert timeseries.fill_gaps(short).where("filled IS NULL").count() == 2


def test_matching_and_centroids(spark):
    rng = np.random.default_rng(3)
    scene = rng.random((30, 40))
    hill = np.exp(-((np.arange(7)[:, None] - 3) ** 2 + (np.arange(7) - 3) ** 2) / 4)
    scene = scene * 0.1  # images are smooth: the sub-pixel spline needs a peak wider than a pixel
    scene[10:17, 20:27] += hill
    r, c, fit = kernels.correlate(scene[10:17, 20:27], scene)
    assert abs(r - 13) <= 0.6 and abs(c - 23) <= 0.6 and fit > 3
    assert kernels.correlate(np.ones((3, 3)), np.ones((8, 8)))[2] == -1.0
    image = np.zeros((21, 21))
    image[8:13, 10:15] = 1
    assert np.allclose(kernels.centroid(image), (10, 12), atol=0.2)


def test_bootstrap_follows_noise(spark):
    obs = clicks(spark, CUBE).select(F.lit("t").alias("trial"), F.lit(1).alias("frame"), F.col("pt").alias("point"), "cam", "u", "v")
    ci = uncertainty.bootstrap(obs, X.cameras(spark), replicates=60)
    assert ci.count() == 81 and 0 < ci.agg(F.avg("sd")).first()[0] < 0.1


def test_registered_intervals_take_all_replicates(spark, monkeypatch):
    asked = []
    own = uncertainty.spread
    monkeypatch.setattr(uncertainty, "bootstrap", lambda *a, **b: asked.append((a, b)))
    queries.confidence_intervals(spark, "/root/testdata/sf0.001")
    assert len(asked[0][0]) == 2 and not asked[0][1]  # the operator's defaults
    monkeypatch.undo()
    assert inspect.signature(uncertainty.bootstrap).parameters["replicates"].default == 250
    u, v, c = np.zeros((2, 2)), np.zeros((2, 2)), np.array([[c for _, c in X.CAMERAS[:2]]] * 2)
    sd = own(u, v, c, np.array([0.5, 1.0]), 4000, np.random.default_rng(1))
    assert np.allclose(sd[1] / sd[0], 2, rtol=0.1)


def test_two_camera_intervals_raise_then_average(spark):
    """The noise of two-camera points is the track's mean of residuals, each raised to the least error first."""
    cameras, rows = dict(X.CAMERAS), []
    for frame, off in ((1, 0.0), (2, 12.0)):
        for cam in (1, 2):
            u, v = calibrate.projected(np.array(cameras[cam]), np.array([(0.1, 0.2, 0.3)]))[0]
            rows.append(("t", frame, 1, cam, float(u), float(v) + off * (cam == 1)))
    obs = spark.createDataFrame(rows, "trial string, frame int, point int, cam int, u double, v double")
    rmse = {r.frame: r.rmse for r in solve.reconstruct(obs, X.cameras(spark)).collect()}
    mean = (max(rmse[1], 1.5) + max(rmse[2], 1.5)) / 2
    got = {(r.frame, r.axis): r.sd for r in uncertainty.bootstrap(obs, X.cameras(spark), replicates=3000).collect()}
    o = {f: np.array([[r[4], r[5]] for r in rows if r[1] == f]).T[:, None, :] for f in (1, 2)}
    c = np.array([[cameras[1], cameras[2]]])
    for frame in (1, 2):
        sd = uncertainty.spread(o[frame][0], o[frame][1], c, np.array([mean * 2**0.5 / 2]), 3000, np.random.default_rng(frame))[0]
        assert np.allclose([got[(frame, a)] for a in "xyz"], sd, rtol=0.12)


def test_edits_are_inverse(spark):
    obs = spark.createDataFrame([("t", f, p, c, float(f), float(p)) for f in range(3) for p in (1, 2, 3) for c in (1, 2)], edits_schema())
    twice = edits.swap_points(edits.swap_points(obs, 1, 3, 0, 1), 1, 3, 0, 1)
    assert sorted(twice.collect()) == sorted(obs.collect())
    back = edits.join_points(edits.split_point(obs, 2, 1, 0, 9, 3), 4, 2)
    assert sorted(back.collect()) == sorted(obs.collect())
    assert tables.visibility(edits.set_points(obs, obs.where("cam = 1").withColumn("u", F.lit(None).cast("double")))).where("n_cams <> 1").count() == 0


def edits_schema():
    return "trial string, frame int, point int, cam int, u double, v double"


def test_wide_layouts(spark, tmp_path):
    xyz = spark.createDataFrame([(1, 1, 1.0, 2.0, 3.0, 0.5), (3, 2, -1.0, float("nan"), 0.25, None)], "frame int, point int, x double, y double, z double, rmse double")
    for kind, columns in (("xyzpts", "xyz"), ("xyzCI", "xyz"), ("xyzFilt", "xyz"), ("xyzres", ["rmse"])):
        files.write_wide(xyz, f"{tmp_path}/{kind}", kind, 4, 2)
        back = {(r.frame, r.point): tuple(r[c] for c in columns) for r in files.read_wide(spark, f"{tmp_path}/{kind}", kind, 2).collect()}
        assert back == ({(1, 1): (1.0, 2.0, 3.0), (3, 2): (-1.0, None, 0.25)} if columns == "xyz" else {(1, 1): (0.5,)})
    offsets = spark.createDataFrame([(2, 2, 1.5)], "frame int, cam int, offset double")
    files.write_wide(offsets, f"{tmp_path}/offsets", "offsets", 2, 0, 2)
    assert spark.read.text(f"{tmp_path}/offsets").count() == 3
    assert sorted(tuple(r) for r in files.read_wide(spark, f"{tmp_path}/offsets", "offsets", 0, 2).collect()) == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 1.5)]
    half = spark.createDataFrame([("t", 1, 1, 1, 5.0, None)], edits_schema())
    files.write_flat(half, f"{tmp_path}/half", 1, 1, 1)
    assert files.read_flat(spark, f"{tmp_path}/half", "t").collect() == half.collect()
    with pytest.raises(ValueError):
        files.read_wide(spark, f"{tmp_path}/offsets", "xyzpts", 2)
    with pytest.raises(ValueError):
        files.write_flat(half.unionByName(half.withColumn("trial", F.lit("other"))), f"{tmp_path}/two", 1, 1, 1)


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    (tmp_path / "many").mkdir()
    for name, lo, n in (("b", 100, 5000), ("a", 0, 100), ("c", 5100, 9)):  # Spark reads the largest first
        (tmp_path / "many" / f"{name}.csv").write_text("value\n" + "\n".join(str(lo + i) for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = files.numbered_lines(spark.read.option("header", True).csv(f"{tmp_path}/many"))
        assert lines.count() == 5109 and lines.where("frame <> cast(value as int) + 1").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_coefficients_round_trip(spark, tmp_path):
    files.write_coefficients(X.cameras(spark), f"{tmp_path}/dlt")
    back = {r.cam: r.c for r in files.read_coefficients(spark, f"{tmp_path}/dlt").collect()}
    assert all(np.allclose(back[cam], c) for cam, c in X.CAMERAS)


def test_text_layouts(spark, tmp_path):
    obs = spark.createDataFrame([("t", 1, 1, 1, 1.5, 2.5), ("t", 3, 2, 2, -4.0, 0.25)], edits_schema())
    files.write_flat(obs, f"{tmp_path}/flat", 4, 2, 2)
    assert sorted(files.read_flat(spark, f"{tmp_path}/flat", "t").collect()) == sorted(obs.collect())
    files.write_sparse(files.obs_cells(obs, 2), f"{tmp_path}/sparse", "points", 4, 8)
    assert sorted(files.cells_obs(files.read_sparse(spark, f"{tmp_path}/sparse"), 2, "t").collect()) == sorted(obs.collect())
    (tmp_path / "c.csv").write_text("\n".join(f"{i},{i + 1}" for i in range(11)))
    assert [r.c[0] for r in files.read_coefficients(spark, f"{tmp_path}/c.csv").collect()] == [0.0, 1.0]
    (tmp_path / "a.cih").write_text("#c\nRecord Rate(fps) : 500\n\nImage Width : 4\nEND\nx : 1\n")
    assert {r.key: r.value for r in files.read_cih(spark, f"{tmp_path}/a.cih").collect()} == {"Record Rate(fps)": "500", "Image Width": "4"}
    path = files.save_project({"obs": obs}, f"{tmp_path}/p_project")
    assert path.endswith("p_project") and files.load_project(spark, path, ["obs"])["obs"].count() == 2


def test_calibration_files(spark, tmp_path):
    rows = [(p, cam, 1.5 * p, -2.25 * cam) for p in range(1, 8) for cam in (1, 2) if (p, cam) != (3, 2)]
    seen = spark.createDataFrame(rows, "pt int, cam int, u double, v double")
    files.write_clicks(seen, f"{tmp_path}/cal01_xypts.csv", 7, 2)
    assert sorted(map(tuple, files.read_clicks(spark, f"{tmp_path}/cal01_xypts.csv", 2).collect())) == rows
    text = "".join(p.read_text() for p in sorted((tmp_path / "cal01_xypts.csv").glob("part-*")))
    assert text.splitlines()[0] == "cam1_X,cam1_Y,cam2_X,cam2_Y" and text.splitlines()[3] == "4.500000,-2.250000,NaN,NaN"
    assert {r.cam: (r.n_points, r.enough) for r in files.can_calibrate(seen.where("pt < 7")).collect()} == {1: (6, True), 2: (5, False)}
    with pytest.raises(ValueError):
        files.read_clicks(spark, f"{tmp_path}/cal01_xypts.csv", 3)


def test_calibration_images(spark, tmp_path):
    # the smallest of formats that the JVM writes: a bitmap by hand
    h, w = 2, 3
    pixels = np.arange(h * w * 3, dtype=np.uint8).reshape(h, w, 3)  # red, green, blue
    line = (w * 3 + 3) // 4 * 4
    body = b"".join(pixels[r, :, ::-1].tobytes().ljust(line, b"\0") for r in reversed(range(h)))
    (tmp_path / "a.bmp").write_bytes(b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(body), 0, 0, 54, 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body)
    (tmp_path / "b.txt").write_text("no image")
    row = files.read_calibration_images(spark, str(tmp_path)).collect()
    assert len(row) == 1 and (row[0].height, row[0].width) == (h, w) and row[0].pix == pixels[:, :, 0].ravel().astype(float).tolist()


def test_several_networks(spark):
    images = spark.createDataFrame([(f, c, [float(f), float(c)]) for f in range(4) for c in (1, 2)], "frame int, cam int, pix array<double>")
    chosen = spark.createDataFrame([(f, c, net) for f in range(3) for c in (1, 2) for net in ((1,) if f else (1, 2, 9, 1))], "frame int, cam int, net int")
    def times(k):
        return lambda g: g.assign(score=[sum(x) * k for x in g["pix"]])[["frame", "cam", "net", "score"]]
    found = {(r.frame, r.cam, r.net): r.score for r in kernels.apply_networks(images, chosen, {1: times(1), 2: times(10)}, "frame int, cam int, net int, score double").collect()}
    assert found == {(f, c, 1): float(f + c) for f in range(3) for c in (1, 2)} | {(0, c, 2): 10.0 * c for c in (1, 2)}


def test_raw_video(spark, tmp_path):
    words = [0] * 410
    for name, value in {"first_frame": -3, "n_frames": 2, "header_pad": 1640, "width": 4, "height": 3, "bytes": 12, "frame_rate": 500}.items():
        words[video.CINE_WORDS[name] - 1] = value
    frames = [bytes(range(12)), bytes(range(100, 112))]
    body = struct.pack("<410i", *words) + b"\0" * 16 + b"".join(b"\0" * 8 + f for f in frames)
    (tmp_path / "a.cine").write_bytes(body)
    head = video.headers(spark, f"{tmp_path}/a.cine").first()
    assert (head.width, head.height, head.n_frames, head.bit_depth, head.frame_rate) == (4, 3, 2, 8, 500.0)
    wanted = spark.createDataFrame([(head.path, 2)], "path string, frame int")
    assert video.read_frames(spark, f"{tmp_path}/a.cine", wanted).first().pix[-4:] == [100.0, 101.0, 102.0, 103.0]
    packed = np.array([1, 1023, 512, 3])
    bits = "".join(f"{x:010b}" for x in packed)
    assert video.unpack10(np.array([int(bits[i : i + 8], 2) for i in range(0, 40, 8)], np.uint8)).tolist() == packed.tolist()
    with pytest.raises(IndexError):
        video.frame_of(body, {**head.asDict()}, 3)


def test_streaming_predictions(spark, tmp_path):
    spark.createDataFrame([("a", i, float(i)) for i in range(1, 7)], "track string, frame int, u double").write.parquet(f"{tmp_path}/in")
    stream = tracker.track_stream(spark.readStream.schema("track string, frame int, u double").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("predictions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("predictions").collect()] == [("a", 7, 7.0)]


def test_constrained_calibration_steps_to_the_minimum_of_the_simplex():
    rng = np.random.default_rng(4)
    for n in (6, 8, 15, 200):
        p = rng.random((n, 3)) * [5, 5, 4]
        uv = calibrate.projected(np.array(X.CAMERAS[n % 3][1]), p) + rng.normal(size=(n, 2)) / 4
        start = calibrate.fit(p, uv)[0]
        whole = lambda v: np.r_[calibrate.orthogonal_first(v * start[1:]), v * start[1:]]
        asked = []
        walked = calibrate.simplex(lambda v: asked.append(1) or calibrate.residual(whole(v), p, uv), np.ones(10))
        c, rmse = calibrate.fit_modified(p, uv)
        m1, m2, m3 = c[:3], c[4:7], c[8:]
        assert rmse <= calibrate.residual(whole(walked), p, uv) + 1e-8 and len(asked) > 500
        assert abs(np.cross(m1, m3) @ np.cross(m2, m3)) <= 1e-9 * np.linalg.norm(np.cross(m1, m3)) * np.linalg.norm(np.cross(m2, m3))
        x, rests = calibrate.descend(whole, np.ones(10), p, uv, rounds=60)
        assert rests and np.allclose(whole(x), c)


def test_points_are_left_out_of_one_decomposition():
    rng = np.random.default_rng(8)
    for method, least in (("space", 6), ("plane", 4)):
        k = 3 if method == "space" else 2
        for n in (3, least, least + 1, 20):
            p = rng.random((9, n, k)) * 5
            uv = np.stack([calibrate.projected(np.array(X.CAMERAS[0][1] if k == 3 else X.PLANES[0][1]), x) for x in p]) + rng.normal(size=(9, n, 2)) / 4
            if n > least:
                uv[0, 1], uv[1, 2, 1], p[2, :, 0], p[3, 1:] = np.nan, np.nan, 1.0, p[3, :1] + np.arange(n - 1)[:, None] % 2  # gaps; flat and coinciding objects
            found = calibrate.residuals_without(p, uv, method, least)
            for i in range(9):
                whole = ~np.isnan(np.c_[p[i], uv[i]]).any(axis=1)
                for j in range(n):
                    others = whole & (np.arange(n) != j)
                    if np.isnan(uv[i, j, 0]) or others.sum() < least:
                        assert np.isnan(found[i, j])
                    else:
                        assert np.isclose(found[i, j], calibrate.fit(p[i][others], uv[i][others])[1], rtol=1e-5, atol=1e-7)


def test_replicates_are_triangulated_as_whole_arrays(monkeypatch):
    rng, points = np.random.default_rng(6), np.array([[1.0, 2.0, 0.5], [3.0, 1.0, 2.0]])
    for n in (2, 3):
        c = np.stack([X.CAMERAS[k][1] for k in range(n)])
        uv = np.stack([calibrate.projected(x, points) for x in c], 1) + rng.normal(size=(2, n, 2))
        draws, expected = np.random.default_rng(9), []
        u, v = (uv[:, None, :, k] + draws.standard_normal((2, 40, n)) * np.array([0.5, 2.0])[:, None, None] for k in (0, 1))
        for p in range(2):
            found = []
            for m in range(40):
                a = np.concatenate([u[p, m][:, None] * c[:, 8:] - c[:, :3], v[p, m][:, None] * c[:, 8:] - c[:, 4:7]])
                found.append(np.linalg.lstsq(a, np.r_[c[:, 3] - u[p, m], c[:, 7] - v[p, m]], rcond=None)[0])
            expected.append(np.std(found, axis=0, ddof=1))
        with monkeypatch.context() as m:
            m.setattr(np.linalg, "solve", None)  # a small solve a replicate was what took the time
            m.setattr(np.linalg, "det", None)
            got = uncertainty.spread(uv[..., 0], uv[..., 1], np.stack([c, c]), np.array([0.5, 2.0]), 40, np.random.default_rng(9))
        assert np.allclose(got, expected, rtol=1e-7)


def test_peaks_and_filters_of_many_rows_are_those_of_each():
    rng = np.random.default_rng(4)
    patches = rng.random((200, 5, 5))
    patches[:100] += 3 * np.exp(-((np.arange(5)[:, None] - 2.2) ** 2 + (np.arange(5) - 1.7) ** 2) / 3)  # hills, and rough ones whose peak may be anywhere
    at, weights, _ = kernels.fine_spline(2, 100)
    whole = (weights @ patches @ weights.T).reshape(200, -1).argmax(axis=1)
    down, across = kernels.sub_pixels(patches)
    assert (down == at[whole // 401]).all() and (across == at[whole % 401]).all()
    values = rng.random((300, 11)).cumsum(axis=1)
    values[rng.random(values.shape) < 0.3] = np.nan
    values[:4] = np.array([[np.nan], [7.5], [np.nan], [2.5]])
    values[2, 3:5] = 1.0, 2.0

    def slowly(v):
        ok = np.flatnonzero(~np.isnan(v))
        if len(ok) < 4:
            return v[ok[-1]] if len(ok) else np.nan
        z, gaps = v[ok[0] : ok[-1] + 1].copy(), np.isnan(v[ok[0] : ok[-1] + 1])
        z[gaps] = kernels.spline_at(ok - ok[0], v[ok], np.flatnonzero(gaps).astype(float)) if gaps.any() else []
        step, state, cov = np.array([[1.0, 0, 2], [0, 1, 1], [0, 0, 1]]), np.array([z[0], z[1] - z[0], z[2] - 2 * z[1] + z[0]]), 0.01 * np.eye(3)
        for x in z:
            state, cov = step @ state, step @ cov @ step.T + np.eye(3)
            gain = cov[:, 0] / (cov[0, 0] + 0.1)
            state, cov = state + gain * (x - state[0]), cov - np.outer(gain, cov[0])
        return (step @ state)[0]

    got = kernels.kalman_nexts(values)
    assert np.allclose(got, [slowly(v) for v in values], rtol=1e-10, equal_nan=True) and got[1] == 7.5 and got[3] == 2.5


def test_intervals_of_one_track_are_spread_over_tasks(spark):
    cameras = dict(X.CAMERAS)
    at = lambda cam, f: calibrate.projected(np.array(cameras[cam]), np.array([(0.1 + f / 400, 0.2, 0.3)]))[0]
    rows = [(trial, f, 1, cam, *(at(cam, f) + [0.0, 9.0 * (cam == 1 and f % 7 == 0)]).tolist()) for trial in ("t", None) for f in range(200) for cam in ((1, 2, 3) if f % 2 else (1, 2))]
    obs = spark.createDataFrame(rows, "trial string, frame int, point int, cam int, u double, v double")
    found = uncertainty.bootstrap(obs, X.cameras(spark)).select("*", F.spark_partition_id().alias("task")).collect()
    assert len(found) == 2 * 200 * 3 and all(r.sd > 0 and r.ci == r.sd * 1.96 for r in found)
    assert len({r.task for r in found}) > 4  # one a track before
    again = uncertainty.bootstrap(obs.repartition(3, "frame"), X.cameras(spark)).collect()
    assert {(r.trial, r.frame, r.axis): r.sd for r in again} == pytest.approx({(r.trial, r.frame, r.axis): r.sd for r in found})
    # both tracks, that without a name too, take the mean of their points of two cameras
    rmse = {r.frame: max(r.rmse, 1.5) for r in solve.reconstruct(obs.where("trial = 't'"), X.cameras(spark)).collect()}
    mean = np.mean([rmse[f] for f in range(0, 200, 2)])
    assert mean > 1.6
    u, v = np.array([[at(cam, 50) for cam in (1, 2)]]).transpose(2, 0, 1)
    expected = uncertainty.spread(u, v, np.array([[cameras[1], cameras[2]]]), np.array([mean * 2**0.5 / 2]), 4000, np.random.default_rng(1))[0]
    for trial in ("t", None):
        got = np.array([[r.sd for r in sorted(found, key=lambda r: r.axis) if r.trial == trial and r.frame == f] for f in (48, 50, 52)]).mean(axis=0)
        assert np.allclose(got, expected, rtol=0.15)


def test_blocks_of_replicates_are_solved_alike_and_without_a_solution_are_missing():
    rng, n = np.random.default_rng(8), 3
    c = np.stack([np.stack([X.CAMERAS[k][1] for k in range(n)])] * 70)
    uv = np.stack([calibrate.projected(c[0, k], rng.random((70, 3))) for k in range(n)], 1)
    sd = uncertainty.spread(uv[..., 0], uv[..., 1], c, np.full(70, 1.0), 2000, np.random.default_rng(1))
    for p in (0, uncertainty.BLOCK, 69):  # in the first, the second and the last, shorter block
        assert np.allclose(sd[p], uncertainty.spread(uv[p : p + 1, :, 0], uv[p : p + 1, :, 1], c[p : p + 1], np.ones(1), 2000, np.random.default_rng(p))[0], rtol=0.1)
    c[5] = 0
    with np.errstate(all="ignore"):
        gone = np.isnan(uncertainty.spread(uv[..., 0], uv[..., 1], c, np.full(70, 1.0), 20, np.random.default_rng(1)))
    assert gone[5].all() and gone.sum() == 3
