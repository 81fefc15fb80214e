"""The automatic tracker on rendered images: batch against known motion and its rules, stream against batch."""

import datetime
import time

import numpy as np
import pytest

from trackloom.streaming import autotrack as A

RIG = [(1, [float(i in (0, 6)) for i in range(11)]), (2, [float(i in (1, 6)) for i in range(11)]), (3, [0.7, 0.7, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
FRAMES = "trial string, frame int, cam int, height int, width int, pix array<double>"
STARTS = "trial string, frame int, point int, cam int, us array<double>, vs array<double>"


def place(point, frame):
    return (16 + 1.6 * frame, 40 - 1.1 * frame, 20 + 0.8 * frame) if point == 1 else (45 - 0.9 * frame, 18 + 1.3 * frame, 48 - 0.7 * frame)


def pixel(cam, xyz):
    c = np.array(RIG[cam - 1][1])
    return float(c[:3] @ xyz + c[3]), float(c[4:7] @ xyz + c[7])


def render(spots, h=64, w=72, noise=None):
    yy, xx = np.mgrid[1 : h + 1, 1 : w + 1]
    image = np.zeros((h, w)) if noise is None else noise.random((h, w)) * 0.02
    for u, v in spots:
        image += np.exp(-((xx - u) ** 2 + (yy - v) ** 2) / 6) + 0.4 * np.exp(-((xx - u - 3) ** 2 + (yy - v + 2) ** 2) / 3)
    return image


def film(n=14, points=(1, 2), cams=(1, 2, 3), moved=None, blank=()):
    """Rows of images; ``moved``: (cam, frame) -> shift of point 1; ``blank``: (cam, frame) without spots."""
    rng = np.random.default_rng(1)
    rows = []
    for f in range(1, n + 1):
        for cam in cams:
            spots = [] if (cam, f) in blank else [pixel(cam, place(p, f)) for p in points]
            if moved and (cam, f) in moved:
                spots[0] = (spots[0][0] + moved[cam, f], spots[0][1])
            rows.append(("t", f, cam, 64, 72, render(spots, noise=rng).ravel().tolist()))
    return rows


def begin(points=(1, 2), cams=(1, 2, 3), frame=1):
    return [("t", frame, p, cam, [pixel(cam, place(p, frame))[0]], [pixel(cam, place(p, frame))[1]]) for p in points for cam in cams]


def run(spark, frames, starts, parts=5, **options):
    o = A.Options(**{"half": 6, "reach": 5} | options)
    found = A.track_points(spark.createDataFrame(frames, FRAMES).repartition(parts), spark.createDataFrame(starts, STARTS), spark.createDataFrame(RIG, "cam int, c array<double>"), options=o)
    return {(r.frame, r.point): r for r in found.collect()}


def test_points_are_followed_in_all_cameras(spark):
    found = run(spark, film(), begin())
    assert found.keys() == {(f, p) for f in range(2, 15) for p in (1, 2)}
    for (f, p), r in found.items():
        assert np.allclose((r.x, r.y, r.z), place(p, f), atol=0.8) and r.rmse < 1.0 and r.erased is None and not r.ended
        assert [s.cam for s in r.sights] == [1, 2, 3]


def test_the_worst_camera_is_erased_and_the_point_triangulated_again(spark):
    found = run(spark, film(moved={(3, 6): 4.0}, points=(1,)), begin(points=(1,)), most_rmse=1.0, gap=1)
    assert found[6, 1].erased in (1, 2, 3) and sum(s.u is None for s in found[6, 1].sights) == 1
    worst = min((s.fit, s.cam) for s in found[6, 1].sights)[1]
    assert found[6, 1].erased == worst
    assert {f for f, _ in found} == set(range(2, 15)) and all(found[f, 1].erased is None for f in range(2, 6))


def test_failures_end_points_after_the_gap_and_together(spark):
    gone = {(cam, f) for cam in (1, 2, 3) for f in (5, 6, 7)}
    alone = run(spark, film(blank=gone, points=(1,)), begin(points=(1,)), gap=3, least_fit=4.0)
    assert [alone[f, 1].x is None for f in range(2, 9)] == [False, False, False, True, True, True, False] and not alone[14, 1].ended
    ended = run(spark, film(blank=gone, points=(1,)), begin(points=(1,)), gap=2, least_fit=4.0)
    assert max(f for f, _ in ended) == 7 and ended[7, 1].ended and not ended[6, 1].ended
    # point 2 is never in camera 3's image: it fails at once
    starts = begin(points=(1,)) + [("t", 1, 2, 3, [2.0], [2.0])]
    both = run(spark, film(points=(1,)), starts)
    assert both.keys() == {(2, 1), (2, 2)} and both[2, 1].ended and both[2, 2].ended
    single = run(spark, film(points=(1,)), starts, together=False)
    assert max(f for f, p in single if p == 1) == 14 and max(f for f, p in single if p == 2) == 2


def test_absent_images_late_starts_and_lanes(spark):
    frames = [r for r in film() if (r[1], r[2]) not in {(4, 1), (9, 1), (9, 2), (9, 3)}]
    frames.append(("t", 9, 1, 64, 72, None))
    found = run(spark, frames, begin(points=(1,)) + begin(points=(2,), frame=6), gap=1)
    assert {f for f, p in found if p == 1} == set(range(2, 15)) - {9} and {f for f, p in found if p == 2} == set(range(7, 15)) - {9}
    assert [s.fit for s in found[4, 1].sights][0] == -1.0 and found[4, 1].x is not None
    spread = A.track_points(spark.createDataFrame(film(), FRAMES), spark.createDataFrame(begin(), STARTS), spark.createDataFrame(RIG, "cam int, c array<double>"), options=A.Options(half=6, reach=5, together=False), lanes=2)
    one = run(spark, film(), begin(), together=False)
    assert {(r.frame, r.point): r for r in spread.collect()} == one
    with pytest.raises(ValueError):
        A.track_points(spark.createDataFrame(film(1), FRAMES), spark.createDataFrame(begin(), STARTS), spark.createDataFrame(RIG, "cam int, c array<double>"), lanes=2)


def test_lenses_are_taken_off_before_triangulation(spark):
    lens = [(1, 1500.0, 1500.0, 512.0, 512.0, -0.02, 0.001, 0.0005, -0.0003, 0.0)]
    table = spark.createDataFrame(lens, "cam int, f1 double, f2 double, cx double, cy double, k1 double, k2 double, k3 double, k4 double, k5 double")
    from trackloom.operators.solve import undistorted

    obs = spark.createDataFrame([(1, 100.0, 900.0), (1, 700.0, 40.0)], "cam int, u double, v double")
    expected = {(r.u, r.v) for r in undistorted(obs, table).collect()}
    got = {A.flat(u, v, table.first().asDict()) for u, v in ((100.0, 900.0), (700.0, 40.0))}
    assert all(min(abs(a - c) + abs(b - d) for c, d in expected) < 1e-9 for a, b in got)


def test_multi_starts(spark):
    rows = [("t", f, 1, 1, float(f), 1.0) for f in (1, 2, 3, 7, 8, 30)] + [("t", 5, 1, 2, None, 1.0), ("t", 5, 2, 2, 4.0, 1.0)]
    found = {(r.frame, r.point, r.cam): (r.us, r.vs) for r in A.multi_starts(spark.createDataFrame(rows, "trial string, frame int, point int, cam int, u double, v double")).collect()}
    assert found.keys() == {(3, 1, 1), (8, 1, 1), (30, 1, 1), (5, 2, 2)}
    us = found[8, 1, 1][0]
    assert us[:3] == [1, 2, 3] and all(x != x for x in us[3:6]) and us[6:] == [7, 8] and found[30, 1, 1] == ([30.0], [1.0])


def test_predictions_round_halves_away_and_need_samples():
    nan = float("nan")
    assert A.predicted([2.5]) == 3 and A.predicted([nan]) != A.predicted([nan]) and A.predicted([1.0, nan, 2.0, 3.0]) == round((12 + 2 - 2) / 3)
    assert A.match(np.zeros((20, 20)), np.zeros((5, 5)), [nan], [nan], A.Options())[2] == -1.0


def test_no_frames_and_no_starts(spark):
    camera = spark.createDataFrame(RIG, "cam int, c array<double>")
    assert A.track_points(spark.createDataFrame([], FRAMES), spark.createDataFrame(begin(), STARTS), camera).count() == 0
    assert A.track_points(spark.createDataFrame(film(2), FRAMES), spark.createDataFrame([], STARTS), camera).count() == 0


def test_the_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        at = lambda f: datetime.datetime(2024, 1, 1, 0, 0, f)
        frames = [(*r, at(r[1])) for r in film(9, moved={(3, 6): 4.0})]
        table = spark.createDataFrame(frames, FRAMES + ", ts timestamp")
        # cameras run ahead of each other, and frames come in disorder
        for part in ("cam = 1 AND frame < 5", "cam > 1 AND frame < 3", "cam = 2 AND frame > 2", "cam = 1 AND frame > 4 OR cam = 3 AND frame > 2"):
            table.where(part).orderBy("pix").coalesce(1).write.mode("append").parquet(f"{tmp_path}/frames")
            time.sleep(1.1)
        spark.createDataFrame([("end", 1, 1, 1, 1, [0.0], datetime.datetime(2024, 1, 2))], FRAMES + ", ts timestamp").write.mode("append").parquet(f"{tmp_path}/frames")
        starts = spark.createDataFrame([(*r, at(1)) for r in begin()], STARTS + ", ts timestamp")
        starts.coalesce(1).write.parquet(f"{tmp_path}/starts")
        camera, o = spark.createDataFrame(RIG, "cam int, c array<double>"), A.Options(half=6, reach=5, most_rmse=1.0, gap=1)
        read = lambda name, df: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
        q = A.track_points_stream(read("frames", table), read("starts", starts), camera, options=o, delay="12 seconds").writeStream.format("memory").queryName("followed").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
        q.awaitTermination(200)
        batch = A.track_points(table.drop("ts"), starts.drop("ts"), camera, options=o).collect()
        assert len(batch) == 16 and sorted(spark.table("followed").collect(), key=str) == sorted(batch, key=str)
    finally:
        spark.conf.set(provider, before)


def test_pixels_are_made_behind_the_shuffle(spark):
    from trackloom.plans import image_queries

    images, picture, digitised = image_queries.filmed(spark, "/root/testdata/sf0.001")
    images, digitised = (t.where("frame < 30 AND trial IN ('1', '2', '3', '4')") for t in (images, digitised))
    rig, options = spark.createDataFrame(image_queries.SIDES, "cam int, c array<double>"), A.Options(half=4, reach=3, gap=1)
    made = images.withColumn("pix", picture).select("trial", "frame", "cam", "height", "width", "pix")
    expected = A.track_points(made, A.multi_starts(digitised), rig, options=options)
    got = A.track_points(images, A.multi_starts(digitised), rig, options=options, picture=picture)
    rows = sorted(map(str, got.collect()))
    assert rows and rows == sorted(map(str, expected.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "EXP(" in plan and "EXP(" not in plan[plan.index("RepartitionByExpression [trial") :]


def test_trials_go_side_by_side_and_images_may_be_profiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    shown = [(f"t{t}", f, cam, 64, 72, np.exp(-((np.r_[1:65, 1:73] - np.repeat([v, u], [64, 72])) ** 2) / 6).tolist()) for t in range(12) for f in range(1, 9) for cam in (1, 2, 3) for u, v in [pixel(cam, place(1, f)) + rng.normal(size=2)]]
    starts = [(f"t{t}", *s[1:]) for t in range(12) for s in begin(points=(1,))]
    profiles = spark.createDataFrame([(*r[:5], [r[5]] if r[1] < 7 else []) for r in shown], FRAMES.replace("array<double>", "array<array<double>>"))
    pixels = spark.createDataFrame([(*r[:5], (np.outer(r[5][:64], r[5][64:]) * (r[1] < 7)).ravel().tolist()) for r in shown], FRAMES)
    follow = lambda frames, rows=starts: A.track_points(frames, spark.createDataFrame(rows, STARTS), spark.createDataFrame(RIG, "cam int, c array<double>"), options=A.Options(half=6, reach=5, gap=1))
    together = {(r.trial, r.frame): r for r in follow(pixels.coalesce(1)).collect()}
    assert len(together) == 12 * 7 and all(r.x is None for (_, f), r in together.items() if f > 6)
    # nobody's result depends on who is beside it, on how many images are held or on how they are given
    assert {(r.trial, r.frame): r for r in follow(pixels.where("trial = 't3'"), starts[9:12]).collect()}.items() <= together.items()
    for frames in (profiles, pixels):
        monkeypatch.setattr(A, "PIXELS", 1)
        assert {(r.trial, r.frame): r for r in follow(frames).collect()} == together
    # a frame of many trials is matched in one call
    calls, own = [], A.correlations
    monkeypatch.setattr(A, "correlations", lambda *a: calls.append(len(a[0])) or own(*a))
    trackers = [A.Tracker() for _ in range(12)]
    images = [{cam: np.outer(p[:64], p[64:]) for t, f, cam, _, _, p in shown if t == f"t{n}" and f == 2} for n in range(12)]
    for tracker, held in zip(trackers, images):
        tracker.begin(1, [(1, cam, [30.0], [30.0]) for cam in (1, 2, 3)], held, A.Options(half=6, reach=5))
    A.advance([(f"t{n}", 2, tracker, held) for n, (tracker, held) in enumerate(zip(trackers, images))], dict(RIG), {}, A.Options(half=6, reach=5))
    assert calls == [36]
