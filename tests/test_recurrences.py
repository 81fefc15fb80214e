"""Filters as parallel scans against walking along each track."""

import numpy as np
import pytest

from trackloom.operators import kernels, recurrences as R

SERIES = "track string, frame int, u double"


def tracks(lengths=(0, 1, 2, 3, 4, 5, 12, 200, 700), seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i, n in enumerate(lengths):
        frame = int(rng.integers(0, 50))
        for k in range(n):
            frame += int(rng.integers(1, 4)) if k % 17 else int(rng.integers(1, 90))
            rows.append((f"t{i}", frame, float(np.cumsum(rng.normal(size=2))[-1] * 5 + k)))
            if rng.random() < 0.1:
                rows.append((f"t{i}", frame + 1, None))
                frame += 1
    return rows


def by_track(rows):
    out = {}
    for t, f, u in sorted(rows, key=lambda r: r[:2]):
        if u is not None:
            out.setdefault(t, []).append((f, u))
    return out


@pytest.mark.parametrize("size", [1, 7, 100, 10_000])
def test_kalman_along_equals_the_filter_on_every_prefix(spark, size):
    rows = tracks()
    found = {(r.track, r.frame): r.predicted for r in R.kalman_along(spark.createDataFrame(rows, SERIES).repartition(5), size).collect()}
    for t, samples in by_track(rows).items():
        values = np.array([u for _, u in samples])
        for i in [*range(min(8, len(values))), *range(8, len(values), 41), len(values) - 1]:
            assert found[t, samples[i][0]] == pytest.approx(kernels.kalman_next(values[: i + 1]), rel=1e-9, abs=1e-9)
    assert len(found) == sum(u is not None for _, _, u in rows)


@pytest.mark.parametrize("size", [1, 7, 10_000])
@pytest.mark.parametrize("alpha", [0.05, 0.5, 0.97])
def test_double_exponential_along(spark, size, alpha):
    rows = tracks()
    found = {(r.track, r.frame): r.predicted for r in R.double_exponential_along(spark.createDataFrame(rows, SERIES).repartition(5), alpha, size).collect()}
    for t, samples in by_track(rows).items():
        for i in [*range(min(6, len(samples))), len(samples) // 2, len(samples) - 1]:
            p = kernels.double_exponential(np.array([u for _, u in samples[: i + 1]]), alpha)[0]
            assert found[t, samples[i][0]] is None if i < 2 else found[t, samples[i][0]] == pytest.approx(p, rel=1e-9, abs=1e-9)


def test_double_exponential_follows_its_definition():
    x, a = np.array([3.0, 5.0, 4.0, 8.0]), 0.3
    s, b = x[0], x[1]
    for v in x[2:]:
        s = a * v + (1 - a) * s
        b = a * s + (1 - a) * b
    assert kernels.double_exponential(x, a)[0] == pytest.approx((2 + a / (1 - a)) * s - (1 + a / (1 - a)) * b)
    assert kernels.double_exponential(x[:2])[0] != kernels.double_exponential(x[:2])[0]


def test_best_alpha_of_all_tracks(spark):
    rows = tracks((3, 30, 60, 90))
    df = spark.createDataFrame(rows, SERIES)
    found = {r.track: r for r in R.best_alpha(df, rounds=3).collect()}
    assert found.keys() == {"t1", "t2", "t3"}

    def error(values, a):
        p = [kernels.double_exponential(values[:i], a)[0] for i in range(3, len(values))]
        return float(np.mean((np.array(p) - values[3:]) ** 2))

    for t, samples in by_track(rows).items():
        values = np.array([u for _, u in samples])
        if t in found:
            assert found[t].error == pytest.approx(error(values, found[t].alpha), rel=1e-9)
            assert found[t].error <= min(error(values, a) for a in np.linspace(0.01, 0.99, 9)) + 1e-12


def carried(values, first=1, window=36):
    """Poses by walking along the frames."""
    x = [None if v is None or v == 0 else v for v in values]
    for i in range(len(x)):
        frame = i + first
        if x[i] is None:
            if frame > window:
                held = x[max(0, i - window) : i]
                if len(held) == window and None not in held:
                    x[i] = float(kernels.double_exponential(np.array(held))[0])
            elif i:
                x[i] = x[i - 1]
    return x


def test_poses_are_carried_and_then_predicted(spark):
    rng = np.random.default_rng(4)
    whole = {
        "sparse": [None if i in (4, 5, 50, 51, 52, 100, 140, 141, 190) else float(v) for i, v in enumerate(np.sin(np.arange(200) / 9) + 3)],
        "zeros": [0.0 if i % 45 == 44 else float(i) for i in range(200)],
        "often": [None if rng.random() < 0.05 else float(v) for v in rng.normal(size=300) + 5],
        "none": [None] * 50,
        "full": [1.0] * 40,
        "begins": [None, None, 2.0, None],
    }
    rows = [(t, i + 1, v) for t, values in whole.items() for i, v in enumerate(values)]
    found = {(r.track, r.frame): r.pose for r in R.carry_poses(spark.createDataFrame(rows, SERIES).repartition(4)).collect()}
    assert len(found) == len(rows)
    for t, values in whole.items():
        expected = carried(values)
        for i, v in enumerate(expected):
            got = found[t, i + 1]
            assert (got is None) == (v is None) and (v is None or got == pytest.approx(v, rel=1e-9)), (t, i + 1, got, v)
    assert found["sparse", 51] is not None and found["sparse", 5] == found["sparse", 4]


def test_predictions_need_only_the_last_samples(spark):
    df = spark.createDataFrame(tracks(), SERIES)
    plan = kernels.predict_next(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert kernels.predict_next(spark.createDataFrame([("a", i, float(i)) for i in range(50)], SERIES)).first().frame == 50


def test_no_samples(spark):
    empty = spark.createDataFrame([("a", 1, None)], SERIES)
    assert R.kalman_along(empty).count() == 0 and R.double_exponential_along(empty).count() == 0 and R.best_alpha(empty).count() == 0
    assert R.carry_poses(empty).first().pose is None


def test_tracks_are_predicted_side_by_side(spark):
    rng = np.random.default_rng(8)
    for n in (2, 3, 4, 12, 36):
        values = rng.random((20, n)) * 90
        if n > 3:
            values[3, 2], values[4] = np.nan, 5.0
        np.testing.assert_allclose(kernels.double_exponentials(values), [kernels.double_exponential(v)[0] for v in values], rtol=1e-9)
    rows = [(f"t{k}", i, float(x)) for k in range(60) for i, x in enumerate(rng.random(2 + k) * 90)] + [("gap", 1, 5.0), ("gap", 2, None), ("gap", 3, 6.0)]
    for method, window, alone in (("double", 36, lambda v: kernels.double_exponential(v)[0]), ("kalman", 11, kernels.kalman_next)):
        found = kernels.predict_next(spark.createDataFrame(rows, SERIES).repartition(7), method, window)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "FlatMapGroups" not in plan  # no call a track
        got = {r.track: (r.frame, r.predicted) for r in found.collect()}
        assert len(got) == 61
        for t, (frame, predicted) in got.items():
            own = [(i, u) for k, i, u in rows if k == t]
            want = np.round(alone(np.array([u for _, u in own], float)[-window:]))
            assert frame == own[-1][0] + 1 and (predicted is None) == bool(np.isnan(want)) and (predicted is None or predicted == want)
    assert "FlatMapGroups" not in R.carry_poses(spark.createDataFrame(rows, SERIES))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["alphas", "splines"])
def test_tasks_hold_a_part_of_a_batch_at_a_time(spark, monkeypatch, name):
    from pyspark.sql.classic.dataframe import DataFrame

    from trackloom.operators import splines

    calls, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **k: calls.append((self, f)) or plain(self, f, *a, **k))
    df = spark.range(1500).selectExpr("cast(id as string) AS track", "explode(sequence(1, 8)) AS frame").selectExpr("*", "rand(3) * 90 AS u", "1.0D AS weight", "500.0D AS tol")
    if name == "alphas":
        R.double_exponential_along(df)
    else:
        splines.smoothing_splines(df)
    given, f = calls[0]
    batch = given.toArrow().combine_chunks().to_batches()[0]
    made = list(f(iter([batch])))
    assert batch.num_rows == 1500 and sum(b.num_rows for b in made) == 1500
    assert max(b.num_rows for b in made) <= (1024 if name == "alphas" else splines.HELD)
