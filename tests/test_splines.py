"""The chunked smoothing spline against dense solves."""

import numpy as np
import pytest

from trackloom.operators import splines as S

SERIES = "track string, frame int, u double, weight double, tol double"


def noisy(n, seed=0, step=4):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.integers(1, step, n)).astype(float)
    return x, np.sin(x / 40) * 10 + rng.normal(size=n), rng.random(n) + 0.5


def by_chunks(x, y, w, lam, size, order=0):
    n = len(x)
    chunks = [S.Chunk(k, size, n, *(v[k * size : (k + 1) * size + 6 if S.follows(n, k, size) else None] for v in (x, y, w))) for k in range(max(0, (n - 6) // size) + 1)]
    solved = [c.eliminated(np.array([lam])) for c in chunks]
    ties = S.tied([(s, r, len(c.head) > 0, c.next) for c, (_, _, s, r) in zip(chunks, solved)], 1)
    out, missed = np.full(n, np.nan), 0.0
    for k, c in enumerate(chunks):
        at, values = c.curve(lam, ties[k][0], order)
        assert np.isnan(out[at + k * size]).all()  # every sample comes once
        out[at + k * size] = values
        form, one = c.misfit_form(np.array([lam]), *solved[k][:2])[0], np.r_[1, ties[k][0]]
        missed += one @ form @ one
    return out, missed


@pytest.mark.parametrize("n, size", [(600, 60), (600, 48), (600, 1000), (51, 48), (52, 48), (54, 48), (55, 48), (99, 16), (6, 48), (7, 7)])
@pytest.mark.parametrize("lam", [0.0, 1.0, 1e4])
def test_chunks_equal_a_dense_solve(n, size, lam):
    x, y, w = noisy(n)
    g, c = S.dense(x, y, w, lam)
    out, missed = by_chunks(x, y, w, lam, size)
    np.testing.assert_allclose(out, g, atol=1e-9)
    assert missed == pytest.approx((w * (y - g) ** 2).sum(), rel=1e-9, abs=1e-12)
    for order in (1, 2, 3):
        np.testing.assert_allclose(by_chunks(x, y, w, lam, size, order)[0], S.derivatives(x, g, c, 0, order), atol=1e-9)


def test_the_curve_is_the_smoothest_one():
    """No curve with the same misfit has less energy: the gradient of the energy is a multiple of that of the misfit."""
    x, y, w = noisy(40)
    g, c = S.dense(x, y, w, 30.0)
    gram, _, q = S.system(x, w)
    wide = np.zeros((37, 40))
    wide[np.arange(37)[:, None], np.arange(37)[:, None] + np.arange(4)] = q
    energy = lambda v: (wide @ v) @ np.linalg.solve(gram, wide @ v)  # noqa: E731  (of the spline through v)
    cost = lambda v: 30.0 * energy(v) + (w * (y - v) ** 2).sum()
    rng = np.random.default_rng(1)
    assert all(cost(g) < cost(g + 1e-3 * rng.normal(size=40)) for _ in range(50))
    np.testing.assert_allclose(np.linalg.solve(gram, wide @ g), c, atol=1e-8)  # f''' of the spline through g
    t, weight = S.quadrature(x, x[:-1], x[1:])
    bends = S.third(x, c, np.arange(39)[:, None] + np.zeros((1, 3), int), t)
    assert (bends**2 * weight).sum() == pytest.approx(energy(g), rel=1e-9)


def test_derivatives_are_those_of_the_quintic():
    x = np.sort(np.random.default_rng(2).random(30) * 20)
    k = np.array([0.3, -1.0, 0.5, 0.1, -0.02, 0.001])
    y = np.polyval(k[:3], x)  # a parabola is its own spline
    g, c = S.dense(x, y, np.ones(30), 0.0)
    np.testing.assert_allclose(S.derivatives(x, g, c, 0, 1), 2 * k[0] * x + k[1], atol=1e-8)
    np.testing.assert_allclose(S.derivatives(x, g, c, 0, 2), 2 * k[0], atol=1e-7)
    x, y, w = noisy(50)
    g, c = S.dense(x, y, w, 5.0)
    first, second, bend = (S.derivatives(x, g, c, 0, o) for o in (1, 2, 3))
    # integrating f''' from any sample gives the next one's value and derivatives
    for i in range(49):
        t, weight = S.quadrature(x[i : i + 1], x[i : i + 1], x[i + 1 : i + 2])
        t, weight, f3 = t[0], weight[0], S.third(x, c, np.full(3, i), t[0])
        h = x[i + 1] - x[i]
        assert g[i + 1] == pytest.approx(g[i] + h * first[i] + h * h / 2 * second[i] + ((x[i + 1] - t) ** 2 / 2 * f3 * weight).sum(), abs=1e-9)
        assert first[i + 1] == pytest.approx(first[i] + h * second[i] + ((x[i + 1] - t) * f3 * weight).sum(), abs=1e-9)
        assert second[i + 1] == pytest.approx(second[i] + (f3 * weight).sum(), abs=1e-9)
    assert bend.shape == (50,)


def searched(x, y, w, tol):
    """Lambda by bisection over dense solves."""
    lo, hi = -8.0, 14.0
    for _ in range(100):
        mid = (lo + hi) / 2
        g, _ = S.dense(x, y, w, 10.0**mid)
        lo, hi = (mid, hi) if (w * (y - g) ** 2).sum() <= tol else (lo, mid)
    return S.dense(x, y, w, 10.0**lo)


@pytest.mark.parametrize("order", [0, 1])
def test_tracks_are_smoothed_to_their_tolerance(spark, order):
    rows, expected = [], {}
    for i, (n, tol) in enumerate([(600, 300.0), (150, 40.0), (70, 1e-3), (52, 20.0), (12, 4.0)]):
        x, y, w = noisy(n, seed=i)
        rows += [(f"t{i}", int(a), float(b), float(c), tol) for a, b, c in zip(x, y, w)]
        g, c = searched(x, y, w, tol)
        for a, v in zip(x, g if order == 0 else S.derivatives(x, g, c, 0, order)):
            expected[f"t{i}", int(a)] = v
        rows += [(f"t{i}", int(x[-1]) + 5, None, 1.0, tol), (f"t{i}", int(x[-1]) + 6, 99.0, 0.0, tol), (f"t{i}", int(x[-1]) + 7, 99.0, None, tol)]
    found = {(r.track, r.frame): r.smooth for r in S.smoothing_splines(spark.createDataFrame(rows, SERIES).repartition(5), order).collect()}
    assert len(found) == len(rows) and sum(v is None for v in found.values()) == 15
    worst = max(abs(found[k] - v) for k, v in expected.items())
    assert worst < 1e-6
    if not order:
        for i, (n, tol) in enumerate([(600, 300.0), (150, 40.0)]):
            x, y, w = noisy(n, seed=i)
            assert (w * (y - [found[f"t{i}", int(a)] for a in x]) ** 2).sum() == pytest.approx(tol, rel=1e-6)


def test_short_tracks_parabolas_and_interpolation(spark):
    x, y, w = noisy(80, seed=9)
    rows = [(t, int(a), float(b), float(c), tol) for t, tol in (("loose", 1e9), ("exact", 0.0), ("none", None)) for a, b, c in zip(x, y, w)]
    rows += [("short", i, float(i * i % 7), 1.0, 5.0) for i in range(5)] + [("line", i, 2.0 * i, 1.0, 5.0) for i in range(60)]
    df = spark.createDataFrame(rows, SERIES)
    found = {(r.track, r.frame): r.smooth for r in S.smoothing_splines(df, size=20).collect()}
    k = np.polyfit(x, y, 2, w=np.sqrt(w))
    np.testing.assert_allclose([found["loose", int(a)] for a in x], np.polyval(k, x), atol=1e-8)
    assert all(found[t, int(a)] == pytest.approx(b, abs=1e-12) for t in ("exact", "none") for a, b in zip(x, y))
    assert [found["short", i] for i in range(5)] == [float(i * i % 7) for i in range(5)]
    np.testing.assert_allclose([found["line", i] for i in range(60)], 2.0 * np.arange(60), atol=1e-9)
    slopes = {(r.track, r.frame): r.smooth for r in S.smoothing_splines(df, order=1, size=20).collect()}
    np.testing.assert_allclose([slopes["loose", int(a)] for a in x], np.polyval(np.polyder(k), x), atol=1e-8)
    assert slopes["short", 2] is None
    with pytest.raises(ValueError):
        S.smoothing_splines(df, order=4)
    assert S.smoothing_splines(df.where("false")).count() == 0
