"""Camera calibration: one small least-squares problem per camera, solved where its rows are grouped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizes import few

#: Numbers of a camera's points without one another in memory together.
CELLS = 1 << 18


def design(p: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linear system of the projection: two rows per point; p has 3 (space) or 2 (plane) columns."""
    n, k = p.shape
    one = np.c_[p, np.ones(n)]
    zero = np.zeros_like(one)
    top, low = np.hstack([one, zero, -p * uv[:, :1]]), np.hstack([zero, one, -p * uv[:, 1:]])
    return np.stack([top, low], 1).reshape(2 * n, -1), uv.reshape(-1)


def projected(c: np.ndarray, p: np.ndarray) -> np.ndarray:
    k = p.shape[1]
    below = p @ c[2 * k + 2 :] + 1
    return np.c_[(p @ c[:k] + c[k]) / below, (p @ c[k + 1 : 2 * k + 1] + c[2 * k + 1]) / below]


def residual(c: np.ndarray, p: np.ndarray, uv: np.ndarray) -> float:
    return float(np.sqrt(((projected(c, p) - uv) ** 2).sum() / (2 * len(p))))


def fit(p: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, float]:
    a, b = design(p, uv)
    c = np.linalg.lstsq(a, b, rcond=None)[0]
    return c, residual(c, p, uv)


def simplex(score, start: np.ndarray, rounds: int = 4000, tol: float = 1e-10) -> np.ndarray:
    """Downhill simplex with standard reflection, expansion, contraction and shrinking."""
    n = len(start)
    x = np.vstack([start, *[start + np.where(np.arange(n) == i, start[i] * 0.05 if start[i] else 2.5e-4, 0) for i in range(n)]])
    f = np.array([score(v) for v in x])
    for _ in range(rounds):
        order = np.argsort(f, kind="stable")
        x, f = x[order], f[order]
        if f[-1] - f[0] <= tol * (1 + abs(f[0])):
            break
        mid = x[:-1].mean(axis=0)
        try_at = lambda t: (mid + t * (x[-1] - mid), score(mid + t * (x[-1] - mid)))
        r, fr = try_at(-1.0)
        if fr < f[0]:
            e, fe = try_at(-2.0)
            x[-1], f[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < f[-2]:
            x[-1], f[-1] = r, fr
        else:
            k, fk = try_at(-0.5 if fr < f[-1] else 0.5)
            if fk < min(fr, f[-1]):
                x[-1], f[-1] = k, fk
            else:
                x[1:] = x[0] + 0.5 * (x[1:] - x[0])
                f[1:] = [score(v) for v in x[1:]]
    return x[np.argmin(f)]


def orthogonal_first(rest: np.ndarray) -> float:
    """c1 from the others, so that the image axes are orthogonal: (m1 x m3) . (m2 x m3) = 0 solved for c1."""
    (c2, c3), m2, m3 = rest[:2], rest[3:6], rest[7:10]
    n = np.cross(m3, np.cross(m2, m3))  # the condition is linear in m1
    return float(-(c2 * n[1] + c3 * n[2]) / n[0]) if n[0] else 0.0


def gradients(c: np.ndarray, p: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of the projection and their derivatives by the eleven coefficients."""
    at, one = projected(c, p), np.c_[p, np.ones(len(p))] / (p @ c[8:] + 1)[:, None]
    zero = np.zeros_like(one)
    top, low = (np.hstack([*sides, -at[:, [k]] * one[:, :3]]) for k, sides in enumerate(((one, zero), (zero, one))))
    return (at - uv).T.reshape(-1), np.vstack([top, low])


def descend(whole, start: np.ndarray, p: np.ndarray, uv: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, bool]:
    """Damped Gauss-Newton steps over the free coefficients of ``whole``; whether the steps came to rest."""
    x, damp, moves = start, 1e-3, np.eye(len(start)) * 1e-6
    c = whole(x)
    far, by_c = gradients(c, p, uv)
    cost = far @ far
    for _ in range(rounds):
        # the constrained coefficient by differences, the others are scaled copies of their own
        turned = np.stack([(whole(x + m) - whole(x - m)) / 2e-6 for m in moves], 1)
        j = by_c @ turned
        left, right = j.T @ j, j.T @ far
        while True:
            try:
                step = np.linalg.solve(left + damp * np.diag(np.diag(left)), right)
            except np.linalg.LinAlgError:
                return x, False
            new = whole(x - step)
            new_far, new_by = gradients(new, p, uv)
            new_cost = new_far @ new_far
            if new_cost <= cost:
                break
            damp *= 10
            if not damp < 1e12:
                return x, bool(np.isfinite(cost) and np.abs(step).max() < 1e-8)
        rest = cost - new_cost <= 1e-14 * cost
        x, c, far, by_c, cost, damp = x - step, new, new_far, new_by, new_cost, max(damp / 10, 1e-12)
        if rest:
            return x, True
    return x, False


def fit_modified(p: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, float]:
    """Eleven coefficients under the orthogonality constraint, from the linear solution.

    A few Gauss-Newton steps reach the minimum; where they do not come to rest
    the downhill simplex searches on from the best place so far.
    """
    start = fit(p, uv)[0]
    scale = np.where(start[1:] == 0, 1.0, start[1:])
    whole = lambda v: np.r_[orthogonal_first(v * scale), v * scale]
    with np.errstate(all="ignore"):
        found, rests = descend(whole, start[1:] / scale, p, uv)
    best = whole(found if rests else simplex(lambda v: residual(whole(v), p, uv), found))
    return best, residual(best, p, uv)


def meeting(cal_obs: DataFrame, cal_object: DataFrame, axes: list[str]) -> tuple[DataFrame, list[str]]:
    """Clicks beside their object points, and the columns that name a camera: all but pt, u and v.

    An object with columns of these names (a rig, say) is one of many.
    """
    keys = [c for c in cal_obs.columns if c not in ("pt", "u", "v")]
    own = [c for c in keys if c in cal_object.columns]
    return cal_obs.join(few(cal_object), [*own, "pt"]).select(*keys, "pt", "u", "v", *axes), keys


def typed(df: DataFrame, keys: list[str], rest: str) -> str:
    return "".join(f"{k} {df.schema[k].dataType.simpleString()}, " for k in keys) + rest


def calibrate(cal_obs: DataFrame, cal_object: DataFrame, method: str = "space", strict: bool = True) -> DataFrame:
    """Coefficients per camera: ``space`` (11), ``modified`` (11, constrained) or ``plane`` (8).

    Clicks (cam, pt, u, v and columns that tell rigs apart) meet the object by
    point; incomplete rows are left out.  A camera with fewer than six points
    (four in a plane) raises an error, or has NULL coefficients unless ``strict``.
    """
    axes = ["x", "y"] if method == "plane" else ["x", "y", "z"]
    least = 4 if method == "plane" else 6
    rows, keys = meeting(cal_obs, cal_object, axes)
    solve = fit_modified if method == "modified" else fit

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        key = {k: [g[k].iloc[0]] for k in keys}
        if len(g) < least:
            if strict:
                raise ValueError(f"camera {g['cam'].iloc[0]}: {len(g)} calibration points, {least} are needed")
            return pd.DataFrame({**key, "c": [None], "rmse": pd.Series([None], dtype=float), "n_points": [len(g)]})
        g = g.sort_values("pt")
        c, rmse = solve(g[axes].to_numpy(float), g[["u", "v"]].to_numpy(float))
        return pd.DataFrame({**key, "c": [c], "rmse": [rmse], "n_points": [len(g)]})

    return rows.dropna(subset=["u", "v", *axes]).groupBy(*keys).applyInPandas(kernel, typed(rows, keys, "c array<double>, rmse double, n_points int"))


def residuals_without(p: np.ndarray, uv: np.ndarray, method: str, least: int) -> np.ndarray:
    """(cameras, points) residuals of the fits without each point; NaN where it was not clicked or too few are left.

    Linear fits of complete cameras follow from one QR decomposition: leaving
    rows A_i out moves the solution by R^-1 Q_i' (1 - Q_i Q_i')^-1 e_i.  Where
    that is near singular, and for all others, the fit is done again.
    """
    solve = fit_modified if method == "modified" else fit
    m, n, k = p.shape
    clicked = ~np.isnan(uv[..., 0])
    whole = ~np.isnan(np.concatenate([p, uv], axis=2)).any(axis=2)
    out = np.full((m, n), np.nan)
    again = clicked & (whole.sum(axis=1, keepdims=True) - whole >= least)
    sure = np.flatnonzero(whole.all(axis=1)) if method != "modified" and n > least else np.zeros(0, int)
    if len(sure):
        x, y = p[sure], uv[sure]
        one = np.concatenate([x, np.ones((len(sure), n, 1))], axis=2)
        zero = np.zeros_like(one)
        a = np.stack([np.concatenate([one, zero, -x * y[..., :1]], axis=2), np.concatenate([zero, one, -x * y[..., 1:]], axis=2)], axis=2).reshape(len(sure), 2 * n, -1)
        length = np.sqrt((a * a).sum(axis=1, keepdims=True))  # columns of one length: pixels and ones differ by thousands
        length[length == 0] = 1
        q, r = np.linalg.qr(a / length)
        diagonal = np.abs(np.einsum("mii->mi", r))
        right = np.einsum("mij,mi->mj", q, y.reshape(len(sure), -1))
        pairs = q.reshape(len(sure), n, 2, -1)
        off = y - np.einsum("mnij,mj->mni", pairs, right)
        rest = np.eye(2) - np.einsum("mnij,mnkj->mnik", pairs, pairs)
        det = rest[..., 0, 0] * rest[..., 1, 1] - rest[..., 0, 1] ** 2
        firm = (det > 1e-6) & (diagonal.min(axis=1) > 1e-8 * diagonal.max(axis=1))[:, None]
        kept = np.flatnonzero(firm.any(axis=1))
        pull = np.stack([rest[..., 1, 1] * off[..., 0] - rest[..., 0, 1] * off[..., 1], rest[..., 0, 0] * off[..., 1] - rest[..., 0, 1] * off[..., 0]], axis=2) / np.where(firm, det, 1.0)[..., None]
        coordinates = right[:, None, :] - np.einsum("mnij,mni->mnj", pairs, pull)
        c = np.linalg.solve(r[kept], coordinates[kept].transpose(0, 2, 1)).transpose(0, 2, 1) / length[kept]
        dot = lambda d: np.einsum("mik,mjk->mij", d, x[kept])
        below = dot(c[..., 2 * k + 2 :]) + 1
        far = ((dot(c[..., :k]) + c[..., k : k + 1]) / below - y[kept, None, :, 0]) ** 2 + ((dot(c[..., k + 1 : 2 * k + 1]) + c[..., 2 * k + 1 : 2 * k + 2]) / below - y[kept, None, :, 1]) ** 2
        far[:, np.arange(n), np.arange(n)] = 0
        found = np.sqrt(far.sum(axis=2) / (2 * (n - 1)))
        out[sure[kept]] = np.where(firm[kept], found, np.nan)
        again[sure[kept]] &= ~firm[kept]
    for i, j in np.argwhere(again):
        others = whole[i] & (np.arange(n) != j)
        out[i, j] = solve(p[i][others], uv[i][others])[1]
    return out


def leave_one_out(cal_obs: DataFrame, cal_object: DataFrame, method: str = "space") -> DataFrame:
    """Residual of each camera's fit without each point; NULL for points that were not clicked, or if too few are left.

    A camera is a group and its points, an object's, are left out in turn.
    """
    axes = ["x", "y"] if method == "plane" else ["x", "y", "z"]
    least = 4 if method == "plane" else 6
    rows, keys = meeting(cal_obs, cal_object, axes)
    held = F.sort_array(F.collect_list(F.struct("pt", *[F.col(c).cast("double").alias(c) for c in ("u", "v", *axes)])))
    cameras = rows.groupBy(*keys).agg(held.alias("held"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("held")
            sizes, flat = held.value_lengths().to_numpy(), held.flatten()
            uv, p = (np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in names], 1).astype(float) for names in (("u", "v"), axes))
            out = np.full(len(flat), np.nan)
            first = np.cumsum(sizes) - sizes
            for n in np.unique(sizes).tolist():
                at = first[sizes == n][:, None] + np.arange(n)
                for lo in range(0, len(at), step := max(1, CELLS // (n * (n + 24)))):
                    out[at[lo : lo + step]] = residuals_without(p[at[lo : lo + step]], uv[at[lo : lo + step]], method, least)
            own = [batch.column(k).take(pa.array(np.repeat(np.arange(batch.num_rows), sizes))) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, flat.field("pt").cast(pa.int32()), pa.array(out, mask=np.isnan(out))], [*keys, "pt", "rmse"])

    return cameras.mapInArrow(kernel, typed(rows, keys, "pt int, rmse double"))
