"""Bootstrap confidence intervals of triangulated points, without a row per replicate."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .sizes import few, tasks
from .solve import COMPLETE, KEY, sightings, undistorted

#: Replicated coordinates that are drawn together, and points whose replicates go through the processor's cache together.
CELLS, BLOCK = 1 << 20, 32
#: Rows and columns of the upper half of the normal equations, in the order in which they are kept.
PLACES = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def moments(u: np.ndarray, v: np.ndarray, c: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """(points, 9, 1 + 3 cameras): the normal equations of moved points as sums of 1, every move of u, of v, and u's and v's squares added.

    A row u c8 - c0 | c3 - u of the equations is linear in u, so their products
    have degree two; u and v of a camera have the same square terms.
    """
    n, out = u.shape[1], np.zeros((len(u), 9, 1 + 3 * u.shape[1]))
    d, one = c[..., 8:11], noise[:, None]
    for k, (x, at) in enumerate(((u, 0), (v, 4))):
        row, beside = x[..., None] * d - c[..., at : at + 3], c[..., at + 3] - x
        linear = slice(1 + k * n, 1 + (k + 1) * n)
        for to, (i, j) in enumerate(PLACES):
            out[:, to, 0] += (row[..., i] * row[..., j]).sum(axis=1)
            out[:, to, linear] = (row[..., i] * d[..., j] + d[..., i] * row[..., j]) * one
            out[:, to, 1 + 2 * n :] = d[..., i] * d[..., j] * one**2
        for i in range(3):
            out[:, 6 + i, 0] += (row[..., i] * beside).sum(axis=1)
            out[:, 6 + i, linear] = (d[..., i] * beside - row[..., i]) * one
            out[:, 6 + i, 1 + 2 * n :] = -d[..., i] * one**2
    return out


def solved(equations: np.ndarray) -> np.ndarray:
    """(3, points, replicates) from (9, points, replicates), by elimination over whole arrays, which it overwrites; NaN without a solution."""
    xx, xy, xz, yy, yz, zz, rx, ry, rz = equations
    t, out = np.empty_like(xx), np.empty((3, *xx.shape))
    x, y, z = out
    with np.errstate(divide="ignore", invalid="ignore"):
        inverse = np.divide(1, xx)
        down, far = xy * inverse, xz * inverse
        for left, factor, right in ((yy, down, xy), (yz, down, xz), (ry, down, rx), (zz, far, xz), (rz, far, rx)):
            left -= np.multiply(factor, right, out=t)
        under = np.divide(1, yy)
        np.multiply(yz, under, out=down)
        zz -= np.multiply(down, yz, out=t)
        rz -= np.multiply(down, ry, out=t)
        np.divide(rz, zz, out=z)
        ry -= np.multiply(yz, z, out=t)
        np.multiply(ry, under, out=y)
        rx -= np.multiply(xy, y, out=t)
        rx -= np.multiply(xz, z, out=t)
        np.multiply(rx, inverse, out=x)
        sure = np.isfinite(np.add(np.add(x, y, out=t), z, out=t))
    if not sure.all():
        out[:, ~sure] = np.nan
    return out


def spread(u: np.ndarray, v: np.ndarray, c: np.ndarray, noise: np.ndarray, replicates: int, rng: np.random.Generator) -> np.ndarray:
    """(points, 3) sample deviations of triangulations of ``u``, ``v`` (points, cameras) moved by N(0, noise)."""
    points, n = u.shape
    out = np.full((points, 3), np.nan)
    if replicates < 2:
        return out
    weights, most = moments(u, v, np.broadcast_to(c, (points, n, 11)), np.broadcast_to(noise, points)), min(points, BLOCK)
    moved, terms, equations = np.empty((2, most, replicates, n)), np.ones((most, 1 + 3 * n, replicates)), np.empty((9, most, replicates))
    for lo in range(0, points, BLOCK):
        held = min(BLOCK, points - lo)
        du, dv = (rng.standard_normal(out=m[:held]) for m in moved)
        here, sums = terms[:held], equations[:, :held]
        here[:, 1 : 1 + n], here[:, 1 + n : 1 + 2 * n] = du.swapaxes(1, 2), dv.swapaxes(1, 2)
        du *= du
        du += np.multiply(dv, dv, out=dv)
        here[:, 1 + 2 * n :] = du.swapaxes(1, 2)
        np.matmul(weights[lo : lo + held], here, out=sums.swapaxes(0, 1))
        xyz = solved(sums)
        if np.isnan(xyz).any():
            out[lo : lo + held] = np.nanstd(xyz, axis=2, ddof=1).T
        else:
            xyz -= xyz.mean(axis=2, keepdims=True)
            out[lo : lo + held] = np.sqrt(np.einsum("kpr,kpr->pk", xyz, xyz) / (replicates - 1))
    return out


def bootstrap(obs: DataFrame, camera: DataFrame, lens: DataFrame | None = None, least_error: float = 1.5, replicates: int = 250, seed: int = 1) -> DataFrame:
    """sd and 1.96 sd per trial, frame, point and axis over perturbed triangulations.

    Every observation is moved by N(0, 1) x rmse x sqrt(2) / cameras.  rmse is
    first raised to ``least_error``; two cameras then take the track's mean of
    such points.  Points are solved once and written, as their means come before
    their replicates; a window over a track would put each in one task.  A
    point's replicates are arrays inside its row, so nothing is shuffled for
    them; the random numbers follow from ``seed`` and the points of a slice, and
    slices are the same ones whenever there are as many tasks.
    """
    seen = sightings(undistorted(obs.where(COMPLETE), lens), camera).where("rmse IS NOT NULL")
    raised = written(seen.select(*KEY, "seen", "n_cams", F.greatest("rmse", F.lit(float(least_error))).alias("rmse")))
    tracks = few(raised.where("n_cams = 2").groupBy(F.col("trial").alias("_trial"), F.col("point").alias("_point")).agg(F.avg("rmse").alias("pairs")))
    rows = raised.repartition(tasks(obs.sparkSession), *KEY).join(tracks, F.col("trial").eqNullSafe(F.col("_trial")) & F.col("point").eqNullSafe(F.col("_point")), "left")
    noise = F.when(F.col("n_cams") == 2, F.col("pairs")).otherwise(F.col("rmse")) * (2**0.5) / F.col("n_cams")
    flat = rows.select(*KEY, "n_cams", noise.alias("noise"), F.hash(F.lit(seed), *KEY).alias("draw"), "seen").sortWithinPartitions(*KEY)
    known = {r.cam: r.c for r in camera.where(F.size("c") == 11).collect()}  # the rows of a rig, some nine
    cams, table = np.array(sorted(known)), np.array([known[cam] for cam in sorted(known)], float).reshape(-1, 11)

    def kernel(batches):
        for batch in batches:
            many, noise, draw = (batch.column(x).to_numpy() for x in ("n_cams", "noise", "draw"))
            first, sights = batch.column("seen").offsets.to_numpy(), batch.column("seen").values
            cam, u, v = (sights.field(x).to_numpy() for x in ("cam", "u", "v"))
            out = np.full((batch.num_rows, 3), np.nan)
            for n in np.unique(many).tolist():
                which = np.flatnonzero(many == n)
                for lo in range(0, len(which), step := max(1, CELLS // (replicates * n * 6))):
                    at = which[lo : lo + step]
                    cells = first[at][:, None] + np.arange(n)
                    rng = np.random.default_rng(draw[at].view(np.uint32).tolist())
                    out[at] = spread(u[cells], v[cells], table[np.searchsorted(cams, cam[cells])], noise[at], replicates, rng)
            axes = [pa.array(x, mask=np.isnan(x)) for x in out.T]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), *axes], [*KEY, *"xyz"])

    kinds = ", ".join(f"{k} {flat.schema[k].dataType.simpleString()}" for k in KEY)
    sd = flat.mapInArrow(kernel, f"{kinds}, x double, y double, z double")
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("sd")) for a in "xyz"])
    return sd.select(*KEY, F.inline(axes)).withColumn("ci", F.col("sd") * 1.96)
