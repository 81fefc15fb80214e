"""Kernels that are sequential or iterative; Spark groups and shuffles, NumPy works inside a group.

A group is one track, camera or image pair, so its size is that of a recording.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizes import few


def by_track(series: DataFrame, kernel, schema: str) -> DataFrame:
    return series.select("track", "frame", "u").groupBy("track").applyInPandas(lambda g: kernel(g.sort_values("frame", kind="stable").reset_index(drop=True)), schema)


def sliced(batch: pa.RecordBatch, most: int = 1024) -> Iterator[pa.RecordBatch]:
    """The rows of an Arrow batch, ``most`` at a time, so that what a task makes of them stays small."""
    for first in range(0, batch.num_rows, most):
        yield batch.slice(first, most)


# interpolation

def cubic_coefficients(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Second derivatives of the not-a-knot cubic spline, by tridiagonal elimination in linear time."""
    n, h = len(x), np.diff(x)
    below, own, above = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()  # rows of the inner knots
    right = 6 * np.diff(np.diff(y) / h)
    # the first and last second derivatives lie on the line through their two neighbours
    near, far = h[0] / h[1], h[-1] / h[-2]
    own[0], above[0] = own[0] + below[0] * (1 + near), above[0] - below[0] * near
    own[-1], below[-1] = own[-1] + above[-1] * (1 + far), below[-1] - above[-1] * far
    for i in range(1, n - 2):
        step = below[i] / own[i - 1]
        own[i] -= step * above[i - 1]
        right[i] -= step * right[i - 1]
    m = np.zeros(n)
    m[n - 2] = right[-1] / own[-1]
    for i in range(n - 4, -1, -1):
        m[i + 1] = (right[i] - above[i] * m[i + 2]) / own[i]
    m[0], m[-1] = m[1] * (1 + near) - m[2] * near, m[-2] * (1 + far) - m[-3] * far
    return m


def spline_at(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Not-a-knot cubic spline with extrapolation; a polynomial through two or three points."""
    if len(x) < 4:
        return np.polyval(np.polyfit(x, y, len(x) - 1), at)
    m, i = cubic_coefficients(x, y), np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h, a, b = x[i + 1] - x[i], x[i + 1] - at, at - x[i]
    return (m[i] * a**3 + m[i + 1] * b**3) / (6 * h) + (y[i] / h - m[i] * h / 6) * a + (y[i + 1] / h - m[i + 1] * h / 6) * b


def monotone_at(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shape-preserving cubic (harmonic-mean slopes) with extrapolation."""
    if len(x) < 3:
        return np.polyval(np.polyfit(x, y, len(x) - 1), at)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    inner = np.zeros(len(d) - 1)
    same = d[:-1] * d[1:] > 0
    inner[same] = ((w1 + w2)[same]) / (w1[same] / d[:-1][same] + w2[same] / d[1:][same])

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        return 0.0 if s * d0 <= 0 else 3 * d0 if d0 * d1 < 0 and abs(s) > 3 * abs(d0) else s

    s = np.r_[end(h[0], h[1], d[0], d[1]), inner, end(h[-1], h[-2], d[-1], d[-2])]
    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    t, hi = (at - x[i]) / h[i], h[i]
    return y[i] * (1 + 2 * t) * (1 - t) ** 2 + s[i] * hi * t * (1 - t) ** 2 + y[i + 1] * t * t * (3 - 2 * t) + s[i + 1] * hi * t * t * (t - 1)


def fill_spline(series: DataFrame, method: str = "spline", least: int = 5, extrapolate: bool = False) -> DataFrame:
    """Fill gaps by ``spline`` or ``cubic``; outside the valid range only with ``extrapolate``."""
    curve = spline_at if method == "spline" else monotone_at

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        ok = g["u"].notna().to_numpy()
        out = g["u"].to_numpy(float).copy()
        if ok.sum() >= max(2, least):
            x = g["frame"].to_numpy(float)
            want = ~ok if extrapolate else ~ok & (x > x[ok].min()) & (x < x[ok].max())
            if want.any():
                out[want] = curve(x[ok], out[ok], x[want])
        return pd.DataFrame({"track": g["track"], "frame": g["frame"], "u": g["u"], "filled": out, "fitted": (~ok).astype("int32")})

    return by_track(series, kernel, "track string, frame int, u double, filled double, fitted int")


# predictors

@functools.lru_cache(1024)
def kalman_weights(known: bytes) -> np.ndarray:
    """What each known sample weighs in the filter's next value, which is linear in them: its answers to unit samples.

    ``known`` has a byte a sample from the first known one to the last.
    """
    ok = np.frombuffer(known, bool)
    at, z = np.flatnonzero(ok), np.zeros((len(ok), np.count_nonzero(ok)))
    z[at] = np.eye(len(at))
    if not ok.all():
        gaps = np.flatnonzero(~ok)
        z[gaps] = np.array([spline_at(at, unit, gaps.astype(float)) for unit in np.eye(len(at))]).T
    # position takes twice the acceleration and no velocity: a fixed value: the model matrix to be matched
    step = np.array([[1.0, 0, 2], [0, 1, 1], [0, 0, 1]])
    state, cov = np.array([z[0], z[1] - z[0], z[2] - 2 * z[1] + z[0]]), 0.01 * np.eye(3)
    for x in z:
        state, cov = step @ state, step @ cov @ step.T + np.eye(3)
        gain = cov[:, 0] / (cov[0, 0] + 0.1)
        state, cov = state + np.outer(gain, x - state[0]), cov - np.outer(gain, cov[0])
    return (step @ state)[0]


def kalman_nexts(values: np.ndarray) -> np.ndarray:
    """Next value behind each row by a constant-acceleration filter; gaps are splined, fewer than four samples repeat the last."""
    known, out, alike = ~np.isnan(values), np.full(len(values), np.nan), {}
    for i, k in enumerate(known):
        alike.setdefault(k.tobytes(), []).append(i)
    for rows in alike.values():
        ok = known[rows[0]].nonzero()[0]
        if len(ok):
            z = values[np.ix_(rows, ok)]
            # from the last sample on, so that what does not move is predicted where it is
            out[rows] = z[:, -1] if len(ok) < 4 else z[:, -1] + ((z - z[:, -1:]) * kalman_weights(known[rows[0], ok[0] : ok[-1] + 1].tobytes())).sum(axis=1)
    return out


def kalman_next(values: np.ndarray) -> float:
    """``kalman_nexts`` of one row."""
    return float(kalman_nexts(values[None])[0])


def double_exponential(values: np.ndarray, alpha: float | None = None) -> tuple[float, float]:
    """(next value, alpha) of double exponential smoothing, which the first two samples begin; alpha minimises the one-step error."""
    if np.isnan(values).any() or len(values) < 3:
        return float("nan"), float("nan")

    def run(a):
        s, b, error = values[0], values[1], []
        for i, x in enumerate(values[2:], 2):
            s = a * x + (1 - a) * s
            b = a * s + (1 - a) * b
            p = (2 + a / (1 - a)) * s - (1 + a / (1 - a)) * b
            if i + 1 < len(values):
                error.append((p - values[i + 1]) ** 2)
        return p, float(np.mean(error)) if error else 0.0

    if alpha is None:
        lo, hi, golden = 0.01, 0.99, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
            lo, hi = (lo, b) if run(a)[1] <= run(b)[1] else (a, hi)
        alpha = (lo + hi) / 2
    return float(run(alpha)[0]), float(alpha)


def double_exponentials(values: np.ndarray) -> np.ndarray:
    """Next values of many tracks of equally many samples, one a row: ``double_exponential``, each with its own alpha, side by side."""
    count, n = values.shape
    if n < 3:
        return np.full(count, np.nan)
    columns = np.ascontiguousarray(values.T)

    def run(a):
        rest, odds = 1 - a, a / (1 - a)
        two, one = 2 + odds, 1 + odds
        s, b, error = columns[0], columns[1], np.empty((*a.shape, max(0, n - 3)))
        for i in range(2, n):
            s = a * columns[i] + rest * s
            b = a * s + rest * b
            p = two * s - one * b
            if i + 1 < n:
                error[..., i - 2] = np.square(p - columns[i + 1])
        return p, error.mean(axis=-1) if n > 3 else np.zeros(a.shape)

    lo, hi, golden = np.full(count, 0.01), np.full(count, 0.99), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - golden * (hi - lo), lo + golden * (hi - lo)
        first, second = run(np.stack([a, b]))[1]
        left = first <= second
        lo, hi = np.where(left, lo, a), np.where(left, b, hi)
    return np.where(np.isnan(values).any(axis=1), np.nan, run((lo + hi) / 2)[0])


def next_values(rows: list[np.ndarray], method: str) -> np.ndarray:
    """The prediction behind each row's samples."""
    out, sizes = np.full(len(rows), np.nan), np.array([len(r) for r in rows])
    for n in np.unique(sizes):
        same = np.flatnonzero(sizes == n)
        out[same] = (kalman_nexts if method == "kalman" else double_exponentials)(np.stack([rows[i] for i in same]))
    return out


def predict_next(series: DataFrame, method: str = "kalman", window: int = 11) -> DataFrame:
    """Rounded prediction behind the last ``window`` samples of each track."""

    def kernel(batches):
        for batch in batches:
            for whole in sliced(batch):
                lists = whole.column("s")
                sizes = lists.value_lengths().to_numpy()
                values = lists.flatten().field("u").to_numpy(zero_copy_only=False).astype(float)
                predicted = next_values(np.split(values, np.cumsum(sizes)[:-1]), method)
                yield pa.RecordBatch.from_arrays([whole.column("track").cast(pa.string()), pa.array(whole.column("last").to_numpy() + 1, pa.int32()), pa.array(np.round(predicted), from_pandas=True)], ["track", "frame", "predicted"])

    # no task needs more of a track than its last samples, and Spark drops the others before the shuffle
    last = F.row_number().over(Window.partitionBy("track").orderBy(F.col("frame").desc()))
    recent = series.select("track", "frame", "u").withColumn("_n", last).where(F.col("_n") <= window)
    # many tracks in a batch, a row each
    tracks = recent.groupBy("track").agg(F.max("frame").cast("int").alias("last"), F.array_sort(F.collect_list(F.struct("frame", "_n", F.col("u").cast("double").alias("u")))).alias("s"))
    return tracks.mapInArrow(kernel, "track string, frame int, predicted double")


# image kernels

@functools.lru_cache(256)
def ramp(n: int) -> tuple[np.ndarray, float]:
    """``n`` places around zero and the sum of their squares."""
    x = np.arange(n) - (n - 1) / 2
    return x, max((x * x).sum(), 1e-12)


def flat(image: np.ndarray) -> np.ndarray:
    """Remove the least-squares line of each column, then of each row; of one image or of many."""
    for _ in range(2):
        x, squares = ramp(image.shape[-2])
        slope = (x @ image) / squares
        image = image - (np.add.reduce(image, axis=-2) / len(x))[..., None, :] - x[:, None] * slope[..., None, :]
        image = image.swapaxes(-1, -2)
    return image


def stretch(image: np.ndarray, gamma: float = 1.0) -> np.ndarray:
    """Between 0 and 1, to the power of ``gamma``; of one image or of many."""
    image = image - image.min(axis=(-2, -1), keepdims=True)
    most = image.max(axis=(-2, -1), keepdims=True)
    scaled = image / np.where(most > 0, most, 1)
    return scaled if gamma == 1 else np.where(most > 0, scaled**gamma, image)


def smooth_length(n: int) -> int:
    """The least product of 2, 3 and 5 that is not below ``n``: what Fourier transforms take quickly."""
    while True:
        left = n
        for p in (2, 3, 5):
            while left % p == 0:
                left //= p
        if left == 1:
            return n
        n += 1


def correlations(templates: np.ndarray, scenes: np.ndarray, gamma: float = 1.0) -> list[tuple[float, float, float]]:
    """(row, column, fit) of each template's center in its scene: FFT correlation of flattened patches.

    ``templates`` (n, height, width) are stretched and flattened, ``scenes`` are
    not.  fit is the peak over the mean magnitude; a flat scene gives -1.
    """
    s = flat(stretch(scenes, gamma))
    (th, tw), (sh, sw) = templates.shape[1:], s.shape[1:]
    shape = [smooth_length(th + sh - 1), smooth_length(tw + sw - 1)]
    full = np.fft.irfft2(np.fft.rfft2(s, shape) * np.fft.rfft2(templates[:, ::-1, ::-1], shape), shape)
    top, left = th - 1 - (th - 1) // 2, tw - 1 - (tw - 1) // 2
    same = full[:, top : top + sh, left : left + sw]
    mean = np.abs(same).mean(axis=(1, 2))
    cols, rows = np.divmod(same.swapaxes(1, 2).reshape(len(same), -1).argmax(axis=1), sh)  # first along columns
    fits, r, c = same[np.arange(len(same)), rows, cols] / (mean + 0.001), rows.astype(float), cols.astype(float)
    seen = np.isfinite(mean) & (mean >= 1e-12)
    inner = (seen & (rows >= REACH) & (cols >= REACH) & (rows + REACH < sh) & (cols + REACH < sw)).nonzero()[0]  # the integer peak near an edge
    if len(inner):
        around = np.arange(-REACH, REACH + 1)
        down, across = sub_pixels(same[inner[:, None, None], (rows[inner, None] + around)[:, :, None], (cols[inner, None] + around)[:, None, :]])
        r[inner], c[inner] = r[inner] + down, c[inner] + across
    return list(zip(r.tolist(), c.tolist(), np.where(seen, fits, -1.0).tolist()))


def correlate(template: np.ndarray, scene: np.ndarray, gamma: float = 1.0) -> tuple[float, float, float]:
    """``correlations`` of one template, as it was cut, with one scene."""
    return correlations(flat(stretch(template.astype(float), gamma))[None], scene.astype(float)[None], gamma)[0]


#: Samples on each side of a peak, lines of the fine grid between them, and every which line is looked at first.
REACH, FINE, COARSE = 2, 100, 10


@functools.lru_cache(8)
def fine_spline(reach: int, fine: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places between -reach and reach, the weights of the samples at whole numbers in the spline there, and those in its second derivative at whole numbers."""
    x, at = np.arange(-reach, reach + 1.0), np.linspace(-reach, reach, 2 * reach * fine + 1)
    units = np.eye(len(x))
    return at, np.array([spline_at(x, unit, at) for unit in units]).T, np.array([cubic_coefficients(x, unit) for unit in units]).T


def sub_pixels(patches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the separable spline through each patch (n, 5, 5) is largest on the fine grid, from its middle.

    Only around those places of the coarse lines that come near enough to the
    largest of them: between the lines the spline exceeds them by no more than
    its curvature allows.
    """
    at, weights, bends = fine_spline(REACH, FINE)
    lines = weights[::COARSE]
    rough = lines @ patches @ lines.T
    # second derivatives are linear between whole numbers; across, weights are bounded by their largest sum
    bent = (np.abs(bends @ patches).max(axis=(1, 2)) + np.abs(patches @ bends.T).max(axis=(1, 2))) * np.abs(weights).sum(axis=1).max()
    least = rough.max(axis=(1, 2)) - bent * (COARSE / FINE) ** 2 / 8 - 1e-9 * np.abs(patches).max(axis=(1, 2))
    near = rough >= least[:, None, None]
    spans = []
    for hit in (near.any(axis=2), near.any(axis=1)):
        first = np.maximum(hit.argmax(axis=1) - 1, 0)
        last = np.minimum(hit.shape[1] - hit[:, ::-1].argmax(axis=1), hit.shape[1] - 1)  # one line behind the last
        spans.append((first * COARSE, last * COARSE))
    (top, bottom), (left, right) = spans
    out = np.zeros((2, len(patches)), int)
    order = np.argsort((bottom - top) * (right - left), kind="stable")
    for lo in range(0, len(order), 32):  # those of a like size together
        some = order[lo : lo + 32]
        tall, wide = (bottom - top)[some].max() + 1, (right - left)[some].max() + 1
        i, j = np.minimum(top[some], len(at) - tall), np.minimum(left[some], len(at) - wide)
        best = weights[i[:, None] + np.arange(tall)] @ patches[some] @ weights[j[:, None] + np.arange(wide)].swapaxes(1, 2)
        r, c = np.divmod(best.reshape(len(some), -1).argmax(axis=1), wide)
        out[:, some] = i + r, j + c
    return at[out[0]], at[out[1]]


def match_patches(pairs: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Match templates in scenes: pairs has id, template, scene (arrays), th, tw, sh, sw."""

    def kernel(batches):
        for g in batches:
            out = [correlate(np.asarray(r.template, float).reshape(r.th, r.tw), np.asarray(r.scene, float).reshape(r.sh, r.sw), gamma) for r in g.itertuples()]
            yield pd.DataFrame({"id": g["id"], "row": [x[0] for x in out], "col": [x[1] for x in out], "fit": [x[2] for x in out]})

    return pairs.mapInPandas(kernel, "id long, row double, col double, fit double")


def otsu(image: np.ndarray) -> float:
    h = np.bincount(np.clip((image * 255 + 0.5).astype(int), 0, 255).ravel(), minlength=256).astype(float)
    w, m = np.cumsum(h), np.cumsum(h * np.arange(1, 257))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - w[-1] * m) ** 2 / (w * (w[-1] - w))
    return float(np.nanargmax(np.where(np.isfinite(between), between, -1)) / 255)


def centroid(image: np.ndarray, white: bool = True, gamma: float = 1.0) -> tuple[float, float] | None:
    """Intensity-weighted (row, column) of the largest 4-connected blob; None without one."""
    patch = stretch(flat(stretch(image.astype(float), gamma)))
    level = otsu(patch)
    mask = patch > level + (1 - level) / 2 if white else patch < level / 1.5
    label, seen, best = np.zeros(mask.shape, int), 0, (0, 0)
    for start in zip(*np.nonzero(mask)):
        if label[start]:
            continue
        seen += 1
        label[start], stack, cells = seen, [start], []
        while stack:
            r, c = stack.pop()
            cells.append((r, c))
            for p in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and not label[p]:
                    label[p] = seen
                    stack.append(p)
        rows, cols = zip(*cells)
        best = max(best, ((max(rows) - min(rows) + 1) * (max(cols) - min(cols) + 1), -seen))
    if not seen:
        return None
    weight = np.where(label == -best[1], patch if white else 1 - patch, 0)
    total = weight.sum()
    if total <= 0:
        return None
    return float((weight.sum(axis=1) * np.arange(weight.shape[0])).sum() / total), float((weight.sum(axis=0) * np.arange(weight.shape[1])).sum() / total)


def centroids(patches: DataFrame, white: bool = True, gamma: float = 1.0) -> DataFrame:
    """Blob centers of patches (id, h, w, pix); NULL without a blob."""

    def kernel(batches):
        for g in batches:
            out = [centroid(np.asarray(r.pix, float).reshape(r.h, r.w), white, gamma) or (None, None) for r in g.itertuples()]
            yield pd.DataFrame({"id": g["id"], "row": pd.Series([x[0] for x in out], dtype=float), "col": pd.Series([x[1] for x in out], dtype=float)})

    return patches.select("id", "h", "w", "pix").mapInPandas(kernel, "id long, row double, col double")


def heat_maps(points: DataFrame, side: int = 224, sigma: float = 2.0) -> DataFrame:
    """Render one heat map per point and frame: blurred 5 x 5 squares, largest value 1 (frame, point, u, v)."""
    reach = int(4 * sigma) + 2
    kernel1 = np.exp(-np.arange(-reach, reach + 1.0) ** 2 / (2 * sigma**2))

    def kernel(batches):
        blur = np.convolve(np.ones(5), kernel1 / kernel1.sum(), "full")
        spot = np.outer(blur, blur) / (blur.max() ** 2)
        half = len(blur) // 2
        for g in batches:
            out = []
            for r in g.itertuples():
                image = np.zeros((side, side))
                if r.u == r.u and r.v == r.v:
                    row, col = int(round(r.v)), int(round(r.u))
                    rows, cols = np.arange(row - half, row + half + 1), np.arange(col - half, col + half + 1)
                    a, b = (rows >= 0) & (rows < side), (cols >= 0) & (cols < side)
                    image[np.ix_(rows[a], cols[b])] = spot[np.ix_(a, b)]
                out.append(image.astype(np.float32).ravel())
            yield pd.DataFrame({"frame": g["frame"], "point": g["point"], "heat": out})

    return points.select("frame", "point", "u", "v").mapInPandas(kernel, "frame int, point int, heat array<float>")


def apply_network(images: DataFrame, predict, schema: str) -> DataFrame:
    """Pluggable inference: ``predict`` takes and returns a pandas batch; images stay where they are."""
    return images.mapInPandas(lambda batches: (predict(g) for g in batches), schema)


def apply_networks(images: DataFrame, chosen: DataFrame, networks: dict, schema: str, keys: tuple[str, ...] = ("frame", "cam")) -> DataFrame:
    """Several networks, each on its own images: ``chosen`` (keys, net) names one for every image, or more.

    ``networks`` (net: function of a pandas batch) are a few models that come
    with the tasks' code.  Images without a network, and nets that are not there,
    give no rows.
    """

    def run(batches):
        for g in batches:
            for net, part in g.groupby("net", sort=True):
                if net in networks:
                    yield networks[net](part.reset_index(drop=True))

    return images.join(chosen.select(*keys, "net").distinct(), list(keys)).mapInPandas(run, schema)


def pick_stores(draws: DataFrame, stores: DataFrame, seed: int) -> DataFrame:
    """One store per draw with probability in proportion to its frames (store, n_frames: few rows, broadcast)."""
    total = F.sum("n_frames").over(Window.partitionBy())
    upto = F.sum("n_frames").over(Window.orderBy("store"))
    shares = stores.select("store", ((upto - F.col("n_frames")) / total).alias("lo"), (upto / total).alias("hi"))
    drawn = draws.withColumn("r", F.rand(seed))
    return drawn.join(few(shares), (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).drop("r", "lo", "hi")
