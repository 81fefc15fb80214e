"""Natural quintic smoothing splines of whole tracks, split over chunks of their samples.

The smoothest curve f with sum w (y - f)^2 <= tol, smoothness being the integral
of the squared third derivative, has f''' = sum c_j M_j in quadratic B-splines
over the samples' places, where (G + lambda Q'W^-1 Q) c = Q'y; G is the Gram
matrix of the M_j, Q'y are third divided differences, and f = y - lambda W^-1 Q c.
The system has three diagonals on each side, so between chunks only the
first three unknowns of a chunk couple: every chunk eliminates its other
unknowns for many lambdas at once, a small system a track ties the chunks
together, and what a chunk adds to the misfit is a quadratic form in the
unknowns that tie it.  Grids of lambdas close in on the tolerance for all
tracks at once; the whole search is one lazy plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernels import sliced

#: Unknowns of a chunk, lambdas tried at once, rounds of trying, and the powers of ten (of the samples' own scale) between which lambda is.
CHUNK, TRIED, ROUNDS, POWERS = 48, 17, 4, (-6.0, 13.0)
TIES = 3
#: Chunks that a task holds as Python values at once: each has some 1,600 numbers.
HELD = 128
GAUSS = np.polynomial.legendre.leggauss(3)


def differences(x: np.ndarray) -> np.ndarray:
    """(n - 3, 4): row j times y[j:j + 4] is six times the third divided difference."""
    p = np.stack([x[a : len(x) - 3 + a] for a in range(4)], 1)
    gaps = p[:, :, None] - p[:, None, :]
    gaps[:, range(4), range(4)] = 1
    return 6 / gaps.prod(axis=2)


def basis(x: np.ndarray, i: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(..., 3): M_{i-2}, M_{i-1} and M_i at places t in the intervals from x[i]; zero where there is no such function."""
    n = len(x)
    at = lambda k: x[np.clip(i + k, 0, n - 1)]
    there = lambda j: (j >= 0) & (j <= n - 4)
    h = at(1) - at(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        left = 3 / (at(1) - at(-2)) * (at(1) - t) ** 2 / ((at(1) - at(-1)) * h)
        middle = 3 / (at(2) - at(-1)) * ((t - at(-1)) * (at(1) - t) / ((at(1) - at(-1)) * h) + (at(2) - t) * (t - at(0)) / ((at(2) - at(0)) * h))
        right = 3 / (at(3) - at(0)) * (t - at(0)) ** 2 / ((at(2) - at(0)) * h)
    return np.stack([np.where(there(i - 2 + k), m, 0.0) for k, m in enumerate((left, middle, right))], -1)


def quadrature(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights, exact up to degree five, between lo and hi."""
    half = (hi - lo) / 2
    return (lo + hi)[..., None] / 2 + half[..., None] * GAUSS[0], half[..., None] * GAUSS[1]


def system(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(G, Q'W^-1 Q, rows of Q') of consecutive samples."""
    n, q = len(x), differences(x)
    m = n - 3
    i = np.arange(n - 1)
    t, weight = quadrature(x, x[:-1], x[1:])
    values = basis(x, i[:, None], t)
    local = np.einsum("igk,igl,ig->ikl", values, values, weight)
    gram = np.zeros((m + 4, m + 4))
    for a in range(3):
        for b in range(3):
            np.add.at(gram, (i + a, i + b), local[:, a, b])  # function j stands at j + 2
    wide = np.zeros((m, n))
    wide[np.arange(m)[:, None], np.arange(m)[:, None] + np.arange(4)] = q
    return gram[2 : m + 2, 2 : m + 2], (wide / w) @ wide.T, q


def third(x: np.ndarray, c: np.ndarray, i: np.ndarray, t: np.ndarray) -> np.ndarray:
    """f''' at places t in the intervals from x[i]."""
    j = i[..., None] - 2 + np.arange(3)
    return (basis(x, i, t) * c[np.clip(j, 0, len(c) - 1)]).sum(axis=-1)


def derivatives(x: np.ndarray, g: np.ndarray, c: np.ndarray, lo: int, order: int) -> np.ndarray:
    """f', f'' or f''' at samples lo, lo + 1, ... whose values are ``g``, from Taylor's formula with the integral of f'''.

    Two other samples of the range fix both lower derivatives at each.
    """
    count = len(g)
    at = lo + np.arange(count)
    if order == 3:
        last = np.minimum(at, len(x) - 2)
        return third(x, c, last, x[at])
    near = np.clip(np.arange(count)[:, None] + [-1, 1], 0, count - 1)
    near[0], near[-1] = [1, 2], [count - 2, count - 3]

    def remainder(of: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Integral of (x[to] - t)^2 / 2 f'''(t) from x[of] to x[to], up to two intervals apart."""
        total = np.zeros(len(of))
        step = np.sign(to - of)
        for k in range(2):
            a = of + step * k
            live = np.abs(to - of) > k
            b = np.where(live, a + step, a)
            t, weight = quadrature(x, x[a], x[b])
            first = np.minimum(np.minimum(a, b), len(x) - 2)
            total += np.where(live, ((x[to][:, None] - t) ** 2 / 2 * third(x, c, np.broadcast_to(first[:, None], t.shape), t) * weight).sum(axis=1), 0.0)
        return total

    rows, right = [], []
    for k in range(2):
        to = near[:, k]
        h = x[lo + to] - x[at]
        rows.append(np.stack([h, h * h / 2], 1))
        right.append(g[to] - g - remainder(at, lo + to))
    solved = np.linalg.solve(np.stack(rows, 1), np.stack(right, 1)[:, :, None])[:, :, 0]
    return solved[:, order - 1]


def follows(n: int, chunk: int, size: int) -> bool:
    """Whether a track of n samples has another chunk: one has three unknowns at least."""
    return n - 3 - (chunk + 1) * size >= TIES


class Chunk:
    """Samples ``chunk * size`` and on of a track of n: unknowns of its own and the first of the next chunk."""

    def __init__(self, chunk: int, size: int, n: int, x: np.ndarray, y: np.ndarray, w: np.ndarray):
        self.x, self.y, self.w, self.chunk, self.size = x, y, w, chunk, size
        unknowns = n - 3 - chunk * size  # from here on
        self.next = follows(n, chunk, size)
        self.real = min(unknowns, size + TIES)  # a last chunk takes up to two more than its size
        gram, fit, self.q = system(x, w)
        wide = self.real
        self.g, self.b, self.z = np.zeros((wide, wide)), np.zeros((wide, wide)), np.zeros(wide)
        r = self.real
        self.g[:r, :r], self.b[:r, :r] = gram[:r, :r], fit[:r, :r]
        self.z[:r] = (self.q * np.stack([y[a : len(y) - 3 + a] for a in range(4)], 1)).sum(axis=1)[:r]
        if self.next:  # the next chunk's own
            self.g[size:, size:] = self.b[size:, size:] = 0
            self.z[size:] = 0
        self.head = np.arange(TIES if chunk else 0)
        self.tail = np.arange(size, size + TIES) if self.next else np.arange(0)
        self.inner = np.arange(len(self.head), size if self.next else wide)

    def eliminated(self, lam: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(v, P): inner unknowns are v + P t of the ties t, (S, r): what the ties' equations become; one of each a lambda."""
        a = self.g + lam[:, None, None] * self.b
        ties = np.r_[self.head, self.tail]
        one = np.broadcast_to(self.z[self.inner], (len(lam), len(self.inner)))[:, :, None]
        both = np.concatenate([one, a[:, self.inner[:, None], ties]], 2)
        solved = np.linalg.solve(a[:, self.inner[:, None], self.inner], both) if len(self.inner) else both
        v, p = solved[:, :, 0], -solved[:, :, 1:]
        across = a[:, ties[:, None], self.inner]
        return v, p, a[:, ties[:, None], ties] + across @ p, self.z[ties] - (across @ v[:, :, None])[:, :, 0]

    def misfit_form(self, lam: np.ndarray, v: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(1 + ties) squared, a lambda: the misfit's part is [1, t] M [1, t]'."""
        ties = np.r_[self.head, self.tail]
        whole = np.zeros((len(lam), len(self.z), 1 + len(ties)))
        whole[:, self.inner, 0], whole[:, self.inner, 1:] = v, p
        whole[:, ties, 1 + np.arange(len(ties))] = 1
        return lam[:, None, None] ** 2 * (whole.transpose(0, 2, 1) @ (self.b @ whole))

    def curve(self, lam: float, ties: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the samples, from the first one here; values or derivatives) that this chunk's unknowns determine."""
        v, p, _, _ = self.eliminated(np.array([lam]))
        c = np.zeros(len(self.z))
        c[self.inner] = v[0] + p[0] @ ties
        c[np.r_[self.head, self.tail].astype(int)] = ties
        c = c[: self.real]
        first, last = (TIES if self.chunk else 0), (self.size + TIES if self.next else len(self.x)) - 1
        moved = np.zeros(len(self.x))
        for a in range(4):
            np.add.at(moved, np.arange(len(c)) + a, self.q[: len(c), a] * c)
        g = (self.y - lam * moved / self.w)[first : last + 1]
        return np.arange(first, last + 1), g if order == 0 else derivatives(self.x, g, np.pad(c, (0, max(0, len(self.x) - 3 - len(c)))), first, order)


def chunk_of(row: dict, size: int) -> Chunk:
    s = row["samples"]
    return Chunk(row["chunk"], size, row["n"], *(np.array([r[k] for r in s], float) for k in ("frame", "u", "weight")))


def tied(blocks: list[tuple[np.ndarray, np.ndarray, bool, bool]], lams: int) -> list[np.ndarray]:
    """Each chunk's ties (lambda, its head and tail) from all (S, r, has head, has tail) of a track, in one sweep down and up."""
    count = len(blocks)
    d, e, r = np.zeros((count + 1, lams, TIES, TIES)), np.zeros((count, lams, TIES, TIES)), np.zeros((count + 1, lams, TIES))
    for k, (s, z, head, tail) in enumerate(blocks):
        cut = TIES if head else 0
        if head:
            d[k] += s[:, :TIES, :TIES]
            r[k] += z[:, :TIES]
        if tail:
            d[k + 1] += s[:, cut:, cut:]
            r[k + 1] += z[:, cut:]
        if head and tail:
            e[k] = s[:, :TIES, cut:]
    for k in range(2, count):  # chunk 0 has no head
        gain = np.linalg.solve(d[k - 1].transpose(0, 2, 1), e[k - 1]).transpose(0, 2, 1)  # e' d^-1
        d[k] -= gain @ e[k - 1]
        r[k] -= (gain @ r[k - 1][:, :, None])[:, :, 0]
    t = np.zeros((count + 1, lams, TIES))
    for k in range(count - 1, 0, -1):
        right = r[k] - (e[k] @ t[k + 1][:, :, None])[:, :, 0]
        t[k] = np.linalg.solve(d[k], right[:, :, None])[:, :, 0]
    return [np.concatenate([t[k]] * head + [t[k + 1]] * tail, 1) if head or tail else np.zeros((lams, 0)) for k, (_, _, head, tail) in enumerate(blocks)]


def powers_of(row: dict, size: int) -> np.ndarray:
    """Sums over a chunk's own samples that make the normal equations of the track's parabola, in frames from -1 to 1."""
    own = row["samples"][: size if follows(row["n"], row["chunk"], size) else None]
    t, u, w = middle(row, [r["frame"] for r in own]), np.array([r["u"] for r in own]), np.array([r["weight"] for r in own])
    return np.array([(w * t**k).sum() for k in range(5)] + [(w * u * t**k).sum() for k in range(3)])


def middle(row: dict, frames: list[int]) -> np.ndarray:
    return (2 * np.array(frames, float) - row["lowest"] - row["highest"]) / (row["highest"] - row["lowest"])


def parabola(row: dict, frames: list[int], k: list[float], order: int) -> np.ndarray:
    t, rate = middle(row, frames), 2 / (row["highest"] - row["lowest"])
    return (k[0] + k[1] * t + k[2] * t * t, (k[1] + 2 * k[2] * t) * rate, np.full(len(t), 2 * k[2] * rate * rate), np.zeros(len(t)))[order]


def chunked(valid: DataFrame, size: int) -> DataFrame:
    """(track, chunk, n, scale, tol, lowest, highest, samples) of valid samples in order, each chunk with those that the next one's first unknowns need."""
    segment = F.floor(F.col("frame") / 1024)
    cut = valid.groupBy("track", segment.alias("seg")).agg(F.array_sort(F.collect_list(F.struct("frame", "u", "weight"))).alias("s"))
    upto = Window.partitionBy("track").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.select("track", "seg", F.size("s").alias("m")).select("track", "seg", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("before"))
    stats = valid.groupBy("track").agg(F.count("*").alias("n"), F.max("tol").alias("tol"), F.min("frame").alias("lowest"), F.max("frame").alias("highest"), (F.avg("weight") * F.pow((F.max("frame") - F.min("frame")) / (F.count("*") - 1), 5) / 100).alias("scale"))
    counted = before.join(stats, "track")  # a row a segment
    rows = cut.join(counted, ["track", "seg"]).select("track", "n", "tol", "scale", "lowest", "highest", "before", F.posexplode("s").alias("i", "s"))
    index = F.col("before") + F.col("i")
    own = F.floor(index / size)
    chunks = F.filter(F.array(own, F.when((index % size < 2 * TIES) & (own > 0), own - 1)), lambda k: k.isNotNull() & ((k == 0) | (k * size + TIES <= F.col("n") - 3)))
    dealt = rows.select("track", "n", "tol", "scale", "lowest", "highest", "s", F.explode(chunks).alias("chunk"))
    return dealt.groupBy("track", F.col("chunk").cast("int").alias("chunk")).agg(F.max("n").cast("int").alias("n"), F.max("tol").alias("tol"), F.max("scale").alias("scale"), F.max("lowest").alias("lowest"), F.max("highest").alias("highest"), F.array_sort(F.collect_list("s")).alias("samples"))


def smoothing_splines(series: DataFrame, order: int = 0, least: int = 6, size: int = CHUNK) -> DataFrame:
    """Smoothed values, or derivatives up to the third, of tracks (track, frame, u, weight, tol): track, frame, smooth.

    Rows without a value or with a weight of zero (or null) are missing and stay
    so.  Tracks of fewer than ``least`` valid samples keep their values, and have
    no derivatives.  A tolerance of zero or less (or none) interpolates; one that
    the least-squares parabola meets gives the parabola.  Frames of a track are
    different from each other.
    """
    if not 0 <= order <= 3:
        raise ValueError("derivatives go up to the third")
    kind = series.schema["track"].dataType.simpleString()
    rows = series.select("track", F.col("frame").cast("int").alias("frame"), F.col("u").cast("double").alias("u"), F.col("weight").cast("double").alias("weight"), F.col("tol").cast("double").alias("tol"))
    valid = rows.where("u IS NOT NULL AND NOT isnan(u) AND weight <> 0")
    chunks = chunked(valid, size).where(F.col("n") >= max(least, 4))
    tracks = valid.groupBy("track").agg(F.count("*").alias("n")).where(F.col("n") >= max(least, 4))
    per_chunk = tracks.select("track", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.col("n") - 3 - TIES) / size).cast("int")))).alias("chunk"))
    arrow = to_arrow_type(chunks.schema["track"].dataType)

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, HELD)):
            out = []
            for row in batch.to_pylist():
                powers = np.linspace(row["lo"], row["hi"], TRIED) if row["hi"] > row["lo"] else np.array([min(row["lo"], POWERS[1])])
                lam = row["scale"] * 10.0**powers if row["tol"] is not None and row["tol"] > 0 else np.zeros(len(powers))
                c = chunk_of(row, size)
                v, p, s, r = c.eliminated(lam)
                out.append((row["track"], row["chunk"], row["tol"], len(lam), len(c.head) > 0, c.next, *(x.ravel().tolist() for x in (powers, lam, s, r, c.misfit_form(lam, v, p), powers_of(row, size))), row["lo"]))
            types = [arrow, pa.int32(), pa.float64(), pa.int32(), pa.bool_(), pa.bool_()] + [pa.list_(pa.float64())] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["track", "chunk", "tol", "k", "head", "tail", "powers", "lams", "s", "r", "form", "sums", "at"])

    reduced_type = f"track {kind}, chunk int, tol double, k int, head boolean, tail boolean, powers array<double>, lams array<double>, s array<double>, r array<double>, form array<double>, sums array<double>, at double"

    def whole_tracks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        held: list[dict] = []
        for batch in (part for whole in batches for part in sliced(whole, HELD)):
            for row in batch.to_pylist():
                if held and held[0]["track"] != row["track"]:
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def ties_of(held: list[dict]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        k = held[0]["k"]
        widths = [TIES * (row["head"] + row["tail"]) for row in held]
        blocks = [(np.reshape(row["s"], (k, m, m)), np.reshape(row["r"], (k, m)), row["head"], row["tail"]) for row, m in zip(held, widths)]
        return tied(blocks, k), [np.reshape(row["form"], (k, 1 + m, 1 + m)) for row, m in zip(held, widths)]

    def closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The neighbouring powers between which the misfit passes the tolerance, and the power there by interpolation."""
        for held in whole_tracks(batches):
            ties, forms = ties_of(held)
            missed = np.zeros(held[0]["k"])
            for t, form in zip(ties, forms):
                one = np.concatenate([np.ones((len(t), 1)), t], 1)
                missed += np.einsum("ki,kij,kj->k", one, form, one)
            powers, tol = np.array(held[0]["powers"]), held[0]["tol"] or 0.0
            over = np.flatnonzero(missed > tol)
            i = int(over[0]) if len(over) else len(powers)
            if tol <= 0 or i == 0:
                lo = hi = at = powers[0]
            elif i == len(powers):
                lo = hi = at = np.inf if powers[-1] == POWERS[1] else powers[-1]
            else:
                lo, hi = powers[i - 1], powers[i]
                a, b = np.log(max(missed[i - 1], 1e-300)), np.log(missed[i])
                at = lo + (hi - lo) * min(1.0, max(0.0, (np.log(tol) - a) / (b - a))) if b > a else lo
            yield pa.RecordBatch.from_arrays([pa.array([held[0]["track"]], arrow), *(pa.array([float(x)]) for x in (lo, hi, at))], ["track", "lo", "hi", "at"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in whole_tracks(batches):
            ties, _ = ties_of(held)
            lams = [r["lams"][0] for r in held]
            if held[0]["at"] == np.inf:  # the parabola
                sums = np.sum([r["sums"] for r in held], axis=0)
                k = np.linalg.solve(np.array([[sums[a + b] for b in range(3)] for a in range(3)]), sums[5:])
                ties, lams = [k[None]] * len(held), [np.inf] * len(held)
            yield pa.RecordBatch.from_arrays([pa.array([r["track"] for r in held], arrow), pa.array([r["chunk"] for r in held], pa.int32()), pa.array(lams), pa.array([t[0].tolist() for t in ties], pa.list_(pa.float64()))], ["track", "chunk", "lam", "ties"])

    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, HELD)):
            out = []
            for row in batch.to_pylist():
                if row["lam"] == np.inf:
                    frames = [r["frame"] for r in row["samples"]][: size if follows(row["n"], row["chunk"], size) else None]
                    out += zip([row["track"]] * len(frames), frames, parabola(row, frames, row["ties"], order).tolist())
                    continue
                at, values = chunk_of(row, size).curve(row["lam"], np.array(row["ties"]), order)
                out += [(row["track"], row["samples"][i]["frame"], float(v)) for i, v in zip(at.tolist(), values)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((arrow, pa.int32(), pa.float64()))], ["track", "frame", "smooth"])

    def tried(powers: DataFrame) -> DataFrame:
        """Reduced chunks for (track, lo, hi); chunks keep their place, only their powers come to them."""
        return chunks.join(per_chunk.join(powers, "track"), ["track", "chunk"]).select("track", "chunk", "n", "tol", "scale", "samples", "lowest", "highest", "lo", "hi").mapInArrow(reduce_, reduced_type).repartition("track").sortWithinPartitions("track", "chunk")

    powers = tracks.select("track", F.lit(POWERS[0]).alias("lo"), F.lit(POWERS[1]).alias("hi"))
    for _ in range(ROUNDS):
        found = tried(powers).mapInArrow(closer, f"track {kind}, lo double, hi double, at double")
        powers = found.select("track", "lo", "hi")
    final = tried(found.select("track", F.col("at").alias("lo"), F.col("at").alias("hi"))).mapInArrow(ends, f"track {kind}, chunk int, lam double, ties array<double>")
    smooth = chunks.join(final, ["track", "chunk"]).select("track", "chunk", "n", "samples", "lowest", "highest", "lam", "ties").mapInArrow(curves, f"track {kind}, frame int, smooth double")
    short = rows.join(tracks.select("track", F.lit(1).alias("_long")), "track", "left").join(smooth, ["track", "frame"], "left")
    alone = F.when(F.col("weight") != 0, F.col("u")) if order == 0 else F.lit(None).cast("double")
    return short.select("track", "frame", F.when(F.col("_long").isNull(), alone).otherwise(F.col("smooth")).alias("smooth"))


def dense(x: np.ndarray, y: np.ndarray, w: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """(values, coefficients of f''') of one curve by a dense solve, for small ones and for tests."""
    gram, fit, q = system(x, w)
    z = (q * np.stack([y[a : len(y) - 3 + a] for a in range(4)], 1)).sum(axis=1)
    c = np.linalg.solve(gram + lam * fit, z)
    moved = np.zeros(len(x))
    for a in range(4):
        np.add.at(moved, np.arange(len(c)) + a, q[:, a] * c)
    return y - lam * moved / w, c
