"""Filters along a track as linear recurrences, without walking a track in one task.

One step of a linear filter is an affine map of its state, and affine maps
compose, so a track is cut into segments of frames: every segment's samples
become one map (small matrices), a prefix over the few maps of a track gives the
state with which each segment begins, and the segments are then run from there,
all at once.  A task works on the segments of a batch side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .kernels import double_exponentials, sliced

#: Frames of a segment.
SEGMENT = 256


@dataclass(frozen=True)
class Recurrence:
    """state <- advance(t) state + gain(t) x for the sample number t of a track; it begins behind ``skip`` samples with ``first`` of the ``head`` ones."""

    size: int
    head: int
    skip: int

    def maps(self, t: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def first(self, head: list[float], alpha: float) -> np.ndarray:
        raise NotImplementedError

    def value(self, state: np.ndarray, x: np.ndarray, t: np.ndarray, alpha: np.ndarray) -> np.ndarray:
        raise NotImplementedError


class Kalman(Recurrence):
    """The constant-acceleration filter; its gains do not depend on the samples and settle after a few dozen."""

    SETTLED = 128

    def __init__(self):
        super().__init__(3, 3, 0)
        # position takes twice the acceleration and no velocity: a fixed value: the model matrix to be matched
        step, cov, gains = np.array([[1.0, 0, 2], [0, 1, 1], [0, 0, 1]]), 0.01 * np.eye(3), []
        for _ in range(self.SETTLED):
            cov = step @ cov @ step.T + np.eye(3)
            gain = cov[:, 0] / (cov[0, 0] + 0.1)
            cov = cov - np.outer(gain, cov[0])
            gains.append(gain)
        gains = np.array(gains)
        object.__setattr__(self, "step", step)
        object.__setattr__(self, "gains", gains)
        object.__setattr__(self, "advances", np.array([(np.eye(3) - np.outer(g, [1, 0, 0])) @ step for g in gains]))

    def maps(self, t, alpha):
        t = np.minimum(t, self.SETTLED - 1)
        return self.advances[t], self.gains[t]

    def first(self, head, alpha):
        return np.array([head[0], head[1] - head[0], head[2] - 2 * head[1] + head[0]])

    def value(self, state, x, t, alpha):
        return np.where(t < 3, x, state @ self.step[0])  # fewer than four samples repeat the last


class DoubleExponential(Recurrence):
    """Single and doubly smoothed values; the first two samples begin them."""

    def __init__(self):
        super().__init__(2, 2, 2)

    def maps(self, t, alpha):
        zero = np.zeros_like(alpha)
        return np.stack([np.stack([1 - alpha, zero], 1), np.stack([alpha * (1 - alpha), 1 - alpha], 1)], 1), np.stack([alpha, alpha * alpha], 1)

    def first(self, head, alpha):
        return np.array([head[0], head[1]])

    def value(self, state, x, t, alpha):
        odds = alpha / (1 - alpha)
        return np.where(t < 2, np.nan, (2 + odds) * state[:, 0] - (1 + odds) * state[:, 1])


def segments(samples: DataFrame, size: int) -> DataFrame:
    """(key columns, seg, before, n, samples): the samples of ``size`` frames in order, with how many the track has before."""
    keys = [c for c in samples.columns if c not in ("frame", "u")]
    cut = samples.where("u IS NOT NULL").groupBy(*keys, F.floor(F.col("frame") / size).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("frame", "u"))).alias("samples"))
    counts = cut.select(*keys, "seg", F.size("samples").alias("n"))  # a row a segment
    upto = Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(counts.select(*keys, "seg", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before")), [*keys, "seg"])


def matrix(batch: pa.RecordBatch, name: str = "samples") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frames, values, lengths) of a batch's segments, one row each, filled up at the end."""
    lists = batch.column(name)
    sizes = lists.value_lengths().to_numpy()
    flat = lists.flatten()
    frames, values = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    wide = np.zeros((2, len(sizes), int(sizes.max(initial=0))))
    at = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide[0][at], wide[1][at] = frames, values
    return wide[0].astype(np.int64), wide[1], sizes


def along(samples: DataFrame, recurrence: Recurrence, size: int = SEGMENT) -> DataFrame:
    """The value that ``recurrence`` predicts behind every sample: key columns, frame, u, predicted.

    ``samples`` has frame, u, and any key columns (track, and alpha for a filter
    that takes one).  Missing samples are passed over.
    """
    keys = [c for c in samples.columns if c not in ("frame", "u")]
    types = {c: samples.schema[c].dataType.simpleString() for c in keys}
    alphas = lambda batch: batch.column("alpha").to_numpy(zero_copy_only=False).astype(float) if "alpha" in keys else np.zeros(batch.num_rows)
    cut = segments(samples, size)
    columns, kinds = [*keys, "seg", "before"], [to_arrow_type(cut.schema[c].dataType) for c in (*keys, "seg")]
    schema = ", ".join(f"`{c}` {types[c]}" for c in keys)

    def runs(batch: pa.RecordBatch, state: np.ndarray | None):
        """(maps, vectors) of the segments, and with states the values behind every sample."""
        frames, values, sizes = matrix(batch)
        before, alpha = batch.column("before").to_numpy().astype(np.int64), alphas(batch)
        whole, add = np.tile(np.eye(recurrence.size), (len(sizes), 1, 1)), np.zeros((len(sizes), recurrence.size))
        out = np.full(values.shape, np.nan)
        for i in range(values.shape[1]):
            t = before + i
            live = (i < sizes) & (t >= recurrence.skip)
            advance, gain = recurrence.maps(t, alpha)
            if state is None:
                whole = np.where(live[:, None, None], advance @ whole, whole)
                add = np.where(live[:, None], np.einsum("sij,sj->si", advance, add) + gain * values[:, i, None], add)
            else:
                state = np.where(live[:, None], np.einsum("sij,sj->si", advance, state) + gain * values[:, i, None], state)
                out[:, i] = recurrence.value(state, values[:, i], t, alpha)
        return whole, add, frames, values, sizes, out

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for given in batches for part in sliced(given)):
            whole, add, _, values, sizes, _ = runs(batch, None)
            heads = [row[: min(n, recurrence.head)].tolist() for row, n in zip(values, sizes)]
            rows = [pa.array(list(x.reshape(len(x), -1)), pa.list_(pa.float64())) for x in (whole, add)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "seg")), *rows, pa.array(heads, pa.list_(pa.float64()))], [*keys, "seg", "map", "add", "head"])

    def prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state before each segment; rows come in order, a row a segment."""
        key, state, waiting, head = None, None, [], []
        done: list[tuple] = []

        def settle():
            nonlocal state, waiting
            alpha = dict(zip(keys, key)).get("alpha", 0.0)
            # a track that ends before its head is whole has a state that no value is taken from
            state = recurrence.first((head + [head[-1]] * recurrence.head)[: recurrence.head], alpha)
            for seg, whole, add in waiting:
                done.append((*key, seg, state.tolist()))
                state = whole @ state + add
            waiting = []

        for batch in (part for given in batches for part in sliced(given)):
            table = batch.to_pydict()
            for row in range(batch.num_rows):
                now = tuple(table[c][row] for c in keys)
                if now != key:
                    if waiting:
                        settle()
                    key, state, waiting, head = now, None, [], []
                whole = np.reshape(table["map"][row], (recurrence.size, recurrence.size))
                if state is not None:
                    done.append((*key, table["seg"][row], state.tolist()))
                    state = whole @ state + np.array(table["add"][row])
                    continue
                head = (head + table["head"][row])[: recurrence.head]
                waiting.append((table["seg"][row], whole, np.array(table["add"][row])))
                if len(head) == recurrence.head:
                    settle()
            yield from handed(done)
            done = []
        if waiting:
            settle()
        yield from handed(done)

    def handed(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        if rows:
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.list_(pa.float64()))], [*keys, "seg", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for given in batches for part in sliced(given)):
            state = np.stack(batch.column("state").to_numpy(zero_copy_only=False))
            _, _, frames, values, sizes, out = runs(batch, state)
            held = np.arange(values.shape[1]) < sizes[:, None]
            rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            found = pa.array(out[held], from_pandas=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keys), pa.array(frames[held], pa.int32()), pa.array(values[held]), found], [*keys, "frame", "u", "predicted"])

    seg = cut.schema["seg"].dataType.simpleString()
    maps = cut.select(*columns, "samples").mapInArrow(compose, f"{schema}, seg {seg}, map array<double>, add array<double>, head array<double>")
    states = maps.repartition(*keys).sortWithinPartitions(*keys, "seg").mapInArrow(prefix, f"{schema}, seg {seg}, state array<double>")
    return cut.join(states, [*keys, "seg"]).select(*columns, "samples", "state").mapInArrow(run, f"{schema}, frame int, u double, predicted double")


def kalman_along(series: DataFrame, size: int = SEGMENT) -> DataFrame:
    """What the filter predicts behind every sample of tracks (track, frame, u); up to three samples repeat the last."""
    return along(series.select("track", "frame", F.col("u").cast("double").alias("u")), Kalman(), size)


def double_exponential_along(series: DataFrame, alpha: float | DataFrame = 0.5, size: int = SEGMENT) -> DataFrame:
    """What double exponential smoothing predicts behind every sample (NULL behind the first two); ``alpha`` is one or a table (track, alpha), which may hold several a track."""
    samples = series.select("track", "frame", F.col("u").cast("double").alias("u"))
    samples = samples.join(alpha, "track") if isinstance(alpha, DataFrame) else samples.withColumn("alpha", F.lit(float(alpha)))
    return along(samples.select("track", "alpha", "frame", "u"), DoubleExponential(), size)


def step_errors(series: DataFrame, alpha: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(track, alpha, error): the mean squared error of the prediction of the next sample."""
    found = double_exponential_along(series, alpha, size)
    # only a prediction and the sample behind it meet: neighbours in one window a track and alpha
    order = Window.partitionBy("track", "alpha").orderBy("frame")
    missed = found.select("track", "alpha", (F.lag("predicted").over(order) - F.col("u")).alias("e"))
    return missed.groupBy("track", "alpha").agg(F.avg(F.col("e") * F.col("e")).alias("error"))


def best_alpha(series: DataFrame, rounds: int = 3, points: int = 9, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(track, alpha, error): the alpha of the least error, for all tracks at once by grids around the best one before."""
    tracks = series.where("u IS NOT NULL").groupBy("track").agg(F.count("*").alias("n")).where("n >= 4").select("track", F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    best = None
    for _ in range(rounds):
        step = (F.col("hi") - F.col("lo")) / (points - 1)
        grid = tracks.select("track", step.alias("step"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.round(F.col("lo") + i * step, 12))).alias("alpha"))
        errors = step_errors(series, grid.select("track", "alpha"))
        best = errors.groupBy("track").agg(F.min(F.struct("error", F.abs(F.col("alpha") - 0.5).alias("far"), "alpha")).alias("b")).select("track", "b.alpha", "b.error")
        widths = tracks.select("track", step.alias("step"))
        tracks = best.join(widths, "track").select("track", F.greatest(F.lit(low), F.col("alpha") - F.col("step")).alias("lo"), F.least(F.lit(high), F.col("alpha") + F.col("step")).alias("hi"))
    return best


def carry_poses(series: DataFrame, window: int = 36) -> DataFrame:
    """Poses (track, frame, u) with missing and zero ones filled: track, frame, u, pose.

    Up to frame ``window`` a missing pose takes that of the frame before, later
    ones what double exponential smoothing makes of the last ``window`` frames,
    filled ones among them; it stays missing while any of those is.  Frames run
    without holes.  What follows ``window`` frames that are there does not depend
    on what comes before them, so a track is cut at such places and its pieces
    are filled apart, each with the frames it looks back on.
    """
    order = Window.partitionBy("track").orderBy("frame")
    there = F.nullif(F.col("u").cast("double"), F.lit(0.0))
    seen = series.select("track", F.col("frame").cast("int").alias("frame"), "u", there.alias("x"))
    back = F.count("x").over(order.rangeBetween(-window, -1))
    # a piece begins at a missing pose behind ``window`` present ones
    starts = F.when(F.col("x").isNull() & (back == window), 1).otherwise(0)
    cut = seen.withColumn("start", starts).withColumn("piece", F.sum("start").over(order))
    gaps = F.max(F.col("x").isNull().cast("int")).over(Window.partitionBy("track", "piece"))
    pieces = cut.withColumn("gaps", gaps)
    # the frames before a piece are sent to it too
    last = pieces.where("start = 1").select("track", F.col("piece").alias("to"), F.col("frame").alias("first"))
    near = pieces.where("x IS NOT NULL").alias("p").join(last.alias("l"), F.expr(f"p.track = l.track AND p.piece = l.to - 1 AND p.frame >= l.first - {window}")).select("p.track", F.col("l.to").alias("piece"), "p.frame", "p.u", "p.x", F.lit(False).alias("own"))
    sent = pieces.where("gaps = 1").select("track", "piece", "frame", "u", "x", F.lit(True).alias("own")).unionByName(near)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                lists = part.column("s")
                sizes, flat = lists.value_lengths().to_numpy(), lists.flatten()
                ends = np.cumsum(sizes)
                frames, x = flat.field("frame").to_numpy(), flat.field("x").to_numpy(zero_copy_only=False).astype(float)
                own, starts = flat.field("own").to_numpy(zero_copy_only=False), ends - sizes
                wanted = [[int(i) for i in np.flatnonzero(np.isnan(x[a:b])) + a] for a, b in zip(starts, ends)]
                # the missing ones of a piece need each other in order; pieces go side by side
                for turn in range(max(map(len, wanted), default=0)):
                    look = []
                    for a, missing in zip(starts, wanted):
                        if turn < len(missing):
                            i = missing[turn]
                            if frames[i] > window:
                                if i - a >= window and frames[i] - frames[i - window] == window:
                                    look.append(i)
                            elif i > a and frames[i] - frames[i - 1] == 1:
                                x[i] = x[i - 1]
                    if look:
                        at = np.array(look)
                        x[at] = double_exponentials(x[at[:, None] + np.arange(-window, 0)])
                rows = np.repeat(np.arange(len(sizes)), sizes)[own]
                yield pa.RecordBatch.from_arrays([part.column("track").take(pa.array(rows)), flat.field("frame").filter(pa.array(own)), flat.field("u").filter(pa.array(own)), pa.array(x[own])], ["track", "frame", "u", "pose"])

    kind = series.schema["track"].dataType.simpleString()
    each = sent.groupBy("track", "piece").agg(F.array_sort(F.collect_list(F.struct("frame", F.col("u").cast("double").alias("u"), "x", "own"))).alias("s"))
    filled = each.select("track", "s").mapInArrow(fill, f"track {kind}, frame int, u double, pose double")
    whole = pieces.where("gaps = 0").select("track", "frame", F.col("u").cast("double").alias("u"), F.col("x").alias("pose"))
    return whole.unionByName(filled.select("track", "frame", "u", none_for_nan("pose").alias("pose")))


def none_for_nan(name: str) -> Column:
    return F.when(~F.isnan(name), F.col(name))
