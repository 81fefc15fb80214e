"""Multi-crop detection: heat maps of several scales vote for a crop, a network looks at it again.

Heat maps are tiles (``blocks``) with the keys frame and scale; their last
channel is a mask.  Votes count heat above the threshold in every block of a
stride grid: each tile makes a summed-area table of its own pixels, looks its
part of a block up in it, and the parts are added, so that no block needs its
neighbours' pixels and an image may be larger than a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import PLACE, TILE, arrays, around, centers, handfuls, keys_of, placed, schema_of
from .resample import resize


def gate(heat: DataFrame, least: float, share: float = 0.02) -> DataFrame:
    """Heat without the image's borders, and zero where the last channel does not exceed ``least``."""
    keys = keys_of(heat)

    def kept(batches):
        for batch in handfuls(batches):
            rows, places, parts = [], [], []
            for i, p, pix in arrays(batch):
                d = int(share * max(p["height"], p["width"]) + 0.5)
                r, c = p["row0"] + np.arange(p["h"]), p["col0"] + np.arange(p["w"])
                inside = ((r >= d) & (r < p["height"] - d - 1))[:, None] & ((c >= d) & (c < p["width"] - d - 1))
                pix = pix * inside[:, :, None]
                rows.append(i), places.append(p), parts.append(pix * (pix[:, :, -1:] > least))
            yield placed(batch.select(keys), rows, places, parts)

    return heat.select(*keys, *PLACE, "pix").mapInArrow(kept, schema_of(heat, keys, TILE))


def best_scales(gated: DataFrame) -> DataFrame:
    """(frame, best, pick): the scale of the largest sum of channel peaks (the mask aside), and each channel's own best; ties go to the smaller."""

    def peaks(batches):
        for batch in handfuls(batches):
            found = [(i, k, float(x)) for i, _, pix in arrays(batch) for k, x in enumerate(pix.max(axis=(0, 1)))]
            last = {i: p["channels"] - 1 for i, p, _ in arrays(batch)}
            named = batch.select(["frame", "scale"]).take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*named.columns, pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found]), pa.array([x[1] == last[x[0]] for x in found])], ["frame", "scale", "channel", "peak", "mask"])

    rows = gated.mapInArrow(peaks, schema_of(gated, ["frame", "scale"], "channel int, peak double, mask boolean"))
    by = rows.groupBy("frame", "scale", "channel").agg(F.max("peak").alias("peak"), F.bool_or("mask").alias("mask"))
    total = by.groupBy("frame", "scale").agg(F.round(F.sum(F.when(~F.col("mask"), F.col("peak")).otherwise(0.0)), 9).alias("total"))
    best = total.groupBy("frame").agg(F.min(F.struct((-F.col("total")).alias("t"), "scale"))["scale"].alias("best"))
    own = by.groupBy("frame", "channel").agg(F.min(F.struct((-F.col("peak")).alias("p"), "scale"))["scale"].alias("scale"))
    pick = own.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("channel", "scale")))["scale"].alias("pick"))  # one entry a channel
    return best.join(pick, "frame")


def mosaic_hits(gated: DataFrame, scales: DataFrame, least: float) -> DataFrame:
    """(frame, hits): pixels where the channels, each from its best scale, add up to more than ``least``."""

    def parts(batches):
        for batch in handfuls(batches):
            rows, places, out = [], [], []
            scale, pick = batch.column("scale").to_pylist(), batch.column("pick").to_pylist()
            for i, p, pix in arrays(batch):
                own = [k for k, s in enumerate(pick[i]) if s == scale[i]]
                if own:
                    rows.append(i), places.append(p | {"channels": 1}), out.append(pix[:, :, own].sum(axis=2))
            yield placed(batch.select(["frame"]), rows, places, out)

    def count(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        hits = int((sum(pix for _, _, pix in arrays(batch)) > least).sum())
        return pa.table({"frame": batch.column("frame")[:1], "hits": pa.array([hits], pa.int64())})

    picked = gated.join(scales.select("frame", "pick"), "frame")
    planes = picked.select("frame", "scale", "pick", *PLACE, "pix").mapInArrow(parts, schema_of(gated, ["frame"], TILE))
    counted = planes.groupBy("frame", "row0", "col0").applyInArrow(count, schema_of(gated, ["frame"], "hits long"))
    return counted.groupBy("frame").agg(F.sum("hits").alias("hits"))


def window_counts(marked: np.ndarray, row0: int, col0: int, rows: np.ndarray, cols: np.ndarray, block: int) -> np.ndarray:
    """(rows, cols, channels) marks of this tile inside blocks around centers (from 1), by look-ups in a summed-area table."""
    table = np.zeros((marked.shape[0] + 1, marked.shape[1] + 1, marked.shape[2]), np.int64)
    table[1:, 1:] = marked.cumsum(axis=0).cumsum(axis=1)
    steps = around(block)
    # a block of an even side is two stretches, one on each side of its center
    stretches = [(int(s[0]), int(s[-1])) for s in ([steps] if block % 2 else [steps[: block // 2], steps[block // 2 :]])]
    edge = lambda at, zero, size: np.clip(at - 1 - zero, 0, size)
    total = np.zeros((len(rows), len(cols), marked.shape[2]), np.int64)
    for top, below in stretches:
        a, b = edge(rows + top, row0, marked.shape[0]), edge(rows + below + 1, row0, marked.shape[0])
        for left, right in stretches:
            c, d = edge(cols + left, col0, marked.shape[1]), edge(cols + right + 1, col0, marked.shape[1])
            total += table[np.ix_(b, d)] - table[np.ix_(a, d)] - table[np.ix_(b, c)] + table[np.ix_(a, c)]
    return total


def votes(gated: DataFrame, scales: DataFrame, least: float, block: int, stride: int) -> DataFrame:
    """(frame, row, col, channels): how many channels of the best scale have heat in the block around each center that sees any."""

    def look(batches):
        for batch in handfuls(batches):
            found = []
            for i, p, pix in arrays(batch):
                half = int(max(around(block)))
                near = lambda side, first, n: np.array([x for x in centers(side, block, stride) if first - half <= x - 1 < first + n + half + 1], int)
                rows, cols = near(p["height"], p["row0"], p["h"]), near(p["width"], p["col0"], p["w"])
                seen = window_counts(pix[:, :, :-1] > least, p["row0"], p["col0"], rows, cols, block)
                found += [(i, int(rows[a]), int(cols[b]), int(k)) for a, b, k in zip(*np.nonzero(seen))]
            named = batch.select(["frame"]).take(pa.array([x[0] for x in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*named.columns, *[pa.array([x[j] for x in found], pa.int32()) for j in (1, 2, 3)]], ["frame", "row", "col", "channel"])

    chosen = gated.join(scales.select("frame", F.col("best").alias("scale")), ["frame", "scale"])
    seen = chosen.select("frame", *PLACE, "pix").mapInArrow(look, schema_of(gated, ["frame"], "row int, col int, channel int"))
    return seen.distinct().groupBy("frame", "row", "col").agg(F.count("*").alias("channels"))


def away(x: Column) -> Column:
    """Rounded, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def regions(heat: DataFrame, least: float, block: int, stride: int | None = None) -> DataFrame:
    """The crop of every frame: frame, best, hits, row, col (its center), x0, x1, y0, y1 (from 1, both ends inside).

    The center is the mean of all blocks with the most channels, of all centers
    if none has any; the crop is 1.5 blocks wide and shifted into the image.  A
    frame with fewer than two hits has no crop (NULL).  Heat is read four times:
    write what a network made before.
    """
    stride = stride or max(1, int(block / 4 + 0.5))
    gated = gate(heat, least)
    scales = best_scales(gated)
    seen = votes(gated, scales, least, block, stride)
    means = seen.groupBy("frame", "channels").agg(F.avg("row").alias("row"), F.avg("col").alias("col"))
    top = means.groupBy("frame").agg(F.max(F.struct("channels", "row", "col")).alias("top")).select("frame", "top.row", "top.col")
    sizes = heat.groupBy("frame").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    found = sizes.join(scales, "frame").join(mosaic_hits(gated, scales, least), "frame", "left").join(top, "frame", "left")
    steps = around(block)
    first, spare = 1 - int(steps[0]), int(steps[-1])

    def middle(side: str) -> Column:
        last = F.col(side) - spare
        return F.when(last >= first, first + stride * F.floor((last - first) / stride) / 2).otherwise((F.col(side) + 1) / 2)

    low, high = (int(np.sign(x) * np.floor(abs(x) + 0.5)) for x in (-0.75 * block, 1.5 * (block / 2 - 1)))
    enough = F.coalesce("hits", F.lit(0)) >= 2
    placed_ = found.select("frame", "best", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), "height", "width", *[F.when(enough, away(F.coalesce(c, middle(side)))).cast("int").alias(c) for c, side in (("row", "height"), ("col", "width"))])

    def span(center: str, side: str) -> tuple[Column, Column]:
        a, b = F.col(center) + low, F.col(center) + high
        shift = F.greatest(F.lit(0), 1 - a)
        a, b = a + shift, b + shift
        back = F.greatest(F.lit(0), b - F.col(side))
        there = F.col(center).isNotNull()  # greatest() passes over NULL
        return F.when(there, F.greatest(F.lit(1), a - back)).cast("int"), F.when(there, b - back).cast("int")

    (x0, x1), (y0, y1) = span("col", "width"), span("row", "height")
    return placed_.select("frame", "best", "hits", "row", "col", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"))


def detections(images: DataFrame, crops: DataFrame, predict: Callable[[np.ndarray], np.ndarray], points: int, least: float, side: int | None = 224) -> DataFrame:
    """(frame, channel, u, v, quality): the network's peaks in each frame's crop, in pixels of the image.

    ``images`` are tiles with the key frame.  The crop is resized to ``side``
    (None: as it is) for ``predict``, which returns a heat map a point.  Without a
    peak above ``least``, or without a crop, a point is at (0, 0) with quality 0;
    of equal peaks the first by column, then row, counts.
    """
    here = crops.where("x0 IS NOT NULL").select("frame", "x0", "x1", "y0", "y1")

    def inside(batches):
        for batch in handfuls(batches):
            spans = [batch.column(c).to_pylist() for c in ("x0", "x1", "y0", "y1")]
            rows, places, parts = [], [], []
            for i, p, pix in arrays(batch):
                x0, x1, y0, y1 = (s[i] for s in spans)
                top, below = max(p["row0"], y0 - 1), min(p["row0"] + p["h"], y1)
                left, right = max(p["col0"], x0 - 1), min(p["col0"] + p["w"], x1)
                if top < below and left < right:
                    part = pix[top - p["row0"] : below - p["row0"], left - p["col0"] : right - p["col0"]]
                    rows.append(i), parts.append(part)
                    places.append(p | {"row0": top - y0 + 1, "col0": left - x0 + 1, "h": part.shape[0], "w": part.shape[1], "height": y1 - y0 + 1, "width": x1 - x0 + 1})
            batch = batch.select(["frame", "x0", "y0"])
            yield placed(batch, rows, places, parts)

    def look(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        crop = None
        for _, p, pix in arrays(batch):
            if crop is None:
                crop = np.zeros((p["height"], p["width"], p["channels"]))
            crop[p["row0"] : p["row0"] + p["h"], p["col0"] : p["col0"] + p["w"]] = pix
        scaled = crop if side is None else resize(crop, side, side)
        heat = np.asarray(predict(scaled), float)
        found = []
        for k in range(points):
            plane = heat[:, :, k]
            best = float(plane.max())
            if best > least:
                col, row = divmod(int(np.argmax(plane.T)), plane.shape[0])
                found.append((k, (col + 1) * crop.shape[1] / plane.shape[1] + batch.column("x0")[0].as_py(), (row + 1) * crop.shape[0] / plane.shape[0] + batch.column("y0")[0].as_py(), best))
            else:
                found.append((k, 0.0, 0.0, 0.0))
        frame = batch.column("frame").take(pa.array([0] * points))
        return pa.table({"frame": frame, "channel": pa.array([x[0] for x in found], pa.int32()), **{n: pa.array([x[i] for x in found], pa.float64()) for i, n in ((1, "u"), (2, "v"), (3, "quality"))}})

    cropped = images.join(here, "frame").select("frame", "x0", "y0", "x1", "y1", *PLACE, "pix")
    pieces = cropped.mapInArrow(inside, schema_of(images, ["frame"], "x0 int, y0 int, " + TILE))
    found = pieces.groupBy("frame").applyInArrow(look, schema_of(images, ["frame"], "channel int, u double, v double, quality double"))  # 1.5 blocks at most
    none = crops.where("x0 IS NULL").select("frame", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("channel"), *[F.lit(0.0).alias(c) for c in ("u", "v", "quality")])
    return found.unionByName(none)
