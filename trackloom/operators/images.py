"""Image and heat-map operators over exploded pixels: (id, row, col, value), rows and columns from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import gamma_scale, ratio


def pixels(images: DataFrame, width: int) -> DataFrame:
    """(id, pix array) to one row per pixel, row-major."""
    e = images.select("id", F.posexplode("pix").alias("i", "value"))
    return e.select("id", F.floor(F.col("i") / width).cast("int").alias("row"), (F.col("i") % width).alias("col"), F.col("value").cast("double").alias("value"))


def clear_borders(px: DataFrame, height: int, width: int, share: float = 0.02) -> DataFrame:
    d = int(share * max(height, width) + 0.5)
    edge = (F.col("row") < d) | (F.col("row") >= height - d) | (F.col("col") < d) | (F.col("col") >= width - d)
    return px.select("id", "row", "col", F.when(edge, 0.0).otherwise(F.col("value")).alias("value"))


def block_scan(px: DataFrame, height: int, width: int, block: int, stride: int) -> DataFrame:
    """Sum over the block around each center of a stride grid; a pixel finds its few centers by arithmetic."""
    half = block // 2
    centers = lambda x, n: F.filter(F.transform(F.sequence(F.floor((x - half) / stride).cast("int"), F.ceil((x + half) / stride).cast("int")), lambda k: k * stride), lambda c: (c >= 0) & (c < n) & (F.abs(c - x) <= half))
    spread = px.select("id", "value", F.explode(centers(F.col("row"), height)).alias("row"), "col").select("id", "value", "row", F.explode(centers(F.col("col"), width)).alias("col"))
    return spread.groupBy("id", "row", "col").agg(F.sum("value").alias("value"))


def checkerboard(spark, n: int, p: int, q: int) -> DataFrame:
    """p x q tiles of [0 1; 1 0], each square n pixels."""
    rows = spark.range(2 * n * p).select(F.col("id").cast("int").alias("row"))
    return rows.crossJoin(spark.range(2 * n * q).select(F.col("id").cast("int").alias("col"))).select("row", "col", ((F.floor(F.col("row") / n) + F.floor(F.col("col") / n)) % 2).cast("int").alias("value"))


def detrend(px: DataFrame) -> DataFrame:
    """Remove the least-squares line of every column, then of every row."""

    def flat(df: DataFrame, along: str, across: str) -> DataFrame:
        w = Window.partitionBy("id", across)
        x, y = F.col(along).cast("double"), F.col("value")
        n, sx, sy, sxx, sxy = F.count(y).over(w), F.sum(x).over(w), F.sum(y).over(w), F.sum(x * x).over(w), F.sum(x * y).over(w)
        slope = F.coalesce(ratio(n * sxy - sx * sy, n * sxx - sx * sx), F.lit(0.0))
        return df.select("id", "row", "col", (y - (sy + slope * (n * x - sx)) / n).alias("value"))

    return flat(flat(px, "row", "col"), "col", "row")


def rescale(px: DataFrame, gamma: float) -> DataFrame:
    w = Window.partitionBy("id")
    return px.select("id", "row", "col", gamma_scale(F.col("value"), F.min("value").over(w), F.max("value").over(w), gamma).alias("value"))


def otsu_level(px: DataFrame, bins: int = 256) -> DataFrame:
    """Threshold in 0..1 that best separates two classes of a ``bins``-bin histogram, per image."""
    level = F.least(F.lit(bins - 1), F.floor(F.col("value") * (bins - 1) + 0.5)).cast("int")
    h = px.select("id", level.alias("b")).groupBy("id", "b").agg(F.count("*").alias("n"))
    up, whole = Window.partitionBy("id").orderBy("b"), Window.partitionBy("id")
    mass, first = F.col("n").cast("double"), F.col("n") * (F.col("b") + 1.0)
    h = h.select("id", "b", F.sum(mass).over(up).alias("w0"), F.sum(first).over(up).alias("m0"), F.sum(mass).over(whole).alias("n"), F.sum(first).over(whole).alias("m"))
    between = ratio((F.col("m") * F.col("w0") - F.col("n") * F.col("m0")) ** 2, F.col("w0") * (F.col("n") - F.col("w0")))
    best = h.select("id", "b", F.round(between, 6).alias("s")).groupBy("id").agg(F.min(F.struct((-F.coalesce("s", F.lit(-1.0))).alias("s"), "b")).alias("x"))
    return best.select("id", (F.col("x.b") / F.lit(bins - 1.0)).alias("level"))


def decode_heat(heat: DataFrame, mask_channel: int, min_score: float, size: int, width: int, height: int, reach: int = 2) -> DataFrame:
    """Detections from heat maps (frame, channel, row, col, score): gate by the mask channel, arg-max, refine.

    Ties go to the smaller column, then row.  Without a gated score above
    ``min_score`` a channel gives (0, 0) with quality 0.
    """
    mask = heat.where(F.col("channel") == mask_channel).select("frame", "row", "col", F.col("score").alias("mask"))
    gated = heat.where(F.col("channel") != mask_channel).join(mask, ["frame", "row", "col"], "left").select("frame", "channel", "row", "col", F.when(F.col("mask") > min_score, F.col("score")).otherwise(0.0).alias("score"))
    best = gated.groupBy("frame", "channel").agg(F.min(F.struct((-F.col("score")).alias("s"), "col", "row")).alias("b")).select("frame", "channel", F.col("b.row").alias("r0"), F.col("b.col").alias("c0"), (-F.col("b.s")).alias("quality"))
    near = gated.join(best, ["frame", "channel"]).where((F.abs(F.col("row") - F.col("r0")) <= reach) & (F.abs(F.col("col") - F.col("c0")) <= reach))
    g = near.groupBy("frame", "channel", "quality").agg(F.sum("score").alias("m"), F.sum(F.col("score") * F.col("col")).alias("mc"), F.sum(F.col("score") * F.col("row")).alias("mr"))
    found = F.col("quality") > min_score
    at = lambda m, side: F.when(found, F.coalesce(ratio(F.col(m), F.col("m")), F.lit(0.0)) / size * side).otherwise(0.0)
    return g.select("frame", "channel", at("mc", width).alias("u"), at("mr", height).alias("v"), F.when(found, F.col("quality")).otherwise(0.0).alias("quality"))


def crop_coordinates(obs: DataFrame, side: int = 224, margin: int = 3) -> DataFrame:
    """Coordinates inside a square crop around each frame's points, kept within the image; near-edge ones are missing.

    ``obs`` has movie, frame, point, u, v, width, height.
    """
    w = Window.partitionBy("movie", "frame")
    start = lambda c, n: F.greatest(F.lit(0.0), F.least(F.col(n) - side, F.round((F.min(c).over(w) + F.max(c).over(w)) / 2) - side / 2))
    df = obs.select("*", start("u", "width").alias("x0"), start("v", "height").alias("y0"))
    a, b = F.col("u") - F.col("x0"), F.col("v") - F.col("y0")
    ok = a.between(margin, side - margin) & b.between(margin, side - margin)
    return df.select("movie", "frame", "point", "x0", "y0", F.when(ok, a).alias("u"), F.when(ok, b).alias("v"))


def rejected_crops(crops: DataFrame, side: int = 224, slack: int = 5) -> DataFrame:
    """Frames with a coordinate just outside the crop: in (-slack, 0) or (side, side + slack)."""
    out = lambda c: ((F.col(c) > -slack) & (F.col(c) < 0)) | ((F.col(c) > side) & (F.col(c) < side + slack))
    return crops.groupBy("movie", "frame").agg(F.coalesce(F.bool_or(out("u") | out("v")), F.lit(False)).alias("rejected"))


def rotate_points(points: DataFrame, degrees: float, side: int = 224) -> DataFrame:
    """Rotate crop coordinates about the crop's center (the image itself is rotated by the kernel)."""
    c, s, m = F.cos(F.radians(F.lit(degrees))), F.sin(F.radians(F.lit(degrees))), side / 2
    a, b = F.col("u") - m, F.col("v") - m
    return points.withColumns({"u": c * a + s * b + m, "v": -s * a + c * b + m})
