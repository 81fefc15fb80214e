"""Window operators over tracks: (track, frame, u) with NULL for missing samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import ratio

def up():
    return Window.partitionBy("track").orderBy("frame")


def before(n: int) -> object:
    return up().rowsBetween(-(n - 1), 0)


def last_valid(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(up().rowsBetween(Window.unboundedPreceding, 0))


def predict(series: DataFrame, window: int = 11, step: int = 1) -> DataFrame:
    """Static and linear predictions for the next frame, and the mode that the history allows.

    The window holds the last ``window`` samples on the grid of ``step`` frames.
    Up to two valid samples allow the static mode (1), up to seven or an early
    frame the linear (2), otherwise the filter (3); none gives NULL.
    """
    grid = Window.partitionBy("track", F.pmod("frame", F.lit(step))).orderBy("frame").rangeBetween(-(window - 1) * step, 0)
    with_valid = series.select("track", "frame", "u", F.collect_list("u").over(grid).alias("seen"))  # NULL is left out
    n, at = F.size("seen"), lambda k: F.get("seen", F.size("seen") - k)
    linear = F.round(F.round((4 * at(1) + at(2) - 2 * at(3)) / 3, 6))  # halves as they are meant
    mode = F.when(n == 0, None).when(n < 3, 1).when((n < 8) | (F.col("frame") < window * step), 2).otherwise(3)
    return with_valid.select("track", "frame", "u", F.round(at(1)).alias("static"), F.when(n >= 3, linear).alias("linear"), mode.alias("mode"))


def fill_gaps(series: DataFrame, method: str = "linear", least: int = 5) -> DataFrame:
    """Fill between the first and last valid sample; tracks with fewer than ``least`` stay as they are.

    Returns track, frame, u, filled, fitted (1 where a value was missing).
    """
    whole = Window.partitionBy("track")
    lo, hi = up().rowsBetween(Window.unboundedPreceding, 0), up().rowsBetween(0, Window.unboundedFollowing)
    here = F.when(F.col("u").isNotNull(), F.col("frame"))
    df = series.select("track", "frame", "u", F.count("u").over(whole).alias("n"), F.last("u", True).over(lo).alias("u0"), F.last(here, True).over(lo).alias("f0"), F.first("u", True).over(hi).alias("u1"), F.first(here, True).over(hi).alias("f1"))
    inside = (F.col("n") >= least) & F.col("u0").isNotNull() & F.col("u1").isNotNull()
    share = (F.col("frame") - F.col("f0")) / F.nullif(F.col("f1") - F.col("f0"), F.lit(0))
    value = F.col("u0") + (F.col("u1") - F.col("u0")) * share if method == "linear" else F.when(share < 0.5, F.col("u0")).otherwise(F.col("u1"))
    return df.select("track", "frame", "u", F.coalesce("u", F.when(inside, value)).alias("filled"), F.col("u").isNull().cast("int").alias("fitted"))


def between_frames(series: DataFrame) -> DataFrame:
    """Value at the fraction of a frame by which a camera's clock is off (column ``offset``).

    Two valid samples among the neighbours and the frame itself suffice; a line
    through the nearest two, else the raw value.
    """
    part = F.pmod(F.coalesce("offset", F.lit(0.0)), F.lit(1.0))
    near = lambda f, k: F.when(f("frame", 1).over(up()) == F.col("frame") + k, f("u", 1).over(up()))
    df = series.select("track", "frame", "u", "offset", part.alias("part"), near(F.lag, -1).alias("prior"), near(F.lead, 1).alias("next"))
    u, a, b, t = F.col("u"), F.col("prior"), F.col("next"), F.col("part")
    moved = F.when(t == 0, u).when(u.isNotNull() & b.isNotNull(), u + (b - u) * t).when(u.isNotNull() & a.isNotNull(), u + (u - a) * t).when(a.isNotNull() & b.isNotNull(), a + (b - a) * (1 + t) / 2)
    return df.select("track", "frame", "u", "offset", F.coalesce(moved, u).alias("at_offset"))


def display_window(frame: Column, width: int, length: Column) -> tuple[Column, Column]:
    """First and last frame of a plot of ``width`` frames around a frame, clipped to the track."""
    early = frame < width / 2 + 1
    right = F.least(length, (frame + width / 2).cast("int"))
    return F.when(early, F.greatest(F.lit(1), (frame - width / 2).cast("int"))).otherwise(F.greatest(F.lit(1), right - width)), F.when(early, F.least(length, F.lit(width + 1))).otherwise(right)


def neighbourhood(series: DataFrame, reach: int = 4) -> DataFrame:
    near = Window.partitionBy("track").orderBy("frame").rangeBetween(-reach, reach)
    return series.select("track", "frame", "u", F.count("u").over(near).alias("n_near"), F.avg("u").over(near).alias("mean_near"))


def failure_runs(series: DataFrame, gap: int = 0) -> DataFrame:
    """Failures in a row up to each frame, and whether more than ``gap`` of them end the track."""
    ok = F.col("u").isNotNull()
    df = series.select("track", "frame", "u", F.count("u").over(up().rowsBetween(Window.unboundedPreceding, 0)).alias("island"))
    run = F.sum((~ok).cast("int")).over(Window.partitionBy("track", "island").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    df = df.select("track", "frame", "u", run.alias("failures"))
    return df.withColumn("stops", F.col("failures") > gap)


def ring_buffer(series: DataFrame, length: int = 10) -> DataFrame:
    """The last ``length`` samples, newest first."""
    recent = F.reverse(F.collect_list(F.coalesce("u", F.lit(float("nan")))).over(before(length)))
    return series.select("track", "frame", recent.alias("buffer"))


def differences(series: DataFrame) -> DataFrame:
    """First and second differences."""
    d = F.col("u") - F.lag("u").over(up())
    df = series.select("track", "frame", "u", d.alias("velocity"))
    return df.withColumn("acceleration", F.col("velocity") - F.lag("velocity").over(up()))


def carry_forward(series: DataFrame) -> DataFrame:
    """A missing or zero pose takes the last one that was neither."""
    return series.select("track", "frame", "u", last_valid(F.nullif("u", F.lit(0.0))).alias("pose"))


def timing(frames: DataFrame, rate: float, head: int = 5) -> DataFrame:
    """Per track with frame times ``t`` (seconds): variable timing among the first frames, good tail."""
    df = frames.select("track", "frame", F.round(F.col("t") - F.lag("t").over(up()), 5).alias("dt"))
    tail = F.max_by(F.col("dt"), F.col("frame"))
    return df.groupBy("track").agg((F.count_distinct(F.when(F.col("frame") <= head, F.col("dt"))) > 1).alias("variable_timing"), (F.abs(tail - 1 / rate) <= 0.05 / rate).alias("good_tail"), F.count("*").alias("n_frames"))


def background(images: DataFrame, low: int = 3, high: int = 6, best: int = 3) -> DataFrame:
    """Each image minus the cached one ``low`` to ``high`` frames before, nearest to ``best``; without one as it is.

    ``images`` has track, frame, pix (array<double>).  Which image it is follows
    from the frames alone, by equi-keys; images are then joined once.
    """
    frames = images.select("track", "frame")
    cached = frames.select("track", F.explode(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda lag: F.struct((F.col("frame") + lag).alias("frame"), F.abs(lag - best).alias("far"), lag.alias("lag")))).alias("c"))
    chosen = cached.groupBy("track", "c.frame").agg(F.min(F.struct("c.far", "c.lag")).alias("b")).select("track", "frame", F.col("b.lag").alias("lag"))
    wanted = frames.join(chosen, ["track", "frame"]).select("track", "frame", "lag", (F.col("frame") - F.col("lag")).alias("then"))  # numbers only
    old = images.select("track", F.col("frame").alias("then"), F.col("pix").alias("old")).join(wanted, ["track", "then"]).select("track", "frame", "lag", "old")
    j = images.join(old, ["track", "frame"], "left")
    return j.select("track", "frame", "lag", F.when(F.col("old").isNull(), F.col("pix")).otherwise(F.zip_with("pix", "old", lambda a, b: a - b)).alias("pix"))


def clamp_prediction(u: Column, previous: Column, size: Column) -> Column:
    """A coordinate outside the image falls back to the frame before."""
    return F.when((u >= 1) & (u <= size), u).otherwise(F.round(previous))


__all__ = ["ratio", "predict", "fill_gaps", "between_frames", "display_window", "neighbourhood", "failure_runs", "ring_buffer", "differences", "carry_forward", "timing", "background", "clamp_prediction", "last_valid"]
