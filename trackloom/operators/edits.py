"""Track edits as pure functions from one observation table to the next.

``obs`` has trial, frame, point, cam, u, v.  ``journal`` keeps what edits change
and takes them back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .solve import KEY, reconstruct

COLUMNS = ["trial", "frame", "point", "cam", "u", "v"]


@dataclass(frozen=True)
class RowEdit:
    """An edit that looks at one row at a time: rows that do not ``stay`` are dropped, the others get the columns in ``sets``.

    Called with a table it gives the next one; ``journal`` follows each row
    through several of them without a join.
    """

    sets: dict[str, Column] = field(default_factory=dict)
    stays: Column | None = None

    def __call__(self, table: DataFrame) -> DataFrame:
        return (table if self.stays is None else table.where(self.stays)).withColumns(self.sets)


def inside(first: int | None, last: int | None, length: int | None = None) -> Column:
    """An inclusive frame range, its end clipped to the track's length."""
    low, high = F.lit(first if first is not None else 1), F.lit(last) if last is not None else F.col("frame")
    return F.col("frame").between(low, F.least(high, F.lit(length)) if length is not None else high)


def set_points(obs: DataFrame, clicks: DataFrame) -> DataFrame:
    """Write clicks over what is there; a click with NULL u or v clears."""
    key = ["trial", "frame", "point", "cam"]
    kept = obs.join(clicks.select(*key), key, "left_anti").select(COLUMNS)
    return kept.unionByName(clicks.select(COLUMNS).where("u IS NOT NULL AND v IS NOT NULL"))


def retriangulated(points: DataFrame, obs: DataFrame, touched: DataFrame | Column, camera: DataFrame, lens: DataFrame | None = None) -> DataFrame:
    """``points`` (trial, frame, point, x, y, z, n_cams, rmse) after an edit of ``obs``: only what ``touched`` names is computed again.

    ``touched`` has trial, frame, point, or is a condition on these, which needs
    no join; where it is NULL nothing is touched.  A touched point that fewer
    than two cameras see is cleared.
    """
    if isinstance(touched, Column):
        own = F.coalesce(touched, F.lit(False))
        fresh, kept = reconstruct(obs.where(own).select(COLUMNS), camera, lens), points.where(~own)
    else:
        own = touched.select(KEY).distinct()
        fresh, kept = reconstruct(obs.join(own, KEY, "left_semi").select(COLUMNS), camera, lens), points.join(own, KEY, "left_anti")
    return kept.select(fresh.columns).unionByName(fresh)


def nudged(where: Column, direction: str, step: float = 0.5) -> RowEdit:
    """Move the chosen observations half a pixel; up is smaller v."""
    du, dv = {"left": (-step, 0.0), "right": (step, 0.0), "up": (0.0, -step), "down": (0.0, step)}[direction]
    return RowEdit({c: F.when(where, F.col(c) + d).otherwise(F.col(c)) for c, d in (("u", du), ("v", dv))})


def nudge(obs: DataFrame, where: Column, direction: str, step: float = 0.5) -> DataFrame:
    return nudged(where, direction, step)(obs).select(COLUMNS)


def deleted(point: int) -> RowEdit:
    """Drop a point and renumber the ones above it."""
    return RowEdit({"point": F.col("point") - (F.col("point") > point).cast("int")}, F.col("point") != point)


def delete_point(obs: DataFrame, point: int) -> DataFrame:
    return deleted(point)(obs).select(COLUMNS)


def join_points(obs: DataFrame, a: int, b: int) -> DataFrame:
    """Merge two tracks into the smaller number: each coordinate is the mean of what is there."""
    low, high = min(a, b), max(a, b)
    merged = obs.where(F.col("point").isin(a, b)).groupBy("trial", "frame", "cam").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    merged = merged.select("trial", "frame", F.lit(low).alias("point"), "cam", "u", "v")
    return delete_point(obs.where(~F.col("point").isin(a, b)).select(COLUMNS).unionByName(merged), high)


def swapped(a: int, b: int, first: int | None = None, last: int | None = None) -> RowEdit:
    """Exchange two tracks within an inclusive frame range (all frames without one)."""
    other = F.when(F.col("point") == a, b).when(F.col("point") == b, a).otherwise(F.col("point"))
    return RowEdit({"point": F.when(inside(first, last), other).otherwise(F.col("point"))})


def swap_points(obs: DataFrame, a: int, b: int, first: int | None = None, last: int | None = None) -> DataFrame:
    return swapped(a, b, first, last)(obs).select(COLUMNS)


def split_point(obs: DataFrame, point: int, cam: int, first: int, last: int, n_points: int, length: int | None = None) -> DataFrame:
    """Move one camera's range of a track into a new point number."""
    moves = (F.col("point") == point) & (F.col("cam") == cam) & inside(first, last, length)
    return obs.select("trial", "frame", F.when(moves, n_points + 1).otherwise(F.col("point")).alias("point"), "cam", "u", "v")


def add_point(names: DataFrame, name: str) -> DataFrame:
    """Append a point to the (point, name) dimension; it has no observations yet."""
    new = names.agg((F.coalesce(F.max("point"), F.lit(0)) + 1).alias("point")).withColumn("name", F.lit(name))
    return names.select("point", "name").unionByName(new.select(F.col("point").cast(names.schema["point"].dataType).alias("point"), "name"))
