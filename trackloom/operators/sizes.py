"""Broadcasting behind a proof or a check of size, and how many tasks work on small rows gets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that fit every task's memory; cameras, lenses and clusters are far fewer.
FEW = 10_000


def most_rows(df: DataFrame) -> int | None:
    """How many rows the plan can have at most, where Spark can tell (literal rows, limits, whole-table aggregates)."""
    bound = df._jdf.queryExecution().optimizedPlan().maxRows()
    return int(bound.get()) if bound.isDefined() else None


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df`` as a broadcast side if it has at most ``most`` rows, else as it is, for Spark to choose the join.

    Only where the plan itself has no bound are rows counted, up to one more than ``most``.
    """
    bound = most_rows(df)
    if bound is not None and bound <= most:
        return F.broadcast(df)
    return F.broadcast(df) if df.select(F.lit(1)).limit(most + 1).count() <= most else df


def tasks(spark: SparkSession) -> int:
    """Tasks for rows whose work is not to be seen from their size: four a core, so that none is left to run alone, or as many as shuffles have."""
    return max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
