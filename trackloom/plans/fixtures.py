"""Track tables derived from the driver's tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOCAL, CENTER = 1500.0, 512.0
PLACES = [(20.0, 2.0, 4.0), (16.0, -14.0, 6.0), (2.0, -22.0, 5.0)]
LENSES = [(1, 1500.0, 1500.0, 512.0, 512.0, -0.02, 0.001, 0.0005, -0.0003, 0.0), (2, 1480.0, 1520.0, 510.0, 515.0, 0.015, -0.002, 0.0, 0.0002, 0.0001)]
#: Planar cameras: eight coefficients each.
PLANES = [(1, [90.0, 4.0, 300.0, -3.0, 85.0, 280.0, 0.002, 0.001]), (2, [70.0, -20.0, 400.0, 15.0, 75.0, 350.0, -0.001, 0.003])]


def look_at_origin(place: tuple[float, float, float]) -> list[float]:
    """Eleven coefficients of a pinhole camera at ``place`` that looks at the origin."""
    n = math.dist(place, (0, 0, 0))
    ahead = [-x / n for x in place]
    side = [ahead[1], -ahead[0], 0.0]
    s = math.hypot(*side)
    side = [x / s for x in side]
    down = [ahead[1] * side[2] - ahead[2] * side[1], ahead[2] * side[0] - ahead[0] * side[2], ahead[0] * side[1] - ahead[1] * side[0]]
    t = [-sum(a * b for a, b in zip(axis, place)) for axis in (side, down, ahead)]
    rows = [[FOCAL * p + CENTER * q for p, q in zip((*axis, t0), (*ahead, t[2]))] for axis, t0 in ((side, t[0]), (down, t[1]))]
    return [x / t[2] for x in (*rows[0], *rows[1], *ahead)]


CAMERAS = [(i + 1, look_at_origin(p)) for i, p in enumerate(PLACES)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Rows that stand in the plan itself, so that Spark knows how few they are."""
    cell = lambda x: f"array({', '.join(map(cell, x))})" if isinstance(x, list) else f"{x!r}D" if isinstance(x, float) else repr(x)
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f" AS t({names})")


def cameras(spark: SparkSession) -> DataFrame:
    return literal(spark, CAMERAS, "cam, c")


def supplier_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pinhole camera for every supplier, placed by its key and balance, that looks at the origin."""
    s = table(spark, sf_dir, "supplier")
    at = s.select(F.col("s_suppkey").cast("int").alias("cam"), (12.0 + F.col("s_suppkey") % 9).alias("px"), (-10.0 + F.col("s_suppkey") * 7 % 21).alias("py"), (3.0 + F.col("s_acctbal") / 1777).alias("pz"))
    n = F.sqrt(F.col("px") ** 2 + F.col("py") ** 2 + F.col("pz") ** 2)
    ahead = at.select("*", n.alias("n"), *[(-F.col(f"p{k}") / n).alias(f"a{k}") for k in "xyz"])
    turned = ahead.select("*", F.sqrt(F.col("ax") ** 2 + F.col("ay") ** 2).alias("h"))
    sides = turned.select("*", (F.col("ay") / F.col("h")).alias("sx"), (-F.col("ax") / F.col("h")).alias("sy"))
    frame = sides.select("*", (-F.col("az") * F.col("sy")).alias("dx"), (F.col("az") * F.col("sx")).alias("dy"), (F.col("ax") * F.col("sy") - F.col("ay") * F.col("sx")).alias("dz"))
    row = lambda x, y, z: [(FOCAL * v + CENTER * F.col(f"a{k}")) / F.col("n") for v, k in ((x, "x"), (y, "y"), (z, "z"))]
    # the axes through the camera pass the origin: only the way ahead has an offset
    c = [*row(F.col("sx"), F.col("sy"), F.lit(0.0)), F.lit(CENTER), *row(F.col("dx"), F.col("dy"), F.col("dz")), F.lit(CENTER), *[F.col(f"a{k}") / F.col("n") for k in "xyz"]]
    return frame.select("cam", F.array(*c).alias("c"))


def calibration_clicks(spark: SparkSession, sf_dir: str, orders: int) -> tuple[DataFrame, DataFrame]:
    """Points of ``orders`` orders at a time as the calibration object of a rig, and their noisy clicks in its three cameras."""
    from ..functions.geometry import project

    w = world(spark, sf_dir).select(F.floor(F.col("frame") / orders).cast("int").alias("rig"), (F.col("frame") % orders * 16 + F.col("point")).cast("int").alias("pt"), "x", "y", "z", "e")
    u, v = project(F.col("c"), F.col("x"), F.col("y"), F.col("z"))
    seen = w.crossJoin(F.broadcast(cameras(spark)))
    return w.drop("e"), seen.select("rig", "cam", "pt", (u + F.sin(F.col("e") * F.col("cam")) / 4).alias("u"), (v + F.cos(F.col("e") * F.col("cam")) / 4).alias("v"))


def plane_cameras(spark: SparkSession) -> DataFrame:
    return literal(spark, PLANES, "cam, c")


def lenses(spark: SparkSession) -> DataFrame:
    return literal(spark, LENSES, "cam, f1, f2, cx, cy, k1, k2, k3, k4, k5")


def world(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Points, dealt to tasks by the column ``by`` (frame or point) alone if it is given: what keeps it needs no other shuffle."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("int").alias("frame"), F.col("l_linenumber").cast("int").alias("point"), "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    g = (lines.repartition(by) if by else lines).groupBy("frame", "point")
    return g.agg((F.avg("l_quantity") / 10).alias("x"), (F.avg("l_discount") * 50).alias("y"), (F.avg("l_tax") * 50).alias("z"), F.avg("l_extendedprice").alias("e")).withColumn("trial", F.lit("t"))


def observations(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    """Projections with bounded noise; about a fifth of them is missing."""
    from ..functions.geometry import project

    w = world(spark, sf_dir, by).crossJoin(F.broadcast(cameras(spark)))
    u, v = project(F.col("c"), F.col("x"), F.col("y"), F.col("z"))
    seen = F.pmod(F.col("frame") + F.col("cam") + F.col("point"), F.lit(5)) != 0
    return w.select("trial", "frame", "point", "cam", F.when(seen, u + F.sin(F.col("e") * F.col("cam"))).alias("u"), F.when(seen, v + F.cos(F.col("e") * F.col("cam"))).alias("v"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user as a track: frames in order of time, large values missing."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("track"), F.row_number().over(order).alias("frame"), F.when(F.col("value") <= 90, F.col("value")).alias("u"), "ts")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 patches in the order of their rows."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("pix"), F.col("label").alias("label"))


def rows(values: list) -> str:
    cell = lambda x: "[" + ", ".join(map(repr, x)) + "]" if isinstance(x, list) else repr(x)
    return ", ".join("(" + ", ".join(cell(x) for x in r) + ")" for r in values)


def sql_project(x: str, y: str, z: str, c: str = "c") -> tuple[str, str]:
    below = f"({x}*{c}[9]+{y}*{c}[10]+{z}*{c}[11]+1)"
    return f"(({x}*{c}[1]+{y}*{c}[2]+{z}*{c}[3]+{c}[4])/nullif({below},0))", f"(({x}*{c}[5]+{y}*{c}[6]+{z}*{c}[7]+{c}[8])/nullif({below},0))"


U, V = sql_project("x", "y", "z")
CAMERA_SQL = f"camera(cam, c) AS (VALUES {rows(CAMERAS)})"
#: ``supplier_cameras`` under the name of the other camera tables.
RIG_SQL = f"""sp AS (SELECT s_suppkey::INT AS cam, 12.0::DOUBLE + s_suppkey%9 AS px, -10.0::DOUBLE + s_suppkey*7%21 AS py, 3.0::DOUBLE + s_acctbal::DOUBLE/1777 AS pz FROM supplier),
sn AS (SELECT *, sqrt(px*px+py*py+pz*pz) AS n FROM sp), sa AS (SELECT *, -px/n AS ax, -py/n AS ay, -pz/n AS az FROM sn), sh AS (SELECT *, sqrt(ax*ax+ay*ay) AS h FROM sa), ss AS (SELECT *, ay/h AS sx, -ax/h AS sy FROM sh),
camera AS (SELECT cam, [({FOCAL}*sx+{CENTER}*ax)/n, ({FOCAL}*sy+{CENTER}*ay)/n, {CENTER}*az/n, {CENTER}, ({FOCAL}*(-az*sy)+{CENTER}*ax)/n, ({FOCAL}*(az*sx)+{CENTER}*ay)/n, ({FOCAL}*(ax*sy-ay*sx)+{CENTER}*az)/n, {CENTER}, ax/n, ay/n, az/n]::DOUBLE[] AS c FROM ss)"""
PLANE_SQL = f"plane(cam, c) AS (VALUES {rows(PLANES)})"
LENS_SQL = f"lens(cam, f1, f2, cx, cy, k1, k2, k3, k4, k5) AS (VALUES {rows(LENSES)})"
WORLD_SQL = "world AS (SELECT 't' AS trial, l_orderkey::INT AS frame, l_linenumber::INT AS point, avg(l_quantity)/10 AS x, avg(l_discount)*50 AS y, avg(l_tax)*50 AS z, avg(l_extendedprice) AS e FROM lineitem GROUP BY ALL)"
OBS_SQL = f"obs AS (SELECT trial, frame, point, cam, CASE WHEN (frame+cam+point)%5<>0 THEN {U}+sin(e*cam) END AS u, CASE WHEN (frame+cam+point)%5<>0 THEN {V}+cos(e*cam) END AS v FROM world, camera)"
SERIES_SQL = "series AS (SELECT user_id::VARCHAR AS track, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS frame, CASE WHEN value<=90 THEN value END AS u, ts FROM events)"
PIXEL_SQL = "px AS (SELECT vec_id AS id, label, ((i-1)//8)::INT AS row, ((i-1)%8)::INT AS col, embedding[i]::DOUBLE AS value FROM (SELECT *, unnest(range(1, len(embedding)+1)) AS i FROM embeddings) q)"
TRACKS_SQL = f"WITH {CAMERA_SQL}, {WORLD_SQL}, {OBS_SQL}"
