"""Registered queries along tracks and over their edits: filters as parallel scans, versions of tables, training batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits, journal, recurrences, training
from . import fixtures as X
from .queries import query, rounded

VALID_SQL = f"{X.SERIES_SQL}, sv AS (SELECT track, frame, u, row_number() OVER (PARTITION BY track ORDER BY frame) AS k FROM series WHERE u IS NOT NULL)"


@query(f"""WITH RECURSIVE {VALID_SQL}, de AS (SELECT track, k, frame, u::DOUBLE AS u, u::DOUBLE AS s, u::DOUBLE AS b FROM sv WHERE k = 1
  UNION ALL SELECT n.track, n.k, n.frame, n.u, CASE WHEN n.k = 2 THEN de.u ELSE 0.3*n.u + 0.7*de.s END, CASE WHEN n.k = 2 THEN n.u ELSE 0.09*n.u + 0.21*de.s + 0.7*de.b END FROM de JOIN sv n ON n.track = de.track AND n.k = de.k + 1)
SELECT track, frame, CASE WHEN k > 2 THEN round((2 + 0.3/0.7)*s - (1 + 0.3/0.7)*b, 6) + 0.0 END AS predicted FROM de""")
def double_exponential_scan(spark, sf):
    return rounded(recurrences.double_exponential_along(X.series(spark, sf), 0.3, 16).select("track", "frame", "predicted"), "predicted", digits=6)


@query(f"""WITH RECURSIVE {VALID_SQL}, hd AS (SELECT track, max(u) FILTER (k = 1) AS a, max(u) FILTER (k = 2) AS b, max(u) FILTER (k = 3) AS c FROM sv WHERE k < 4 GROUP BY track),
fc AS (SELECT 0 AS t, 0.01::DOUBLE AS p11, 0.0::DOUBLE AS p12, 0.0::DOUBLE AS p13, 0.01::DOUBLE AS p22, 0.0::DOUBLE AS p23, 0.01::DOUBLE AS p33, 0.0::DOUBLE AS g1, 0.0::DOUBLE AS g2, 0.0::DOUBLE AS g3
  UNION ALL SELECT t + 1, q11 - q11*q11/(q11+0.1), q12 - q11*q12/(q11+0.1), q13 - q11*q13/(q11+0.1), q22 - q12*q12/(q11+0.1), q23 - q12*q13/(q11+0.1), q33 - q13*q13/(q11+0.1), q11/(q11+0.1), q12/(q11+0.1), q13/(q11+0.1)
  FROM (SELECT t, p11+4*p13+4*p33+1 AS q11, p12+p13+2*p23+2*p33 AS q12, p13+2*p33 AS q13, p22+2*p23+p33+1 AS q22, p23+p33 AS q23, p33+1 AS q33 FROM fc) q WHERE t < (SELECT max(k) FROM sv)),
fi AS (SELECT track, 0::BIGINT AS k, NULL::INT AS frame, NULL::DOUBLE AS u, a AS x, b - a AS y, c - 2*b + a AS z FROM hd WHERE c IS NOT NULL
  UNION ALL SELECT n.track, n.k, n.frame, n.u, fi.x+2*fi.z + g1*(n.u-fi.x-2*fi.z), fi.y+fi.z + g2*(n.u-fi.x-2*fi.z), fi.z + g3*(n.u-fi.x-2*fi.z) FROM fi JOIN sv n ON n.track = fi.track AND n.k = fi.k + 1 JOIN fc ON fc.t = n.k)
SELECT sv.track, sv.frame, round(CASE WHEN sv.k < 4 THEN sv.u ELSE fi.x + 2*fi.z END, 6) + 0.0 AS predicted FROM sv LEFT JOIN fi ON fi.track = sv.track AND fi.k = sv.k""")
def kalman_scan(spark, sf):
    return rounded(recurrences.kalman_along(X.series(spark, sf), 16).select("track", "frame", "predicted"), "predicted", digits=6)


@query()
def poses_predicted(spark, sf):
    return rounded(recurrences.carry_poses(X.series(spark, sf)), "pose", digits=6)


@query()
def smoothing_alphas(spark, sf):
    return recurrences.best_alpha(X.series(spark, sf), rounds=2).select("track", F.round("alpha", 6).alias("alpha"), F.round("error", 6).alias("error"))


KEYS = ["trial", "frame", "point", "cam"]
OPERATIONS = ["nudge", "swap", "delete"]
SESSION_SQL = f"""{X.TRACKS_SQL}, e0 AS (SELECT trial, frame, point, cam, u, v FROM obs),
e1 AS (SELECT * REPLACE (CASE WHEN point=1 AND cam=2 THEN v-0.5 ELSE v END AS v) FROM e0),
e2 AS (SELECT * REPLACE (CASE WHEN frame BETWEEN 100 AND 5000 AND point IN (1, 4) THEN 5-point ELSE point END AS point) FROM e1),
e3 AS (SELECT * REPLACE (CASE WHEN point>3 THEN point-1 ELSE point END AS point) FROM e2 WHERE point<>3)"""


def session() -> list[tuple[str, edits.RowEdit]]:
    """A short session of editing: half a pixel up, two tracks exchanged, a point deleted.

    Made in the call: columns need a Spark session, and this module is imported without one.
    """
    made = edits.nudged((F.col("point") == 1) & (F.col("cam") == 2), "up"), edits.swapped(1, 4, 100, 5000), edits.deleted(3)
    return list(zip(OPERATIONS, made, strict=True))


@query(f"""{SESSION_SQL}, al AS ({" UNION ALL ".join(f"SELECT {n} AS version, * FROM e{k}" for n, k in enumerate((0, 1, 2, 3, 2)))})
SELECT version, point, cam, count(*) AS n, count(u) AS seen, round(avg(u), 4)+0.0 AS u, round(avg(v), 4)+0.0 AS v FROM al GROUP BY ALL""")
def edit_versions(spark, sf):
    book = journal.versions(X.observations(spark, sf, "frame"), KEYS, session())
    every = journal.every_version(journal.taken_back(book, ["u", "v"], 3, 4), KEYS, ["u", "v"], 4)
    found = every.groupBy("version", "point", "cam").agg(F.count("*").alias("n"), F.count("u").alias("seen"), F.avg("u").alias("u"), F.avg("v").alias("v"))
    return rounded(found, "u", "v", digits=4)


@query(f"""{SESSION_SQL}, ch AS ({" UNION ALL ".join(f"SELECT {k} AS version, '{o}' AS operation, b.frame IS NOT NULL AS was, a.frame IS NOT NULL AS now, b.u IS DISTINCT FROM a.u OR b.v IS DISTINCT FROM a.v AS other FROM e{k - 1} b FULL JOIN e{k} a ON a.frame=b.frame AND a.point=b.point AND a.cam=b.cam" for k, o in enumerate(OPERATIONS, 1))})
SELECT version, operation, count(*) FILTER (NOT was) AS added, count(*) FILTER (was AND now) AS changed, count(*) FILTER (NOT now) AS removed FROM ch WHERE NOT was OR NOT now OR other GROUP BY ALL""")
def edit_history(spark, sf):
    return journal.history(journal.edited(X.observations(spark, sf, "frame"), KEYS, session()))


@query()
def training_pictures(spark, sf):
    im = X.images(spark, sf).select(F.col("label").cast("string").alias("movie"), F.col("id").cast("int").alias("frame"), *[F.lit(n).alias(c) for c, n in (("height", 8), ("width", 8), ("channels", 1))], F.transform("pix", lambda x: (x + 1) * 127).alias("pix"))
    obs = im.select("movie", "frame", F.explode(F.array(*[F.struct(F.lit(k).alias("point"), (F.col("frame") % a + 2.0).alias("u"), (F.col("frame") % b + 2.0).alias("v")) for k, a, b in ((1, 5, 4), (2, 4, 5))])).alias("o")).select("movie", "frame", "o.*")
    sample = training.exact_sample(training.labelled(obs, [1, 2]), 200, 7)
    made = training.training_batch(sample, im, "whole", side=16, seed=7)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 2)
    return made.select("movie", "frame", "draw", "height", "width", "channels", "maps", total("input").alias("input"), total("response").alias("response"))
