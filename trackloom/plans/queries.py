"""Registered queries over the operators, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import calibrate, edits, images, kernels, solve, splines, tables, timeseries, uncertainty
from ..sources.files import frame_rate, media_kind
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r(c: Column | str, digits: int = 5) -> Column:
    """Rounded, with one zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + 0.0


def rounded(df: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


# geometry

@query(f"WITH {X.CAMERA_SQL}, {X.WORLD_SQL} SELECT trial, frame, point, cam, round({X.U},5)+0.0 AS u, round({X.V},5)+0.0 AS v FROM world, camera")
def project_points(spark, sf):
    return rounded(tables.project_all(X.world(spark, sf), X.cameras(spark)), "u", "v")


SEEN = "seen AS (SELECT * FROM obs JOIN camera USING (cam) WHERE u IS NOT NULL AND v IS NOT NULL)"
ROWS = "eq AS (SELECT trial, frame, point, u*c[9]-c[1] AS a, u*c[10]-c[2] AS b, u*c[11]-c[3] AS d, c[4]-u AS y FROM seen UNION ALL SELECT trial, frame, point, v*c[9]-c[5], v*c[10]-c[6], v*c[11]-c[7], c[8]-v FROM seen)"
SUMS = "g AS (SELECT trial, frame, point, sum(a*a) aa, sum(a*b) ab, sum(a*d) ad, sum(b*b) bb, sum(b*d) bd, sum(d*d) dd, sum(a*y) ay, sum(b*y) y2, sum(d*y) dy, sum(y*y) yy, count(*) n FROM eq GROUP BY ALL HAVING count(*)>=4)"
DET = "h AS (SELECT *, aa*(bb*dd-bd*bd)-ab*(ab*dd-bd*ad)+ad*(ab*bd-bb*ad) AS det FROM g)"
XYZ = "xyz AS (SELECT trial, frame, point, n, yy, ay, y2, dy, (ay*(bb*dd-bd*bd)-ab*(y2*dd-bd*dy)+ad*(y2*bd-bb*dy))/det AS x, (aa*(y2*dd-bd*dy)-ay*(ab*dd-bd*ad)+ad*(ab*dy-y2*ad))/det AS y, (aa*(bb*dy-y2*bd)-ab*(ab*dy-y2*ad)+ay*(ab*bd-bb*ad))/det AS z FROM h)"
SOLVE = f"{X.TRACKS_SQL}, {SEEN}, {ROWS}, {SUMS}, {DET}, {XYZ}"
_u, _v = X.sql_project("p.x", "p.y", "p.z", "s.c")


@query(f"{SOLVE} SELECT p.trial, p.frame, p.point, round(any_value(p.x),5)+0.0 AS x, round(any_value(p.y),5)+0.0 AS y, round(any_value(p.z),5)+0.0 AS z, count(*)::INT AS n_cams, round(sqrt(sum(({_u}-s.u)**2+({_v}-s.v)**2)/(2*count(*)-3)),5)+0.0 AS rmse FROM xyz p JOIN seen s USING (trial, frame, point) GROUP BY p.trial, p.frame, p.point")
def reconstruct_points(spark, sf):
    return rounded(solve.reconstruct(X.observations(spark, sf), X.cameras(spark)), "x", "y", "z", "rmse")


@query(f"{SOLVE} SELECT trial, frame, point, round(x,5)+0.0 AS x, round(y,5)+0.0 AS y, round(z,5)+0.0 AS z, (n/2)::INT AS n_cams, round(sqrt(greatest(0.0, yy-x*ay-y*y2-z*dy)/(n-3)),3)+0.0 AS algebraic_rmse FROM xyz")
def triangulate_points(spark, sf):
    return rounded(rounded(solve.triangulate(X.observations(spark, sf), X.cameras(spark)), "x", "y", "z"), "algebraic_rmse", digits=3)


@query(f"WITH {X.PLANE_SQL}, {X.WORLD_SQL}, o AS (SELECT trial, frame, point, c, (x*c[1]+y*c[2]+c[3])/(x*c[7]+y*c[8]+1)+sin(e) AS u, (x*c[4]+y*c[5]+c[6])/(x*c[7]+y*c[8]+1)+cos(e) AS v FROM world, plane WHERE (frame+cam)%4<>0), q AS (SELECT trial, frame, point, u*c[7]-c[1] a, u*c[8]-c[2] b, c[3]-u p, v*c[7]-c[4] d, v*c[8]-c[5] f, c[6]-v q FROM o), g AS (SELECT trial, frame, point, sum(a*a+d*d) s11, sum(a*b+d*f) s12, sum(b*b+f*f) s22, sum(a*p+d*q) r1, sum(b*p+f*q) r2, sum(p*p+q*q) bb, count(*) n FROM q GROUP BY ALL), h AS (SELECT *, (r1*s22-s12*r2)/(s11*s22-s12*s12) x, (s11*r2-r1*s12)/(s11*s22-s12*s12) y FROM g) SELECT trial, frame, point, round(x,5)+0.0 AS x, round(y,5)+0.0 AS y, 0.0::DOUBLE AS z, n::INT AS n_cams, CASE WHEN n>1 THEN round(sqrt(greatest(0.0, bb-x*r1-y*r2)/(2*n-2)),3)+0.0 END AS rmse FROM h")
def reconstruct_planar(spark, sf):
    w = X.world(spark, sf).crossJoin(F.broadcast(X.plane_cameras(spark))).where(F.pmod(F.col("frame") + F.col("cam"), F.lit(4)) != 0)
    u, v = G.project_plane(F.col("c"), F.col("x"), F.col("y"))
    obs = w.select("trial", "frame", "point", "cam", (u + F.sin("e")).alias("u"), (v + F.cos("e")).alias("v"))
    return rounded(rounded(solve.reconstruct_plane(obs, X.plane_cameras(spark)), "x", "y"), "rmse", digits=3)


def _lens_sql(rounds: int) -> str:
    steps = "s0 AS (SELECT *, (u-cx)/((f1+f2)/2) xd, (v-cy)/((f1+f2)/2) yd, (u-cx)/((f1+f2)/2) x, (v-cy)/((f1+f2)/2) y FROM obs LEFT JOIN lens USING (cam))"
    for i in range(rounds):
        steps += f", t{i} AS (SELECT * EXCLUDE (x, y), x, y, x*x+y*y r2 FROM s{i}), n{i} AS (SELECT * EXCLUDE (x, y, r2), (xd-(2*k3*x*y+k4*(r2+2*x*x)))/(1+k1*r2+k2*r2*r2+k5*r2*r2*r2) nx, (yd-(k3*(r2+2*y*y)+2*k4*x*y))/(1+k1*r2+k2*r2*r2+k5*r2*r2*r2) ny FROM t{i}), s{i + 1} AS (SELECT * EXCLUDE (nx, ny), nx AS x, ny AS y FROM n{i})"
    return steps


@query(f"{X.TRACKS_SQL}, {X.LENS_SQL}, {_lens_sql(3)} SELECT trial, frame, point, cam, round(CASE WHEN f1 IS NULL THEN u ELSE x*((f1+f2)/2)+cx END,5)+0.0 AS u, round(CASE WHEN f1 IS NULL THEN v ELSE y*((f1+f2)/2)+cy END,5)+0.0 AS v FROM s3")
def undistort_observations(spark, sf):
    return rounded(solve.undistorted(X.observations(spark, sf), X.lenses(spark)), "u", "v").select("trial", "frame", "point", "cam", "u", "v")


@query(f"{X.TRACKS_SQL}, {X.LENS_SQL}, s AS (SELECT *, (f1+f2)/2 f, (u-cx)/((f1+f2)/2) x, (v-cy)/((f1+f2)/2) y FROM obs JOIN lens USING (cam)), t AS (SELECT *, x*x+y*y r2 FROM s) SELECT frame, point, cam, round((x*(1+k1*r2+k2*r2*r2+k5*r2*r2*r2)+2*k3*x*y+k4*(r2+2*x*x))*f+cx,5)+0.0 AS u, round((y*(1+k1*r2+k2*r2*r2+k5*r2*r2*r2)+k3*(r2+2*y*y)+2*k4*x*y)*f+cy,5)+0.0 AS v FROM t")
def distort_observations(spark, sf):
    j = X.observations(spark, sf).join(F.broadcast(X.lenses(spark)), "cam")
    u, v = G.distort(*[F.col(n) for n in ("u", "v", "f1", "f2", "cx", "cy")], [F.col(f"k{i}") for i in range(1, 6)])
    return j.select("frame", "point", "cam", r(u).alias("u"), r(v).alias("v"))


_ends = [X.sql_project(f"x{i}", f"y{i}", z, "c2") for i, z in ((1, "500.0"), (2, "-500.0"))]
#: The ray of one camera's pixel at two heights, both ends in one row.
EPIPOLAR_SQL = f"""{X.TRACKS_SQL}, one AS (SELECT frame, point, cam, u, v FROM obs WHERE cam=(frame+point)%3+1 AND u IS NOT NULL AND v IS NOT NULL),
pairs AS (SELECT a.cam, a.c, b.cam AS other, b.c AS c2 FROM camera a, camera b WHERE a.cam<>b.cam),
ray AS (SELECT frame, point, cam, other, c2, u*c[9]-c[1] AS a, u*c[10]-c[2] AS b, v*c[9]-c[5] AS d, v*c[10]-c[6] AS e, c[4]-u AS p, u*c[11]-c[3] AS pz, c[8]-v AS q, v*c[11]-c[7] AS qz FROM one JOIN pairs USING (cam)),
ends AS (SELECT *, ((p-500.0*pz)*e-b*(q-500.0*qz))/(a*e-b*d) AS x1, (a*(q-500.0*qz)-(p-500.0*pz)*d)/(a*e-b*d) AS y1, ((p+500.0*pz)*e-b*(q+500.0*qz))/(a*e-b*d) AS x2, (a*(q+500.0*qz)-(p+500.0*pz)*d)/(a*e-b*d) AS y2 FROM ray),
im AS (SELECT frame, point, cam, other, {_ends[0][0]} AS u1, {_ends[0][1]} AS v1, {_ends[1][0]} AS u2, {_ends[1][1]} AS v2 FROM ends),
li AS (SELECT *, (v2-v1)/(u2-u1) AS m FROM im)
SELECT frame, point, cam, other, round(m,5)+0.0 AS slope, round(v1-m*u1,3)+0.0 AS intercept FROM li"""


@query(EPIPOLAR_SQL)
def epipolar(spark, sf):
    # every point of every frame, seen by one of its cameras only
    alone = F.col("cam") == F.pmod(F.col("frame") + F.col("point"), F.lit(3)) + 1
    obs = X.observations(spark, sf).withColumns({c: F.when(alone, F.col(c)) for c in ("u", "v")})
    lines = tables.epipolar_lines(obs, X.cameras(spark))
    return lines.select("frame", "point", "cam", "other", r("slope").alias("slope"), r("intercept", 3).alias("intercept"))


@query(f"WITH {X.WORLD_SQL}, m AS (SELECT frame, point, x, y, z, e/1000 roll, e/700 pitch, e/900 yaw FROM world) SELECT frame, point, round(cos(pitch)*cos(yaw)*x+cos(pitch)*sin(yaw)*y-sin(pitch)*z,5)+0.0 AS bx, round((sin(roll)*sin(pitch)*cos(yaw)-cos(roll)*sin(yaw))*x+(sin(roll)*sin(pitch)*sin(yaw)+cos(roll)*cos(yaw))*y+sin(roll)*cos(pitch)*z,5)+0.0 AS bv, round((cos(roll)*sin(pitch)*cos(yaw)+sin(roll)*sin(yaw))*x+(cos(roll)*sin(pitch)*sin(yaw)-sin(roll)*cos(yaw))*y+cos(roll)*cos(pitch)*z,5)+0.0 AS bz, round(x*cos(roll)+y*sin(roll),5)+0.0 AS ax, round(y*cos(roll)-x*sin(roll),5)+0.0 AS ay, round(sqrt(x*x+y*y+z*z),5)+0.0 AS n FROM m")
def rotations(spark, sf):
    w = X.world(spark, sf)
    roll, pitch, yaw = F.col("e") / 1000, F.col("e") / 700, F.col("e") / 900
    p = (F.col("x"), F.col("y"), F.col("z"))
    bx, by, bz = G.apply_matrix(G.euler_matrix(roll, pitch, yaw), *p)
    ax, ay, _ = G.rotate_about(p, (F.lit(0.0), F.lit(0.0), F.lit(1.0)), roll)
    return w.select("frame", "point", r(bx).alias("bx"), r(by).alias("bv"), r(bz).alias("bz"), r(ax).alias("ax"), r(ay).alias("ay"), r(G.norm(*p)).alias("n"))


def _det3(*m: str) -> str:
    a, b, c, d, e, f, g, h, i = m
    return f"({a}*({e}*{i}-{f}*{h})-{b}*({d}*{i}-{f}*{g})+{c}*({d}*{h}-{e}*{g}))"


_M = [f"c[{i}]" for i in (1, 2, 3, 5, 6, 7, 9, 10, 11)]
_center = [_det3(*[("(-c[4])", "(-c[8])", "(-1.0)")[i // 3] if i % 3 == k else m for i, m in enumerate(_M)]) + "/" + _det3(*_M) for k in range(3)]
_dot = lambda i, j: "+".join(f"c[{i + k}]*c[{j + k}]" for k in range(3))
_turn = [f"(uo*c[{9 + i}]-c[{1 + i}])*d/fu" for i in range(3)] + [f"(vo*c[{9 + i}]-c[{5 + i}])*d/fv" for i in range(3)] + [f"c[{9 + i}]*d" for i in range(3)]
_T = [f"t{i}{j}" for i in (1, 2, 3) for j in (1, 2, 3)]
POSE_SQL = f"""WITH {X.RIG_SQL}, k AS (SELECT cam, c::DOUBLE[] AS c FROM camera), a AS (SELECT cam, c, {_center[0]} cx, {_center[1]} cy, {_center[2]} cz, 1/({_dot(9, 9)}) d2 FROM k), b AS (SELECT *, ({_dot(1, 9)})*d2 uo, ({_dot(5, 9)})*d2 vo, sqrt(d2) d FROM a), e AS (SELECT *, sqrt(greatest(0.0, d2*({_dot(1, 1)})-uo*uo)) fu, sqrt(greatest(0.0, d2*({_dot(5, 5)})-vo*vo)) fv FROM b), t AS (SELECT cam, cx, cy, cz, uo, vo, fu, fv, {', '.join(f'{x} {n}' for x, n in zip(_turn, _T))} FROM e), s AS (SELECT * REPLACE ({', '.join(f'{n}*CASE WHEN {_det3(*_T)}<0 THEN -1 ELSE 1 END AS {n}' for n in _T)}) FROM t), p AS (SELECT *, degrees(atan2(t21, t11)) yaw, degrees(asin(greatest(-1.0, least(1.0, -t31)))) pitch, degrees(atan2(t32, t33)) roll FROM s) SELECT cam, {', '.join(f'round({n},5)+0.0 AS {n}' for n in ('cx', 'cy', 'cz', 'uo', 'vo', 'fu', 'fv', *_T, 'yaw', 'pitch', 'roll'))} FROM p"""


@query(POSE_SQL)
def camera_poses(spark, sf):
    pose = solve.camera_pose(X.supplier_cameras(spark, sf))
    return rounded(pose, *[c for c in pose.columns if c != "cam"])


@query(f"WITH {X.RIG_SQL}, fl AS (SELECT cam, c[1:4] || [1024.0*c[9]-c[5], 1024.0*c[10]-c[6], 1024.0*c[11]-c[7], 1024.0-c[8]] || c[9:11] AS c FROM camera) SELECT cam, (i-1)::INT AS i, round(c[i],5)+0.0 AS value FROM (SELECT cam, c, unnest(range(1, 12)) AS i FROM fl) q")
def cameras_flipped(spark, sf):
    rig = X.supplier_cameras(spark, sf)
    flipped = solve.flip_vertical(rig, rig.select("cam", F.lit(1024.0).alias("height")))
    return rounded(flipped.select("cam", F.posexplode("c").alias("i", "value")), "value")


# aggregates, filters, joins

@query(f"WITH {X.SERIES_SQL} SELECT track, coalesce(round(sum(u),4),0.0)+0.0 AS total, round(avg(u),5)+0.0 AS mean, round(CASE WHEN count(u)=1 THEN 0.0 ELSE stddev_samp(u) END,5)+0.0 AS sd, count(u) AS n FROM series GROUP BY track")
def missing_aware(spark, sf):
    g = X.series(spark, sf).groupBy("track").agg(tables.nan_sum(F.col("u")).alias("total"), tables.nan_mean(F.col("u")).alias("mean"), tables.nan_std(F.col("u")).alias("sd"), F.count("u").alias("n"))
    return rounded(rounded(g, "mean", "sd"), "total", digits=4)


@query(f"{X.TRACKS_SQL} SELECT point, cam, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n_frames FROM obs WHERE u IS NOT NULL GROUP BY ALL")
def digitized_ranges(spark, sf):
    return tables.digitized_range(X.observations(spark, sf))


@query(f"{X.TRACKS_SQL} SELECT trial AS movie, frame FROM obs GROUP BY ALL HAVING count(u)>0")
def training_index(spark, sf):
    return tables.frames_with_points(X.observations(spark, sf))


@query(f"{X.TRACKS_SQL} SELECT trial AS movie, frame, cam, point, round(u,5)+0.0 AS u, round(v,5)+0.0 AS v, CASE WHEN frame%3=0 AND cam=2 THEN 1.5 ELSE 0.0 END::DOUBLE AS \"offset\" FROM obs WHERE u IS NOT NULL AND v IS NOT NULL")
def store_samples(spark, sf):
    obs = X.observations(spark, sf)
    offsets = obs.where("frame % 3 = 0 AND cam = 2").select(F.col("trial").alias("movie"), "frame", "cam", F.lit(1.5).alias("offset")).distinct()
    return rounded(tables.store_samples(tables.frames_with_points(obs), obs, offsets), "u", "v")


@query(f"{X.TRACKS_SQL} SELECT trial, frame, point, count(*) FILTER (u IS NOT NULL AND v IS NOT NULL) AS n_cams, count(u)+count(v) AS n_coords FROM obs GROUP BY ALL")
def visibility(spark, sf):
    return tables.visibility(X.observations(spark, sf))


BOXES = "b AS (SELECT trial, frame, cam, min(u) lo_u, max(u) hi_u, min(v) lo_v, max(v) hi_v FROM obs GROUP BY ALL)"


@query(f"{X.TRACKS_SQL}, {BOXES} SELECT trial, frame, cam, round(lo_u,5)+0.0 AS lo_u, round(hi_u,5)+0.0 AS hi_u, round(lo_v,5)+0.0 AS lo_v, round(hi_v,5)+0.0 AS hi_v, round(lo_u+(hi_u-lo_u)/2,5)+0.0 AS center_u, round(lo_v+(hi_v-lo_v)/2,5)+0.0 AS center_v, (ceil(greatest(hi_u-lo_u,hi_v-lo_v))*2)::BIGINT AS crop FROM b")
def bounding_boxes(spark, sf):
    return rounded(tables.bounding_boxes(X.observations(spark, sf)), "lo_u", "hi_u", "lo_v", "hi_v", "center_u", "center_v")


@query(f"{X.TRACKS_SQL}, {BOXES}, n AS (SELECT count(*) n_points FROM obs GROUP BY frame, cam) SELECT median(n_points)::DOUBLE AS median_points, (SELECT max((ceil(greatest(hi_u-lo_u,hi_v-lo_v))*2)::BIGINT) FROM b) AS max_crop FROM n")
def store_consistency(spark, sf):
    obs = X.observations(spark, sf)
    return tables.store_consistency(tables.bounding_boxes(obs), obs.groupBy("frame", "cam").agg(F.count("*").alias("n_points")))


@query("WITH f AS (SELECT DISTINCT l_orderkey::INT AS frame FROM lineitem), v(cam, frame_rate, n_frames) AS (VALUES (1, 100.0::DOUBLE, 20000), (2, 50.0, 6000), (3, 125.0, 15000)) SELECT frame, cam, CASE WHEN x BETWEEN 1 AND n_frames THEN x END AS video_frame FROM (SELECT frame, cam, n_frames, round(frame*(frame_rate/100.0)+CASE WHEN frame%4=0 AND cam=2 THEN 0.25 ELSE 0 END)::INT AS x FROM f, v) q")
def synchronise(spark, sf):
    frames = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("int").alias("frame")).distinct()
    video = spark.createDataFrame([(1, 100.0, 20000), (2, 50.0, 6000), (3, 125.0, 15000)], "cam int, frame_rate double, n_frames int")
    offsets = frames.where(F.pmod("frame", F.lit(4)) == 0).select("frame", F.lit(2).alias("cam"), F.lit(0.25).alias("offset"))
    return tables.synchronised(frames, video, offsets)


@query(f"{X.TRACKS_SQL}, k AS (SELECT trial, frame, cam, frame AS click_id, min(u)+3 AS cu, min(v)+2 AS cv FROM obs WHERE cam=1 AND u IS NOT NULL GROUP BY ALL), d AS (SELECT click_id, point, sqrt((u-cu)**2+(v-cv)**2) AS d FROM k JOIN obs USING (trial, frame, cam) WHERE u IS NOT NULL) SELECT click_id, arg_min(point, (d, point)) AS point, round(min(d),5)+0.0 AS distance FROM d GROUP BY click_id")
def nearest_tracks(spark, sf):
    obs = X.observations(spark, sf)
    clicks = obs.where("cam = 1 AND u IS NOT NULL").groupBy("trial", "frame", "cam").agg((F.min("u") + 3).alias("click_u"), (F.min("v") + 2).alias("click_v")).withColumn("click_id", F.col("frame"))
    return rounded(tables.nearest_track(clicks, obs), "distance")


@query(f"WITH {X.SERIES_SQL}, s AS (SELECT track trial, frame, 1 AS point, 'x' AS axis, u AS sd FROM series WHERE u>0), w AS (SELECT *, min(sd) OVER (PARTITION BY trial)/sd AS weight FROM s) SELECT trial, frame, point, axis, round(sd*1.96,5)+0.0 AS ci, round(weight,5)+0.0 AS weight, round(sum(weight*sd*sd) OVER (PARTITION BY trial),4)+0.0 AS tol FROM w")
def spline_weights(spark, sf):
    ci = X.series(spark, sf).where("u > 0").select(F.col("track").alias("trial"), "frame", F.lit(1).alias("point"), F.lit("x").alias("axis"), F.col("u").alias("sd"))
    w = tables.spline_weights(ci).drop("sd")
    return rounded(rounded(w, "ci", "weight"), "tol", digits=4)


@query("SELECT page_id, CASE WHEN e IN ('avi','mp4','mov') THEN 'container' WHEN e IN ('cin','cine') THEN 'cine' WHEN e='mrf' THEN 'mrf' WHEN e='cih' THEN 'cih' END AS kind, CASE WHEN page_id%3=0 THEN 1.0 ELSE (page_id%3)*60.0 END::DOUBLE AS rate FROM (SELECT page_id, ['mp4','cine','mrf','cih','txt'][(page_id%5)::INT+1] AS e FROM pages) q")
def media_routes(spark, sf):
    ext = F.get(F.array(*[F.lit(x) for x in ("MP4", "cine", "mrf", "Cih", "txt")]), F.pmod("page_id", F.lit(5)).cast("int"))
    rate = (F.col("page_id") % 3) * F.lit(60.0)
    return X.table(spark, sf, "pages").select("page_id", media_kind(F.concat("url", F.lit("/a."), ext)).alias("kind"), frame_rate(rate).alias("rate"))


# edits

def _edit(name: str, sql: str):
    return query(f"{X.TRACKS_SQL}, e AS ({sql}) SELECT trial, frame, point::INT AS point, cam, round(u,5)+0.0 AS u, round(v,5)+0.0 AS v FROM e")


def _shown(df: DataFrame) -> DataFrame:
    return rounded(df, "u", "v").select("trial", "frame", F.col("point").cast("int").alias("point"), "cam", "u", "v")


@_edit("join", "SELECT trial, frame, CASE WHEN point=5 THEN 2 WHEN point>5 THEN point-1 ELSE point END AS point, cam, avg(u) u, avg(v) v FROM obs GROUP BY 1, 2, 3, 4")
def edit_join(spark, sf):
    return _shown(edits.join_points(X.observations(spark, sf), 5, 2))


@_edit("delete", "SELECT trial, frame, CASE WHEN point>3 THEN point-1 ELSE point END AS point, cam, u, v FROM obs WHERE point<>3")
def edit_delete(spark, sf):
    return _shown(edits.delete_point(X.observations(spark, sf), 3))


@_edit("swap", "SELECT trial, frame, CASE WHEN frame BETWEEN 100 AND 5000 AND point=1 THEN 4 WHEN frame BETWEEN 100 AND 5000 AND point=4 THEN 1 ELSE point END AS point, cam, u, v FROM obs")
def edit_swap(spark, sf):
    return _shown(edits.swap_points(X.observations(spark, sf), 1, 4, 100, 5000))


@_edit("split", "SELECT trial, frame, CASE WHEN point=2 AND cam=3 AND frame BETWEEN 50 AND 900 THEN 8 ELSE point END AS point, cam, u, v FROM obs")
def edit_split(spark, sf):
    return _shown(edits.split_point(X.observations(spark, sf), 2, 3, 50, 2000, 7, 900))


@_edit("nudge", "SELECT trial, frame, point, cam, u, CASE WHEN point=1 AND cam=2 THEN v-0.5 ELSE v END AS v FROM obs")
def edit_nudge(spark, sf):
    return _shown(edits.nudge(X.observations(spark, sf), (F.col("point") == 1) & (F.col("cam") == 2), "up"))


@_edit("set", "SELECT trial, frame, point, cam, u, v FROM obs WHERE NOT (point=1 AND frame<500) UNION ALL SELECT trial, frame, point, cam, u+1, v+2 FROM obs WHERE point=1 AND frame<500 AND cam=1 AND u IS NOT NULL")
def edit_set(spark, sf):
    obs = X.observations(spark, sf)
    first = obs.where("point = 1 AND frame < 500")
    keep = F.col("cam") == 1
    clicks = first.select("trial", "frame", "point", "cam", F.when(keep, F.col("u") + 1).alias("u"), F.when(keep, F.col("v") + 2).alias("v"))
    return _shown(edits.set_points(obs, clicks))


_lu, _lv = (f"CASE WHEN f1 IS NULL OR u IS NULL OR v IS NULL THEN {w} ELSE {a}*((f1+f2)/2)+{c} END" for w, a, c in (("u", "x", "cx"), ("v", "y", "cy")))
RECOMPUTE_SQL = f"{X.TRACKS_SQL}, {X.LENS_SQL}, raw AS (SELECT * FROM obs), {_lens_sql(3).replace('FROM obs LEFT', 'FROM (SELECT trial, frame, CASE WHEN point>3 THEN point-1 ELSE point END AS point, cam, u, v FROM raw WHERE point<>3) o LEFT')}, flat AS (SELECT trial, frame, point, cam, {_lu} AS u, {_lv} AS v FROM s3), {SEEN.replace('FROM obs', 'FROM flat')}, {ROWS}, {SUMS}, {DET}, {XYZ}"


@query(f"{RECOMPUTE_SQL} SELECT p.trial, p.frame, p.point, round(any_value(p.x),5)+0.0 AS x, round(any_value(p.y),5)+0.0 AS y, round(any_value(p.z),5)+0.0 AS z, count(*)::INT AS n_cams, round(sqrt(sum(({_u}-s.u)**2+({_v}-s.v)**2)/(2*count(*)-3)),5)+0.0 AS rmse FROM xyz p JOIN seen s USING (trial, frame, point) GROUP BY p.trial, p.frame, p.point")
def recompute_all(spark, sf):
    return rounded(solve.reconstruct(edits.delete_point(X.observations(spark, sf), 3), X.cameras(spark), X.lenses(spark)), "x", "y", "z", "rmse")


MOVED = "moved AS (SELECT trial, frame, point, cam, u, CASE WHEN point=1 AND cam=2 THEN v-0.5 ELSE v END AS v FROM obs)"


@query(f"{X.TRACKS_SQL}, {MOVED}, {SEEN.replace('FROM obs', 'FROM moved')}, {ROWS}, {SUMS}, {DET}, {XYZ} SELECT p.trial, p.frame, p.point, round(any_value(p.x),5)+0.0 AS x, round(any_value(p.y),5)+0.0 AS y, round(any_value(p.z),5)+0.0 AS z, count(*)::INT AS n_cams, round(sqrt(sum(({_u}-s.u)**2+({_v}-s.v)**2)/(2*count(*)-3)),5)+0.0 AS rmse FROM xyz p JOIN seen s USING (trial, frame, point) GROUP BY p.trial, p.frame, p.point")
def nudge_recomputed(spark, sf):
    obs, camera = X.observations(spark, sf), X.cameras(spark)
    moved = edits.nudge(obs, (F.col("point") == 1) & (F.col("cam") == 2), "up")
    return rounded(edits.retriangulated(solve.reconstruct(obs, camera), moved, F.col("point") == 1, camera), "x", "y", "z", "rmse")


# time series

@query(f"WITH {X.SERIES_SQL}, w AS (SELECT track, frame, u, list(u) FILTER (u IS NOT NULL) OVER (PARTITION BY track ORDER BY frame RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS s FROM series) SELECT track, frame, round(s[len(s)])+0.0 AS static, CASE WHEN len(s)>=3 THEN round(round((4*s[len(s)]+s[len(s)-1]-2*s[len(s)-2])/3, 6))+0.0 END AS linear, CASE WHEN coalesce(len(s),0)=0 THEN NULL WHEN len(s)<3 THEN 1 WHEN len(s)<8 OR frame<11 THEN 2 ELSE 3 END AS mode FROM w")
def predictors(spark, sf):
    p = timeseries.predict(X.series(spark, sf))
    return p.select("track", "frame", (F.col("static") + 0.0).alias("static"), (F.col("linear") + 0.0).alias("linear"), "mode")


def _fill_sql(value: str) -> str:
    return f"WITH {X.SERIES_SQL}, f AS (SELECT track, frame, u, count(u) OVER (PARTITION BY track) n, last_value(u IGNORE NULLS) OVER lo u0, last_value(CASE WHEN u IS NOT NULL THEN frame END IGNORE NULLS) OVER lo f0, first_value(u IGNORE NULLS) OVER hi u1, first_value(CASE WHEN u IS NOT NULL THEN frame END IGNORE NULLS) OVER hi f1 FROM series WINDOW lo AS (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (PARTITION BY track ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT track, frame, round(coalesce(u, CASE WHEN n>=5 AND u0 IS NOT NULL AND u1 IS NOT NULL THEN {value} END),5)+0.0 AS filled, (u IS NULL)::INT AS fitted FROM f"


@query(_fill_sql("u0+(u1-u0)*((frame-f0)/(f1-f0))"))
def gaps_linear(spark, sf):
    return rounded(timeseries.fill_gaps(X.series(spark, sf)), "filled").drop("u")


@query(_fill_sql("CASE WHEN (frame-f0)/(f1-f0)<0.5 THEN u0 ELSE u1 END"))
def gaps_nearest(spark, sf):
    return rounded(timeseries.fill_gaps(X.series(spark, sf), "nearest"), "filled").drop("u")


@query(f"WITH {X.SERIES_SQL}, s AS (SELECT track, frame, u, (frame%4)*0.25 AS t, lag(u) OVER w a, lead(u) OVER w b FROM series WINDOW w AS (PARTITION BY track ORDER BY frame)) SELECT track, frame, round(coalesce(CASE WHEN t=0 THEN u WHEN u IS NOT NULL AND b IS NOT NULL THEN u+(b-u)*t WHEN u IS NOT NULL AND a IS NOT NULL THEN u+(u-a)*t WHEN a IS NOT NULL AND b IS NOT NULL THEN a+(b-a)*(1+t)/2 END, u),5)+0.0 AS at_offset FROM s")
def sub_frame(spark, sf):
    s = X.series(spark, sf).withColumn("offset", (F.col("frame") % 4) * F.lit(0.25) - 1)
    return rounded(timeseries.between_frames(s), "at_offset").drop("u", "offset")


@query(f"WITH {X.SERIES_SQL}, s AS (SELECT track, frame, count(*) OVER (PARTITION BY track) n FROM series) SELECT track, frame, CASE WHEN frame<11 THEN greatest(1, frame-10) ELSE greatest(1, least(n, frame+10)-20) END::INT AS first_frame, CASE WHEN frame<11 THEN least(n, 21) ELSE least(n, frame+10) END::INT AS last_frame FROM s")
def display_windows(spark, sf):
    from pyspark.sql import Window

    s = X.series(spark, sf).select("track", "frame", F.count("*").over(Window.partitionBy("track")).alias("n"))
    lo, hi = timeseries.display_window(F.col("frame"), 20, F.col("n"))
    return s.select("track", "frame", lo.cast("int").alias("first_frame"), hi.cast("int").alias("last_frame"))


@query(f"WITH {X.SERIES_SQL} SELECT track, frame, count(u) OVER w AS n_near, round(avg(u) OVER w,5)+0.0 AS mean_near FROM series WINDOW w AS (PARTITION BY track ORDER BY frame RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING)")
def neighbourhoods(spark, sf):
    return rounded(timeseries.neighbourhood(X.series(spark, sf)), "mean_near").drop("u")


@query(f"WITH {X.SERIES_SQL}, i AS (SELECT *, count(u) OVER (PARTITION BY track ORDER BY frame) k FROM series), q AS (SELECT track, frame, sum((u IS NULL)::INT) OVER (PARTITION BY track, k ORDER BY frame) f FROM i) SELECT track, frame, f::BIGINT AS failures, f>0 AS stops FROM q")
def failure_counters(spark, sf):
    return timeseries.failure_runs(X.series(spark, sf)).drop("u")


@query(f"WITH {X.SERIES_SQL}, d AS (SELECT track, frame, u, u-lag(u) OVER (PARTITION BY track ORDER BY frame) v FROM series) SELECT track, frame, round(v,5)+0.0 AS velocity, round(v-lag(v) OVER (PARTITION BY track ORDER BY frame),5)+0.0 AS acceleration FROM d")
def finite_differences(spark, sf):
    return rounded(timeseries.differences(X.series(spark, sf)), "velocity", "acceleration").drop("u")


@query(f"WITH {X.SERIES_SQL} SELECT track, frame, last_value(nullif(u,0) IGNORE NULLS) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pose FROM series")
def poses_carried(spark, sf):
    return timeseries.carry_forward(X.series(spark, sf)).drop("u")


@query(f"WITH {X.SERIES_SQL}, w AS (SELECT track, frame, array_agg(u) OVER (PARTITION BY track ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS b FROM series) SELECT track, frame, array_to_string([coalesce(round(x, 4)::DECIMAL(12,4)::VARCHAR, 'none') for x in list_reverse(b)], ' ') AS buffer FROM w")
def ring_buffers(spark, sf):
    shown = lambda x: F.when(F.isnan(x), "none").otherwise(F.round(x, 4).cast("decimal(12,4)").cast("string"))
    return timeseries.ring_buffer(X.series(spark, sf)).select("track", "frame", F.array_join(F.transform("buffer", shown), " ").alias("buffer"))


@query(f"WITH {X.SERIES_SQL}, d AS (SELECT track, frame, round(t-lag(t) OVER (PARTITION BY track ORDER BY frame),5) dt FROM (SELECT track, frame, frame*0.01+CASE WHEN frame=3 AND track::INT%2=0 THEN 0.004 ELSE 0 END AS t FROM series) q) SELECT track, count(DISTINCT CASE WHEN frame<=5 THEN dt END)>1 AS variable_timing, abs(arg_max(dt, frame)-0.01)<=0.0005 AS good_tail, count(*) AS n_frames FROM d GROUP BY track")
def frame_timing(spark, sf):
    t = F.col("frame") * F.lit(0.01) + F.when((F.col("frame") == 3) & (F.col("track").cast("int") % 2 == 0), 0.004).otherwise(0.0)
    return timeseries.timing(X.series(spark, sf).withColumn("t", t), 100.0)


# images

@query(f"WITH {X.PIXEL_SQL} SELECT id, row, col, round(CASE WHEN row<1 OR row>=7 OR col<1 OR col>=7 THEN 0.0 ELSE value END,5)+0.0 AS value FROM px")
def borders_cleared(spark, sf):
    return rounded(images.clear_borders(images.pixels(X.images(spark, sf), 8), 8, 8, 0.1), "value")


@query(f"WITH {X.PIXEL_SQL}, c AS (SELECT r, k FROM range(0,8,3) a(r), range(0,8,3) b(k)) SELECT id, r::INT AS row, k::INT AS col, round(sum(value),4)+0.0 AS value FROM px JOIN c ON abs(row-r)<=2 AND abs(col-k)<=2 GROUP BY ALL")
def blocks_scanned(spark, sf):
    return rounded(images.block_scan(images.pixels(X.images(spark, sf), 8), 8, 8, 4, 3), "value", digits=4)


@query(f"WITH {X.PIXEL_SQL} SELECT id, ((row//2+col//2)%2)::INT AS tile, round(sum(value),5)+0.0 AS total, count(*) AS n FROM px GROUP BY ALL")
def checkerboards(spark, sf):
    # every image under a board of 2 x 2 tiles of two pixels: 64 squares
    board = images.checkerboard(spark, 2, 2, 2).withColumnRenamed("value", "tile")
    px = images.pixels(X.images(spark, sf), 8).join(F.broadcast(board), ["row", "col"])
    return px.groupBy("id", "tile").agg(r(F.sum("value")).alias("total"), F.count("*").alias("n"))


_line = "({y}-(sy+coalesce((n*sxy-sx*sy)/nullif(n*sxx-sx*sx,0),0)*(n*{x}-sx))/n)"


@query(f"WITH {X.PIXEL_SQL}, a AS (SELECT id, row, col, value, count(*) OVER w n, sum(row) OVER w sx, sum(value) OVER w sy, sum(row*row) OVER w sxx, sum(row*value) OVER w sxy FROM px WINDOW w AS (PARTITION BY id, col)), b AS (SELECT id, row, col, {_line.format(y='value', x='row')} AS value FROM a), c AS (SELECT id, row, col, value, count(*) OVER w n, sum(col) OVER w sx, sum(value) OVER w sy, sum(col*col) OVER w sxx, sum(col*value) OVER w sxy FROM b WINDOW w AS (PARTITION BY id, row)) SELECT id, row, col, round({_line.format(y='value', x='col')},5)+0.0 AS value FROM c")
def detrended(spark, sf):
    return rounded(images.detrend(images.pixels(X.images(spark, sf), 8)), "value")


@query(f"WITH {X.PIXEL_SQL} SELECT id, row, col, round(coalesce(power((value-min(value) OVER w)/nullif(max(value) OVER w-min(value) OVER w,0),0.7),0),5)+0.0 AS value FROM px WINDOW w AS (PARTITION BY id)")
def gamma_scaled(spark, sf):
    return rounded(images.rescale(images.pixels(X.images(spark, sf), 8), 0.7), "value")


@query(f"WITH {X.PIXEL_SQL}, s AS (SELECT id, least(255, floor(round((value-min(value) OVER w)/nullif(max(value) OVER w-min(value) OVER w,0),6)*255+0.5))::INT b FROM px WINDOW w AS (PARTITION BY id)), h AS (SELECT id, b, count(*) n FROM s GROUP BY ALL), c AS (SELECT id, b, sum(n::DOUBLE) OVER u w0, sum(n*(b+1.0::DOUBLE)) OVER u m0, sum(n::DOUBLE) OVER a n, sum(n*(b+1.0::DOUBLE)) OVER a m FROM h WINDOW u AS (PARTITION BY id ORDER BY b), a AS (PARTITION BY id)), k AS (SELECT id, b, coalesce(round((m*w0-n*m0)**2/nullif(w0*(n-w0),0),6),-1.0) s FROM c) SELECT id, arg_min(b, (-s, b))/255.0::DOUBLE AS level FROM k GROUP BY id")
def otsu_levels(spark, sf):
    px = rounded(images.rescale(images.pixels(X.images(spark, sf), 8), 1.0), "value", digits=6)
    return images.otsu_level(px)


@query(f"WITH {X.PIXEL_SQL}, h AS (SELECT (id//4)::INT frame, (id%4)::INT channel, row, col, value score FROM px), m AS (SELECT frame, row, col, score mask FROM h WHERE channel=3), g AS (SELECT h.frame, channel, h.row, h.col, CASE WHEN mask>0.05 THEN score ELSE 0.0 END score FROM h LEFT JOIN m USING (frame, row, col) WHERE channel<>3), b AS (SELECT frame, channel, arg_min((row, col), (-score, col, row)) p, max(score) q FROM g GROUP BY ALL), n AS (SELECT g.frame, g.channel, q, sum(score) s, sum(score*col) sc, sum(score*row) sr FROM g JOIN b USING (frame, channel) WHERE abs(g.row-p[1])<=2 AND abs(g.col-p[2])<=2 GROUP BY ALL) SELECT frame, channel, round(CASE WHEN q>0.05 THEN coalesce(sc/nullif(s,0),0)/8*640 ELSE 0 END,2)+0.0 AS u, round(CASE WHEN q>0.05 THEN coalesce(sr/nullif(s,0),0)/8*480 ELSE 0 END,2)+0.0 AS v, round(CASE WHEN q>0.05 THEN q ELSE 0 END,5)+0.0 AS quality FROM n")
def heat_decoded(spark, sf):
    px = images.pixels(X.images(spark, sf), 8)
    heat = px.select(F.floor(F.col("id") / 4).cast("int").alias("frame"), (F.col("id") % 4).cast("int").alias("channel"), "row", "col", F.col("value").alias("score"))
    return rounded(rounded(images.decode_heat(heat, 3, 0.05, 8, 640, 480), "u", "v", digits=2), "quality")


@query("WITH i AS (SELECT label AS track, vec_id::INT AS frame, embedding AS pix FROM embeddings), j AS (SELECT a.track, a.frame, arg_min(a.frame-b.frame, (abs(a.frame-b.frame-3), a.frame-b.frame)) lag FROM i a JOIN i b ON a.track%1=b.track%1 AND a.frame-b.frame BETWEEN 3 AND 6 GROUP BY ALL) SELECT i.frame, lag::INT AS lag, round(i.pix[1]::DOUBLE-coalesce(o.pix[1]::DOUBLE,0),5)+0.0 AS first_pixel FROM i LEFT JOIN j ON i.frame=j.frame LEFT JOIN i o ON o.frame=i.frame-lag")
def backgrounds(spark, sf):
    im = X.images(spark, sf).select(F.lit(0).alias("track"), F.col("id").cast("int").alias("frame"), "pix")
    return timeseries.background(im).select("frame", "lag", r(F.col("pix")[0]).alias("first_pixel"))


# kernels: rows only, held against properties in tests

@query()
def calibrate_space(spark, sf):
    obj, clicks = X.calibration_clicks(spark, sf, 512)
    return calibrate.calibrate(clicks, obj, strict=False)


@query()
def calibrate_modified(spark, sf):
    obj, clicks = X.calibration_clicks(spark, sf, 512)
    return calibrate.calibrate(clicks, obj, "modified", strict=False)


@query()
def calibrate_plane(spark, sf):
    obj, _ = X.calibration_clicks(spark, sf, 512)
    u, v = G.project_plane(F.col("c"), F.col("x"), F.col("y"))
    clicks = obj.crossJoin(F.broadcast(X.plane_cameras(spark))).select("rig", "cam", "pt", F.round(u, 1).alias("u"), F.round(v, 1).alias("v"))
    return calibrate.calibrate(clicks, obj, "plane", strict=False)


@query()
def calibration_left_out(spark, sf):
    obj, clicks = X.calibration_clicks(spark, sf, 6)
    return calibrate.leave_one_out(clicks, obj)


@query()
def confidence_intervals(spark, sf):
    obs = X.observations(spark, sf)
    return uncertainty.bootstrap(obs, X.cameras(spark))


@query()
def predict_kalman(spark, sf):
    return kernels.predict_next(X.series(spark, sf))


@query()
def predict_double_exponential(spark, sf):
    return kernels.predict_next(X.series(spark, sf).where("u IS NOT NULL"), "double", 36)


@query()
def gaps_spline(spark, sf):
    return kernels.fill_spline(X.series(spark, sf))


@query()
def gaps_cubic(spark, sf):
    return kernels.fill_spline(X.series(spark, sf), "cubic")


@query()
def smoothed(spark, sf):
    s = X.series(spark, sf)
    return splines.smoothing_splines(s.withColumns({"weight": F.lit(1.0), "tol": F.lit(500.0)}))


@query()
def patches_matched(spark, sf):
    im = X.images(spark, sf)
    pairs = im.select("id", F.slice("pix", 19, 3).alias("a"), F.slice("pix", 27, 3).alias("b"), F.slice("pix", 35, 3).alias("c"), F.col("pix").alias("scene"))
    return kernels.match_patches(pairs.select("id", F.concat("a", "b", "c").alias("template"), "scene", F.lit(3).alias("th"), F.lit(3).alias("tw"), F.lit(8).alias("sh"), F.lit(8).alias("sw")))


@query()
def blob_centroids(spark, sf):
    return kernels.centroids(X.images(spark, sf).withColumns({"h": F.lit(8), "w": F.lit(8)}))
