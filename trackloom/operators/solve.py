"""Triangulation and camera algebra as aggregations.

The least-squares point of n cameras needs nine sums of products per (trial,
frame, point), which Spark combines before the shuffle; a 3 x 3 Cramer rule
solves them.  Cameras are a few rows and are always broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import lens_terms, project, ratio
from .sizes import few

KEY = ["trial", "frame", "point"]
COMPLETE = "u IS NOT NULL AND v IS NOT NULL"


def det3(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def cramer3(m: list[list[Column]], r: list[Column]) -> list[Column]:
    det = det3(m)
    return [ratio(det3([[r[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]), det) for k in range(3)]


def undistorted(obs: DataFrame, lens: DataFrame | None, rounds: int = 3) -> DataFrame:
    """Without lens distortion, by fixed-point rounds; a camera without a lens (cam, f1, f2, cx, cy, k1..k5) passes.

    Each round is a select of its own, so it is computed once and stays in
    whole-stage code.  Filter ``obs`` before and not the result: Spark would
    push the filter through the rounds and repeat their expressions in it.
    """
    if lens is None:
        return obs
    kept = [F.col(c) for c in obs.columns]
    model = lens.select("cam", ((F.col("f1") + F.col("f2")) / 2).alias("_f"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), *[F.col(f"k{i}").alias(f"_k{i}") for i in range(1, 6)])
    seen_x, seen_y, k = (F.col("u") - F.col("_cx")) / F.col("_f"), (F.col("v") - F.col("_cy")) / F.col("_f"), [F.col(f"_k{i}") for i in range(1, 6)]
    state = obs.join(few(model), "cam", "left").select(*kept, "_f", "_cx", "_cy", *k, seen_x.alias("_x"), seen_y.alias("_y"))
    for _ in range(rounds):
        radial, dx, dy = lens_terms(F.col("_x"), F.col("_y"), k)
        state = state.select(*kept, "_f", "_cx", "_cy", *k, ratio(seen_x - dx, radial).alias("_x"), ratio(seen_y - dy, radial).alias("_y"))
    moved = F.col("_f").isNotNull() & F.col("u").isNotNull() & F.col("v").isNotNull()
    flat = {"u": F.when(moved, F.col("_x") * F.col("_f") + F.col("_cx")).otherwise(F.col("u")), "v": F.when(moved, F.col("_y") * F.col("_f") + F.col("_cy")).otherwise(F.col("v"))}
    return state.select(*[flat.get(c, F.col(c)).alias(c) for c in obs.columns])


def equations(obs: DataFrame, camera: DataFrame) -> DataFrame:
    """Two rows of the linear system (a1, a2, a3 | b) per observation, which has to be complete."""
    j = obs.join(few(camera.where(F.size("c") == 11)), "cam")
    c, u, v = F.col("c"), F.col("u"), F.col("v")
    one = F.struct(*[(u * c[8 + i] - c[i]).alias(f"a{i}") for i in range(3)], (c[3] - u).alias("b"))
    two = F.struct(*[(v * c[8 + i] - c[4 + i]).alias(f"a{i}") for i in range(3)], (c[7] - v).alias("b"))
    return j.select(*KEY, "cam", F.explode(F.array(one, two)).alias("e")).select(*KEY, "cam", "e.*")


def triangulate(obs: DataFrame, camera: DataFrame, lens: DataFrame | None = None) -> DataFrame:
    """Points seen by two cameras or more: trial, frame, point, x, y, z, n_cams, algebraic_rmse."""
    eq = equations(undistorted(obs.where(COMPLETE), lens), camera)
    a, b = [F.col(f"a{i}") for i in range(3)], F.col("b")
    sums = {f"s{i}{j}": F.sum(a[i] * a[j]) for i in range(3) for j in range(i, 3)} | {f"r{i}": F.sum(a[i] * b) for i in range(3)} | {"bb": F.sum(b * b), "rows": F.count("b")}
    g = eq.groupBy(*KEY).agg(*[s.alias(n) for n, s in sums.items()]).where("rows >= 4")
    s = lambda i, j: F.col(f"s{min(i, j)}{max(i, j)}")
    x = cramer3([[s(i, j) for j in range(3)] for i in range(3)], [F.col(f"r{i}") for i in range(3)])
    g = g.select("*", *[p.alias(n) for p, n in zip(x, "xyz")])
    left = F.col("bb") - sum((F.col(n) * F.col(f"r{i}") for i, n in enumerate("xyz")), F.lit(0.0))
    rmse = F.sqrt(F.greatest(F.lit(0.0), left) / (F.col("rows") - 3))
    return g.select(*KEY, "x", "y", "z", (F.col("rows") / 2).cast("int").alias("n_cams"), rmse.alias("algebraic_rmse"))


def reprojection_rmse(obs: DataFrame, xyz: DataFrame, camera: DataFrame, compat: bool = False) -> DataFrame:
    """sqrt(sum of squared pixel errors / (coordinates - 3)) per point of ``xyz``; 0 instead of NULL with ``compat``."""
    j = obs.where(COMPLETE).join(few(camera), "cam").join(xyz.select(*KEY, "x", "y", "z"), KEY)
    u, v = project(F.col("c"), F.col("x"), F.col("y"), F.col("z"))
    g = j.groupBy(*KEY).agg(F.sum((u - F.col("u")) ** 2 + (v - F.col("v")) ** 2).alias("ss"), F.count("*").alias("n"))
    out = xyz.join(g, KEY, "left")
    rmse = F.sqrt(ratio(F.col("ss"), 2 * F.col("n") - F.lit(3)))
    return out.withColumn("rmse", F.coalesce(rmse, F.lit(0.0)) if compat else rmse).drop("ss", "n")


def located(obs: DataFrame, camera: DataFrame) -> DataFrame:
    """The observations, which have to be complete, with the point that they give: trial, frame, point, cam, u, v, x, y, z, n_cams, miss.

    ``miss`` is the squared distance from the reprojected point; points that
    fewer than two cameras see are left out.  One sort by point, in which its
    rows get their sums: nothing is collected, so no aggregate falls back to
    sorting rows and buffers with lists in them.  The few cameras are looked up
    in a broadcast map for the residual.
    """
    usable = camera.where(F.size("c") == 11)
    good = obs.join(few(usable), "cam")
    c, u, v = F.col("c"), F.col("u"), F.col("v")
    one, two = [u * c[8 + i] - c[i] for i in range(3)], [v * c[8 + i] - c[4 + i] for i in range(3)]
    b1, b2 = c[3] - u, c[7] - v
    products = [(one[i] * one[j] + two[i] * two[j]).alias(f"s{i}{j}") for i in range(3) for j in range(i, 3)]
    products += [(one[i] * b1 + two[i] * b2).alias(f"r{i}") for i in range(3)]
    rows = good.select(*KEY, "cam", "u", "v", *products)
    sums = [F.sum(n).over(of_point()).alias(n) for n in rows.columns[6:]]
    n = F.count(F.when(u.isNotNull() & v.isNotNull(), 1)).over(of_point()).cast("int")
    g = rows.select(*KEY, "cam", "u", "v", *sums, n.alias("n_cams")).where("n_cams >= 2")
    s = lambda i, j: F.col(f"s{min(i, j)}{max(i, j)}")
    xyz = cramer3([[s(i, j) for j in range(3)] for i in range(3)], [F.col(f"r{i}") for i in range(3)])
    g = g.select(*KEY, "cam", "u", "v", "n_cams", *[p.alias(k) for p, k in zip(xyz, "xyz")])
    known = usable.agg(F.map_from_entries(F.collect_list(F.struct("cam", "c"))).alias("cams"))  # one row
    back = g.crossJoin(few(known)).select(*g.columns, F.element_at("cams", F.col("cam")).alias("c"))
    pu, pv = project(c, F.col("x"), F.col("y"), F.col("z"))
    miss = (pu - u) * (pu - u) + (pv - v) * (pv - v)
    return back.select(*KEY, "cam", "u", "v", "x", "y", "z", "n_cams", miss.alias("miss"))


def of_point() -> WindowSpec:
    """All rows of a point by camera; frames, which differ most, are compared first."""
    return Window.partitionBy("frame", "point", "trial").orderBy("cam").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def residual(miss: Column, known: Column) -> Column:
    """The residual of a point from its sum and count of ``miss``; NULL where an observation has none."""
    n = F.col("n_cams")
    return F.when(known == n, F.sqrt(miss / (2 * n - 3)))


def sightings(obs: DataFrame, camera: DataFrame) -> DataFrame:
    """Triangulation with the observations next to the point: trial, frame, point, seen (cam, u, v) by camera, x, y, z, n_cams, rmse."""
    rows = located(obs, camera)
    seen = F.collect_list(F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), F.struct("cam", "u", "v")))
    once = F.row_number().over(Window.partitionBy("frame", "point", "trial").orderBy("cam"))
    all_ = rows.select("*", seen.over(of_point()).alias("seen"), F.sum("miss").over(of_point()).alias("ss"), F.count("miss").over(of_point()).alias("known"), once.alias("once"))
    return all_.where("once = 1").select(*KEY, "seen", "x", "y", "z", "n_cams", residual(F.col("ss"), F.col("known")).alias("rmse"))


def reconstruct(obs: DataFrame, camera: DataFrame, lens: DataFrame | None = None) -> DataFrame:
    """Triangulation with reprojection residual in one shuffle: trial, frame, point, x, y, z, n_cams, rmse."""
    rows = located(undistorted(obs.where(COMPLETE), lens), camera)
    g = rows.groupBy(*KEY).agg(*[F.first(k).alias(k) for k in ("x", "y", "z", "n_cams")], F.sum("miss").alias("ss"), F.count("miss").alias("known"))
    return g.select(*KEY, "x", "y", "z", "n_cams", residual(F.col("ss"), F.col("known")).alias("rmse"))


def reconstruct_plane(obs: DataFrame, camera: DataFrame) -> DataFrame:
    """Planar points from one camera or more: trial, frame, point, x, y, z = 0, n_cams, rmse (NULL from one camera)."""
    j = obs.where(COMPLETE).join(few(camera.where(F.size("c") == 8)), "cam")
    c, u, v = F.col("c"), F.col("u"), F.col("v")
    a1, a2, p = u * c[6] - c[0], u * c[7] - c[1], c[2] - u
    d1, d2, q = v * c[6] - c[3], v * c[7] - c[4], c[5] - v
    g = j.groupBy(*KEY).agg(
        F.sum(a1 * a1 + d1 * d1).alias("s11"), F.sum(a1 * a2 + d1 * d2).alias("s12"), F.sum(a2 * a2 + d2 * d2).alias("s22"),
        F.sum(a1 * p + d1 * q).alias("r1"), F.sum(a2 * p + d2 * q).alias("r2"), F.sum(p * p + q * q).alias("bb"), F.count("*").alias("n"),
    )
    det = F.col("s11") * F.col("s22") - F.col("s12") * F.col("s12")
    x, y = ratio(F.col("r1") * F.col("s22") - F.col("s12") * F.col("r2"), det), ratio(F.col("s11") * F.col("r2") - F.col("s12") * F.col("r1"), det)
    g = g.select("*", x.alias("x"), y.alias("y"))
    left = F.greatest(F.lit(0.0), F.col("bb") - F.col("x") * F.col("r1") - F.col("y") * F.col("r2"))
    return g.select(*KEY, "x", "y", F.lit(0.0).alias("z"), F.col("n").cast("int").alias("n_cams"), F.when(F.col("n") > 1, F.sqrt(left / (2 * F.col("n") - 2))).alias("rmse"))


def camera_pose(camera: DataFrame) -> DataFrame:
    """Center, principal point, focal lengths, rotation rows and yaw, pitch, roll in degrees of each camera."""
    c = F.col("c")
    m, rhs = [[c[0], c[1], c[2]], [c[4], c[5], c[6]], [c[8], c[9], c[10]]], [-c[3], -c[7], F.lit(-1.0)]
    d2 = ratio(F.lit(1.0), c[8] * c[8] + c[9] * c[9] + c[10] * c[10])
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    uo, vo = dot(m[0], m[2]) * d2, dot(m[1], m[2]) * d2
    df = camera.where(F.size("c") == 11).select("cam", *[p.alias(n) for p, n in zip(cramer3(m, rhs), ("cx", "cy", "cz"))], d2.alias("d2"), uo.alias("uo"), vo.alias("vo"), "c")
    d = F.sqrt("d2")
    fu = F.sqrt(F.greatest(F.lit(0.0), F.col("d2") * dot(m[0], m[0]) - F.col("uo") * F.col("uo")))
    fv = F.sqrt(F.greatest(F.lit(0.0), F.col("d2") * dot(m[1], m[1]) - F.col("vo") * F.col("vo")))
    df = df.select("*", d.alias("d"), fu.alias("fu"), fv.alias("fv"))
    d, fu, fv, uo, vo = (F.col(n) for n in ("d", "fu", "fv", "uo", "vo"))
    t = [[ratio((uo * c[8 + i] - c[i]) * d, fu) for i in range(3)], [ratio((vo * c[8 + i] - c[4 + i]) * d, fv) for i in range(3)], [c[8 + i] * d for i in range(3)]]
    sign = F.when(det3(t) < 0, -1.0).otherwise(1.0)
    df = df.select("cam", "cx", "cy", "cz", "uo", "vo", "fu", "fv", *[(t[i][j] * sign).alias(f"t{i + 1}{j + 1}") for i in range(3) for j in range(3)])
    return df.select(
        "*",
        F.degrees(F.atan2(F.col("t21"), F.col("t11"))).alias("yaw"),
        F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.col("t31"))))).alias("pitch"),
        F.degrees(F.atan2(F.col("t32"), F.col("t33"))).alias("roll"),
    )


def flip_vertical(camera: DataFrame, heights: DataFrame) -> DataFrame:
    """Coefficients for images turned upside down: v becomes height - v.  ``heights`` has cam, height."""
    c, h = F.col("c"), F.col("height")
    flipped = [h * c[8 + i] - c[4 + i] for i in range(3)] + [h - c[7]]
    return camera.join(few(heights), "cam").select("cam", F.array(*[c[i] for i in range(4)], *flipped, *[c[i] for i in range(8, 11)]).alias("c"))
