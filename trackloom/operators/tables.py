"""Filters, implicit joins and missing-aware aggregates over the long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import epipolar_line, project, video_frame
from .sizes import few


def zero_is_missing(value: Column) -> Column:
    """Sparse layouts store missing as 0, dense ones as NaN; both become NULL."""
    return F.nullif(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0))


def nan_sum(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def nan_mean(value: Column) -> Column:
    return F.avg(value)


def nan_std(value: Column) -> Column:
    """Sample deviation; 0 of a single value."""
    return F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value))


def project_all(xyz: DataFrame, camera: DataFrame) -> DataFrame:
    """Every point in every camera; the cameras are a few broadcast rows."""
    u, v = project(F.col("c"), F.col("x"), F.col("y"), F.col("z"))
    return xyz.crossJoin(few(camera)).select("trial", "frame", "point", "cam", u.alias("u"), v.alias("v"))


def epipolar_lines(obs: DataFrame, camera: DataFrame) -> DataFrame:
    """For points that one camera sees, the line in each other camera."""
    good = obs.where("u IS NOT NULL AND v IS NOT NULL")
    one = good.groupBy("trial", "frame", "point").agg(F.count("*").alias("n"), F.first("cam").alias("cam"), F.first("u").alias("u"), F.first("v").alias("v")).where("n = 1")
    own = camera.select("cam", F.col("c").alias("c1"))
    other = camera.select(F.col("cam").alias("other"), F.col("c").alias("c2"))
    j = one.join(few(own), "cam").join(few(other), F.col("cam") != F.col("other"))
    slope, intercept = epipolar_line(F.col("c1"), F.col("c2"), F.col("u"), F.col("v"))
    return j.select("trial", "frame", "point", "cam", "other", slope.alias("slope"), intercept.alias("intercept"))


def synchronised(frames: DataFrame, video: DataFrame, offsets: DataFrame) -> DataFrame:
    """Own frame of each camera at every master frame (NULL outside its video)."""
    first = video.groupBy().agg(F.min_by("frame_rate", "cam").alias("first_rate"))
    j = frames.crossJoin(few(video)).crossJoin(few(first)).join(offsets, ["frame", "cam"], "left")
    return j.select("frame", "cam", video_frame(F.col("frame"), F.col("frame_rate"), F.col("first_rate"), F.col("offset"), F.col("n_frames")).alias("video_frame"))


def digitized_range(obs: DataFrame) -> DataFrame:
    """First and last digitized frame of each point and camera."""
    return obs.where("u IS NOT NULL").groupBy("point", "cam").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("n_frames"))


def frames_with_points(obs: DataFrame) -> DataFrame:
    """The training index: frames with at least one coordinate per movie (trial)."""
    return obs.groupBy(F.col("trial").alias("movie"), "frame").agg(F.count("u").alias("n")).where("n > 0").select("movie", "frame")


def store_samples(index: DataFrame, obs: DataFrame, offsets: DataFrame) -> DataFrame:
    """Training rows of the index (movie, frame): the points of each camera with the camera's offset, 0 without one."""
    own = obs.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("trial").alias("movie"), "frame", "cam", "point", "u", "v")
    joined = index.join(own, ["movie", "frame"]).join(offsets.select("movie", "frame", "cam", "offset"), ["movie", "frame", "cam"], "left")
    return joined.select("movie", "frame", "cam", "point", "u", "v", F.coalesce("offset", F.lit(0.0)).alias("offset"))


def visibility(obs: DataFrame) -> DataFrame:
    """Cameras and finite coordinates per point."""
    return obs.groupBy("trial", "frame", "point").agg(F.count(F.when(F.col("u").isNotNull() & F.col("v").isNotNull(), 1)).alias("n_cams"), (F.count("u") + F.count("v")).alias("n_coords"))


def bounding_boxes(obs: DataFrame) -> DataFrame:
    """Box around the points of a frame and camera: center and crop side."""
    g = obs.groupBy("trial", "frame", "cam").agg(*[f(c).alias(f"{n}_{c}") for c in ("u", "v") for n, f in (("lo", F.min), ("hi", F.max))])
    width, height = F.col("hi_u") - F.col("lo_u"), F.col("hi_v") - F.col("lo_v")
    return g.select("trial", "frame", "cam", "lo_u", "hi_u", "lo_v", "hi_v", (F.col("lo_u") + width / 2).alias("center_u"), (F.col("lo_v") + height / 2).alias("center_v"), (F.ceil(F.greatest(width, height)) * 2).cast("long").alias("crop"))


def store_consistency(boxes: DataFrame, points: DataFrame) -> DataFrame:
    """Median number of points and largest crop over all stores."""
    return points.agg(F.median("n_points").alias("median_points")).crossJoin(boxes.agg(F.max("crop").alias("max_crop")))


def nearest_track(clicks: DataFrame, obs: DataFrame) -> DataFrame:
    """Nearest point of the clicked frame and camera; the smaller number on ties."""
    j = clicks.join(obs.where("u IS NOT NULL AND v IS NOT NULL"), ["trial", "frame", "cam"])
    far = F.sqrt((F.col("u") - F.col("click_u")) ** 2 + (F.col("v") - F.col("click_v")) ** 2)
    return j.groupBy("click_id").agg(F.min(F.struct(far.alias("distance"), "point")).alias("m")).select("click_id", "m.point", "m.distance")


def tidy_polyline(samples: DataFrame, controls: DataFrame, reach: float = 50.0, huge: float = 1e10) -> DataFrame:
    """Drop samples of a distorted line that are far from every control point, and order the rest by x."""
    near = samples.where(F.abs("x") <= huge).join(controls, "line_id").groupBy("line_id", "sample_id", "x", "y").agg(F.min(F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)).alias("d")).where(F.col("d") <= reach)
    return near.select("line_id", F.row_number().over(Window.partitionBy("line_id").orderBy("x", "sample_id")).alias("place"), "x", "y")


def shown_offset(offsets: DataFrame) -> DataFrame:
    """Offset to show for cameras from the second on: the rounded mean of those that are not zero."""
    return offsets.where("cam >= 2").groupBy("cam").agg(F.round(F.avg(F.nullif("offset", F.lit(0.0)))).alias("offset"))


def spline_weights(ci: DataFrame) -> DataFrame:
    """Weights min(sd)/sd per track and axis, and the tolerance sum(w sd^2), from sd per frame."""
    w = F.min("sd").over(Window.partitionBy("trial", "point", "axis")) / F.nullif("sd", F.lit(0.0))
    df = ci.select("trial", "frame", "point", "axis", "sd", w.alias("weight"))
    tol = F.sum(F.col("weight") * F.col("sd") * F.col("sd")).over(Window.partitionBy("trial", "point", "axis"))
    return df.select("trial", "frame", "point", "axis", "sd", (F.col("sd") * 1.96).alias("ci"), "weight", tol.alias("tol"))
