"""Text layouts of tracking data: flat CSV, sparse TSV, coefficients, lenses, projects."""

from __future__ import annotations

import itertools
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sizes import few
from ..operators.tables import zero_is_missing


def media_kind(path: Column) -> Column:
    """Route by extension, whatever its case."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(ext.isin("avi", "mp4", "mov"), "container").when(ext.isin("cin", "cine"), "cine").when(ext == "mrf", "mrf").when(ext == "cih", "cih")


def frame_rate(rate: Column) -> Column:
    return F.when(rate.isNull() | F.isnan(rate) | (rate == 0), 1.0).otherwise(rate)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """CSV lines with ``frame``, their number from 1 over the files in order of name.

    Lines are counted per split of a file; the splits, a few rows, are put in
    order of file and position, whatever order Spark reads them in.
    """
    placed = lines.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    splits = placed.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("_file", "_start", "_first", before.alias("_before"))
    return placed.join(few(splits), ["_file", "_start"]).withColumn("frame", (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_file", "_start", "_at", "_first", "_before")


def read_flat(spark: SparkSession, path: str, trial: str) -> DataFrame:
    """``pt{p}_cam{c}_X/Y`` columns, one line per frame, to obs; NaN is missing."""
    lines = spark.read.option("header", True).csv(path, inferSchema=False)
    heads = [c for c in lines.columns if c.endswith("_X") and "_cam" in c]
    if not heads or any(c[:-1] + "Y" not in lines.columns for c in heads):
        raise ValueError(f"{path}: no pairs of pt_cam columns")
    cells = F.array(*[F.struct(F.lit(int(c[2:].split("_")[0])).alias("point"), F.lit(int(c.split("_cam")[1].split("_")[0])).alias("cam"), F.col(f"`{c}`").cast("double").alias("u"), F.col(f"`{c[:-1]}Y`").cast("double").alias("v")) for c in heads])
    long = numbered_lines(lines).select(F.lit(trial).alias("trial"), "frame", F.explode(cells).alias("o")).select("trial", "frame", "o.*")
    missing = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return long.select("trial", "frame", "point", "cam", missing(F.col("u")).alias("u"), missing(F.col("v")).alias("v")).where("u IS NOT NULL OR v IS NOT NULL")


#: The wide layouts: the keys of a cell, and the headers of its values.
LAYOUTS = {
    "xypts": (("point", "cam"), {"u": "pt{}_cam{}_X", "v": "pt{}_cam{}_Y"}),
    "xyzpts": (("point",), {"x": "pt{}_X", "y": "pt{}_Y", "z": "pt{}_Z"}),
    "xyzres": (("point",), {"rmse": "pt{}_dltres"}),
    "offsets": (("cam",), {"offset": "cam{}_offset"}),
    "xyzCI": (("point",), {"x": "pt{}_X+-CI", "y": "pt{}_Y+-CI", "z": "pt{}_Z+-CI"}),
    "xyzFilt": (("point",), {"x": "pt{}filt_X", "y": "pt{}filt_Y", "z": "pt{}filt_Z"}),
    "clicks": (("cam",), {"u": "cam{}_X", "v": "cam{}_Y"}),
}


def layout_headers(kind: str, n_points: int, n_cams: int) -> list[tuple[tuple[int, ...], str, str]]:
    """(key, value column, header) of every column of a layout, in its order."""
    keys, values = LAYOUTS[kind]
    counts = {"point": n_points, "cam": n_cams}
    cells = itertools.product(*[range(1, counts[k] + 1) for k in keys])
    return [(cell, value, header.format(*cell)) for cell in cells for value, header in values.items()]


def write_wide(values: DataFrame, path: str, kind: str, n_frames: int, n_points: int, n_cams: int = 0) -> None:
    """One of ``LAYOUTS``, every frame a line, ``%.6f``; missing is NaN, an offset 0.  ``values`` is of one trial.

    The mean stands where a frame has a cell twice.
    """
    if "trial" in values.columns and values.select("trial").distinct().limit(2).count() > 1:
        raise ValueError("a file holds one trial")
    keys, _ = LAYOUTS[kind]
    none = "0.000000" if kind == "offsets" else "NaN"
    columns = layout_headers(kind, n_points, n_cams)
    held = lambda cell: reduce(lambda a, b: a & b, [F.col(k) == n for k, n in zip(keys, cell)])
    number = lambda i: F.coalesce(F.format_string("%.6f", F.when(F.col(f"c{i}").isNotNull(), F.col(f"c{i}"))), F.lit(none))
    wide = values.groupBy("frame").agg(*[F.avg(F.when(held(cell), F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")))).alias(f"c{i}") for i, (cell, v, _) in enumerate(columns)])
    frames = values.sparkSession.range(1, n_frames + 1).select(F.col("id").cast("int").alias("frame"))
    shown = [F.when(F.col(f"c{i}").isNull(), none).otherwise(number(i)).alias(header) for i, (_, _, header) in enumerate(columns)]
    frames.join(wide, "frame", "left").orderBy("frame").select(*shown).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_wide(spark: SparkSession, path: str, kind: str, n_points: int, n_cams: int = 0) -> DataFrame:
    """A layout back to rows: frame, its keys and values; cells without any value are left out.

    Other columns than the layout has for so many points and cameras are an error.
    """
    keys, values = LAYOUTS[kind]
    lines = spark.read.option("header", True).csv(path, inferSchema=False)
    columns = layout_headers(kind, n_points, n_cams)
    if lines.columns != [header for _, _, header in columns]:
        raise ValueError(f"{path}: not the columns of {kind} for {n_points} points and {n_cams} cameras")
    number = lambda header: F.nanvl(F.col(f"`{header}`").cast("double"), F.lit(None).cast("double"))
    by_cell: dict[tuple[int, ...], dict[str, str]] = {}
    for cell, value, header in columns:
        by_cell.setdefault(cell, {})[value] = header
    cells = F.array(*[F.struct(*[F.lit(n).alias(k) for k, n in zip(keys, cell)], *[number(own[v]).alias(v) for v in values]) for cell, own in by_cell.items()])
    long = numbered_lines(lines).select("frame", F.explode(cells).alias("o")).select("frame", "o.*")
    return long.where(F.coalesce(*values).isNotNull())


def write_flat(obs: DataFrame, path: str, n_frames: int, n_points: int, n_cams: int) -> None:
    """The layout of image points."""
    write_wide(obs, path, "xypts", n_frames, n_points, n_cams)


def write_clicks(cal_obs: DataFrame, path: str, n_points: int, n_cams: int) -> None:
    """The clicks of a calibration (pt, cam, u, v): a line per point of the object."""
    write_wide(cal_obs.withColumnRenamed("pt", "frame"), path, "clicks", n_points, 0, n_cams)


def read_clicks(spark: SparkSession, path: str, n_cams: int) -> DataFrame:
    """The clicks of a calibration back: pt, cam, u, v; a click without one of u and v is none."""
    found = read_wide(spark, path, "clicks", 0, n_cams)
    return found.where("u IS NOT NULL AND v IS NOT NULL").select(F.col("frame").alias("pt"), "cam", "u", "v")


def can_calibrate(cal_obs: DataFrame, planar: bool = False) -> DataFrame:
    """(cam, n_points, enough): whether a camera has the six clicks (four in a plane) that a calibration needs."""
    complete = F.col("u").isNotNull() & F.col("v").isNotNull()
    n = cal_obs.groupBy("cam").agg(F.count(F.when(complete, 1)).cast("int").alias("n_points"))
    return n.withColumn("enough", F.col("n_points") >= (4 if planar else 6))


GRAY = "path string, height int, width int, pix array<double>"


def read_calibration_images(spark: SparkSession, path: str) -> DataFrame:
    """Still images of a calibration as gray ones, their first (red) channel: path, height, width, pix.

    Spark's image source reads them; files that are no images have no row.
    """
    found = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def gray(batches):
        for g in batches:
            # the source keeps colours as blue, green, red
            pix = [np.frombuffer(data, np.uint8).reshape(h, w, n)[:, :, 2 if n >= 3 else 0].astype(float).ravel() for h, w, n, data in zip(g["height"], g["width"], g["nChannels"], g["data"])]
            yield pd.DataFrame({"path": g["origin"], "height": g["height"], "width": g["width"], "pix": pd.Series(pix, dtype=object)})

    return found.mapInPandas(gray, GRAY)


def read_sparse(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """Sparse matrix text to (i, j, value): a title, ``rows cols nnz``, then triples; duplicates add up."""
    text = spark.read.option("wholetext", False).text(path)
    parts = F.split("value", delimiter)
    triples = text.select(parts.alias("p")).where((F.size("p") == 3) & F.get("p", F.lit(2)).contains("."))
    cells = triples.select(F.get("p", F.lit(0)).cast("int").alias("i"), F.get("p", F.lit(1)).cast("int").alias("j"), F.get("p", F.lit(2)).cast("double").alias("value"))
    return cells.groupBy("i", "j").agg(F.sum("value").alias("value"))


def write_sparse(cells: DataFrame, path: str, title: str, rows: int, cols: int) -> None:
    """Column-major triples with six decimals; NULL, NaN and 0 are absent."""
    spark = cells.sparkSession
    full = cells.select("i", "j", zero_is_missing(F.col("value")).alias("value")).where("value IS NOT NULL")
    head = spark.createDataFrame([(0, 0, title), (0, 1, f"{rows}\t{cols}\t{full.count()}")], "j int, i int, line string")
    body = full.select(F.col("j").cast("int"), F.col("i").cast("int"), F.format_string("%d\t%d\t%.6f", F.col("i").cast("long"), F.col("j").cast("long"), "value").alias("line"))
    head.unionByName(body).repartition(1).sortWithinPartitions("j", "i").select("line").write.mode("overwrite").text(path)


def obs_cells(obs: DataFrame, n_cams: int) -> DataFrame:
    """Long observations to sparse cells: u at 2c - 1 + 2 n (p - 1), v one further."""
    col = (F.col("cam") * 2 - 1 + (F.col("point") - 1) * 2 * n_cams).cast("int")
    return obs.select(F.col("frame").alias("i"), F.explode(F.array(F.struct(col.alias("j"), F.col("u").alias("value")), F.struct((col + 1).alias("j"), F.col("v").alias("value")))).alias("x")).select("i", "x.j", "x.value")


def cells_obs(cells: DataFrame, n_cams: int, trial: str) -> DataFrame:
    """The inverse of obs_cells."""
    at = F.col("j") - 1
    g = cells.groupBy(F.lit(trial).alias("trial"), F.col("i").alias("frame"), (F.floor(at / (2 * n_cams)) + 1).cast("int").alias("point"), (F.floor((at % (2 * n_cams)) / 2) + 1).cast("int").alias("cam"))
    return g.agg(F.max(F.when(at % 2 == 0, F.col("value"))).alias("u"), F.max(F.when(at % 2 == 1, F.col("value"))).alias("v"))


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """11 or 8 lines, one column per camera, no header."""
    lines = [[float(x) for x in r.value.split(",")] for r in spark.read.text(path).collect() if r.value.strip()]  # a fixed eight or eleven lines
    if len(lines) not in (8, 11):
        raise ValueError(f"{path}: {len(lines)} coefficients")
    return spark.createDataFrame([(i + 1, list(c)) for i, c in enumerate(zip(*lines))], "cam int, c array<double>")


def write_coefficients(camera: DataFrame, path: str) -> None:
    """A line per coefficient and a column per camera, no header; all cameras have as many coefficients."""
    rows = sorted((r.cam, list(r.c)) for r in camera.collect())  # a few cameras
    if len({len(c) for _, c in rows}) != 1:
        raise ValueError("cameras with different numbers of coefficients")
    lines = [(i, ",".join(f"{x:.12g}" for x in line)) for i, line in enumerate(zip(*[c for _, c in rows]))]
    camera.sparkSession.createDataFrame(lines, "i int, line string").repartition(1).sortWithinPartitions("i").select("line").write.mode("overwrite").text(path)


def read_object(spark: SparkSession, path: str) -> DataFrame:
    """Calibration object: a header and two or three columns; point numbers are line numbers."""
    lines = spark.read.text(path).collect()[1:]  # a hand-measured object: some dozens of lines
    rows = [[float(x) for x in r.value.split(",")] for r in lines if r.value.strip()]
    if any(len(r) not in (2, 3) for r in rows):
        raise ValueError(f"{path}: two or three columns are needed")
    return spark.createDataFrame([(i + 1, *r[:2], r[2] if len(r) == 3 else None) for i, r in enumerate(rows)], "pt int, x double, y double, z double")


def read_lenses(spark: SparkSession, path: str, cam: int | None = None) -> DataFrame:
    """Twelve columns per camera: id, f, width, height, cx, cy, unused, k1..k5."""
    rows = [[float(x) for x in r.value.split()] for r in spark.read.text(path).collect() if r.value.strip()]  # a line per camera
    if any(len(r) != 12 for r in rows):
        raise ValueError(f"{path}: twelve columns are needed")
    return spark.createDataFrame([(cam if cam and len(rows) == 1 else i + 1, r[1], r[1], r[4], r[5], *r[7:12]) for i, r in enumerate(rows)], "cam int, f1 double, f2 double, cx double, cy double, k1 double, k2 double, k3 double, k4 double, k5 double")


def read_cih(spark: SparkSession, path: str) -> DataFrame:
    """``key : value`` header lines, without blanks, comments and what follows END."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", r"(?s)(^|\n)END\b.*", "").alias("value"))
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))
    kept = lines.where((F.col("n") < 82) & F.col("line").contains(":") & ~F.trim("line").startswith("#"))
    pair = F.split("line", ":", 2)
    return kept.select("path", F.trim(pair[0]).alias("key"), F.trim(pair[1]).alias("value"))


def save_project(tables: dict[str, DataFrame], path: str) -> str:
    """A folder of Parquet tables; the suffix is never doubled."""
    path = path if path.rstrip("/").endswith("_project") else path.rstrip("/") + "_project"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return path


def load_project(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def prefixes(paths: DataFrame) -> DataFrame:
    """Prefixes of point files: ``*xypts.csv`` or ``.tsv``."""
    return paths.where(F.col("path").rlike(r"xypts\.[ct]sv$")).select(F.regexp_replace("path", r"xypts\.[ct]sv$", "").alias("prefix")).distinct()
