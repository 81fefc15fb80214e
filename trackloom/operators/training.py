"""Training batches with images: exact samples of the index, and rotated, cropped and resized pictures with their heat maps.

Every number that is drawn comes from the seed and the row (movie, frame,
draw), so a batch does not depend on how the tables are split.  A task works on
one image at a time.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resample import resize, rotate

BATCH = "movie string, frame int, draw int, height int, width int, channels int, input array<float>, maps int, response array<float>"
#: Buckets of hashes among which the last one of a sample is looked for.
BUCKETS = 1 << 16


def exact_sample(index: DataFrame, n: int, seed: int, keys: tuple[str, ...] = ("movie", "frame")) -> DataFrame:
    """``n`` rows of ``index`` with ``draw`` from 1: those of the smallest hashes of their keys, or all and repeats if there are fewer.

    Counts of hash buckets tell where the n-th smallest is; rows of lower
    buckets go as they are and only that one bucket is put in order.  Keys are
    unique; the same seed gives the same rows at any partitioning.  An empty index
    gives an empty sample.
    """
    hashed = index.withColumn("_h", F.xxhash64(F.lit(seed), *keys)).withColumn("_b", F.shiftrightunsigned("_h", 48).cast("int"))
    counts = hashed.groupBy("_b").agg(F.count("*").alias("c")).orderBy("_b").collect()  # a row a bucket
    total, below, last = sum(r.c for r in counts), 0, None
    for r in counts:
        if below + r.c >= n:
            last = r["_b"]
            break
        below += r.c
    order = [F.shiftrightunsigned("_h", 1), "_h", *keys]
    if last is not None:
        inside = hashed.where(F.col("_b") == last).orderBy(*order).limit(n - below)
        chosen = hashed.where(F.col("_b") < last).unionByName(inside)
        ranked = chosen.withColumn("draw", F.row_number().over(Window.orderBy("_b", *order)))  # n rows
    elif total:
        ranked = hashed.withColumn("_r", F.row_number().over(Window.orderBy("_b", *order)))  # fewer than n
        again = index.sparkSession.range(1, n - total + 1).select((F.col("id") + total).cast("int").alias("draw"), (F.pmod(F.xxhash64(F.lit(seed), F.lit("again"), "id"), F.lit(total)) + 1).alias("_r"))
        ranked = ranked.withColumn("draw", F.col("_r")).unionByName(ranked.join(again, "_r"), allowMissingColumns=True)
    else:
        ranked = hashed.withColumn("draw", F.lit(0))
    return ranked.select(*index.columns, F.col("draw").cast("int").alias("draw"))


def labelled(obs: DataFrame, points: list[int] | None = None) -> DataFrame:
    """(movie, frame, uv) with u and v of every active point in order, NaN where it is missing; frames without any are left out."""
    if points is None:
        points = sorted(r.point for r in obs.select("point").distinct().collect())  # the points of a project
    seen = obs.where(F.col("point").isin(points) & F.col("u").isNotNull() & F.col("v").isNotNull())
    at = lambda k, c: F.coalesce(F.max(F.when(F.col("point") == k, F.col(c))), F.lit(float("nan")))
    return seen.groupBy("movie", "frame").agg(F.array(*[x for k in points for x in (at(k, "u"), at(k, "v"))]).cast("array<double>").alias("uv"))


def half_away(x: np.ndarray | float) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


@functools.lru_cache(8)
def gauss(sigma: float) -> np.ndarray:
    reach = int(np.ceil(2 * sigma))
    k = np.exp(-np.arange(-reach, reach + 1.0) ** 2 / (2 * sigma * sigma))
    return k / k.sum()


def blurred(image: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Gaussian blur out to two sigmas, the edge repeated outside."""
    k = gauss(sigma)
    for axis in (0, 1):
        padded = np.pad(image, [(len(k) // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        image = np.apply_along_axis(lambda line: np.convolve(line, k, "valid"), axis, padded)
    return image


def heat(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """A map a point (u, v from 1, whole numbers): a blurred square of five pixels with a peak of one; nothing for NaN or outside."""
    out = np.zeros((height, width, len(points)))
    for k, (u, v) in enumerate(points):
        if np.isfinite(u + v):
            rows, cols = slice(max(int(v) - 3, 0), max(min(int(v) + 2, height), 0)), slice(max(int(u) - 3, 0), max(min(int(u) + 2, width), 0))
            out[rows, cols, k] = 1
            if out[:, :, k].any():
                out[:, :, k] = blurred(out[:, :, k])
                out[:, :, k] /= out[:, :, k].max()
    return out


def turned(image: np.ndarray, points: np.ndarray, degrees: float) -> tuple[np.ndarray, np.ndarray]:
    """The rotated image and where its points are then."""
    out = rotate(image, degrees)
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    a, b = (points - np.array(image.shape[1::-1]) / 2).T
    return out, np.stack([c * a + s * b, -s * a + c * b], 1) + np.array(out.shape[1::-1]) / 2


def span(center: float, low: int, high: int, side: int) -> tuple[int, int]:
    """First and last pixel (from 1) of a stretch around ``center``, shifted into the image and cut if it is longer."""
    a, b = int(center) + low, int(center) + high
    if a < 1:
        a, b = 1, b - a + 1
    if b > side:
        a, b = a - b + side, side
    return max(a, 1), b


def whole_picture(image: np.ndarray, points: np.ndarray, side: int, draw: np.random.Generator | None, negatives: bool):
    """The whole image at the network's size, and a map a point with their sum."""
    if draw is not None:
        image, points = turned(image, points, draw.uniform(-100, 100))
    maps = heat(half_away(points * side / np.array(image.shape[1::-1])), side, side)
    return resize(image, side, side), np.concatenate([maps, maps.sum(axis=2, keepdims=True)], 2)


def crop_picture(image: np.ndarray, points: np.ndarray, side: int, draw: np.random.Generator | None, negatives: bool):
    """A square at the image's own scale around one of the points, and its map twice; None if the image is smaller."""
    found = points[np.isfinite(points.sum(axis=1))]
    if not len(found):
        return None
    point = found[draw.integers(len(found)) if draw is not None else 0][None]
    if draw is not None:
        image, point = turned(image, point, draw.uniform(-100, 100))
    if min(image.shape[:2]) < side:
        return None
    half, spans = side // 2, []
    for axis in (0, 1):
        shift = half_away(2 * (draw.random() - 0.5) * half * 0.8) if draw is not None else 0
        spans.append(span(half_away(point[0, axis]) + shift, -half, half - 1, image.shape[1 - axis]))
    (x0, x1), (y0, y1) = spans
    at = half_away(point - [x0, y0])
    at[(at < 3) | (at > side - 3)] = np.nan
    maps = heat(at, side, side)
    return image[y0 - 1 : y1, x0 - 1 : x1], np.repeat(maps, 2, axis=2)


def resized_crop(image: np.ndarray, points: np.ndarray, side: int, draw: np.random.Generator | None, negatives: bool):
    """One and a half times the box of all points (or, as a negative, that size anywhere) at the network's size; None if a point lies on the crop's edge."""
    if draw is not None:
        image, points = turned(image, points, draw.uniform(-100, 100))
    if not np.isfinite(points.sum(axis=1)).any():
        return None
    low, high = np.nanmin(points, axis=0), np.nanmax(points, axis=0)
    half = int(half_away(max(*(high - low), side) / 2))
    center = half_away((low + high) / 2)
    if negatives and draw is not None and draw.random() > 0.5:
        center = np.ceil(draw.random(2) * image.shape[1::-1])
    spans = []
    for axis in (0, 1):
        shift = half_away((draw.random() - 0.5) * half * 0.6) if draw is not None else 0
        spans.append(span(center[axis] + shift, int(half_away(-1.5 * half)), int(half_away(1.5 * (half - 1))), image.shape[1 - axis]))
    (x0, x1), (y0, y1) = spans
    crop = image[y0 - 1 : y1, x0 - 1 : x1]
    at = half_away(half_away(points - [x0, y0]) * side / np.array(crop.shape[1::-1]))
    if ((at > -5) & (at < 0) | (at > side - 5) & (at < side + 5)).any():
        return None
    inner = (at > 2) & (at < side - 2)
    maps = heat(np.where(inner.all(axis=1)[:, None], at, np.nan), side, side)
    return resize(crop, side, side), np.concatenate([maps, maps.sum(axis=2, keepdims=True)], 2)


PICTURES = {"whole": whole_picture, "crop": crop_picture, "resized": resized_crop}


def training_batch(samples: DataFrame, images: DataFrame, kind: str = "whole", side: int = 224, seed: int = 0, augment: bool = True, negatives: bool = False, grouped: bool = False, backgrounds: DataFrame | None = None) -> DataFrame:
    """Inputs and responses of ``samples`` (movie, frame, draw, uv; see ``labelled`` and ``exact_sample``).

    ``images`` has movie, frame, height, width, channels and pix in 0..255;
    ``backgrounds`` has movie and pix, subtracted before all else.  ``kind``:
    ``whole`` images, a ``crop`` around one point, or a ``resized`` crop of all.
    With ``augment`` images are turned by up to 100 degrees and crops moved;
    with ``negatives`` half of the resized crops lie anywhere.  One channel
    becomes three; ``grouped`` whole images give the sum of all points twice.

    Returns movie, frame, draw, height, width, channels, input (0..1), maps and
    response (height x width x maps).  Samples whose image is not there or null,
    or that have no crop (no point, a point on the edge, an image smaller than a
    crop), give no row.
    """
    picture = PICTURES[kind]

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = []
            for r in g.itertuples(index=False):
                shape = (int(r.height), int(r.width), int(r.channels))
                image = np.asarray(r.pix, float).reshape(shape)
                if r.background is not None:
                    image = image - np.asarray(r.background, float).reshape(shape)
                row = f"{seed}\0{kind}\0{r.movie}\0{r.frame}\0{r.draw}".encode()
                draw = np.random.default_rng([zlib.crc32(row), zlib.crc32(row[::-1])]) if augment else None
                found = picture(image / 255, np.reshape(np.asarray(r.uv, float), (-1, 2)), side, draw, negatives)
                if found is None:
                    continue
                made, response = found
                if made.shape[2] == 1:
                    made = np.repeat(made, 3, axis=2)
                if grouped and kind == "whole":
                    response = np.repeat(response[:, :, -1:], 2, axis=2)
                out.append((str(r.movie), int(r.frame), int(r.draw), *made.shape, made.astype(np.float32).ravel(), response.shape[2], response.astype(np.float32).ravel()))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BATCH.split(", ")])

    joined = images.where("pix IS NOT NULL").join(samples.select("movie", "frame", "draw", "uv"), ["movie", "frame"])
    if backgrounds is not None:
        joined = joined.join(backgrounds.select("movie", F.col("pix").alias("background")), "movie", "left")
    else:
        joined = joined.withColumn("background", F.lit(None).cast("array<double>"))
    return joined.select("movie", "frame", "draw", "height", "width", "channels", "pix", "background", "uv").mapInPandas(make, BATCH)


def at_frame(images: DataFrame, movie: Column | str, frame: int) -> DataFrame:
    """Random access: the image of one frame (N: movie and frame), by a filter that reaches the reader."""
    return images.where((F.col("movie") == movie) & (F.col("frame") == frame))
