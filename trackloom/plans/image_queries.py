"""Registered queries over images in tiles: block functions and multi-crop detection."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import blocks, detect
from ..streaming import autotrack
from . import fixtures as X
from .queries import query, rounded

LEAST, BLOCK = 0.05, 4


def mosaics(spark, sf: str) -> DataFrame:
    """Sixteen embeddings side by side as an image of 32 x 32 in tiles; places without one are black."""
    im = X.images(spark, sf)
    slots = im.select((F.floor(F.col("id") / 16)).alias("image")).distinct().select("image", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("slot"))
    found = slots.join(im.select((F.floor(F.col("id") / 16)).alias("image"), (F.col("id") % 16).cast("int").alias("slot"), "pix"), ["image", "slot"], "left")
    place = {"row0": F.floor(F.col("slot") / 4).cast("int") * 8, "col0": F.col("slot") % 4 * 8, "height": 32, "width": 32, "h": 8, "w": 8, "channels": 1}
    return found.select("image", *[(v if not isinstance(v, int) else F.lit(v)).cast("int").alias(c) for c, v in place.items()], F.coalesce("pix", F.array_repeat(F.lit(0.0), 64)).alias("pix"))


MOSAIC_SQL = f"""{X.PIXEL_SQL}, mo AS (SELECT DISTINCT id//16 AS image FROM px),
mp AS (SELECT mo.image, r.r::INT AS row, c.c::INT AS col, coalesce(px.value, 0.0) AS value FROM mo, (SELECT unnest(range(32)) AS r) r, (SELECT unnest(range(32)) AS c) c
  LEFT JOIN px ON px.id = mo.image*16 + r//8*4 + c//8 AND px.row = r%8 AND px.col = c%8)"""


def mean3(block: np.ndarray) -> np.ndarray:
    """The mean of 3 x 3 pixels, zero outside."""
    wide = np.pad(block, ((1, 1), (1, 1), (0, 0)))
    n, m = block.shape[:2]
    return sum(wide[i : i + n, j : j + m] for i in range(3) for j in range(3)) / 9


def exploded(tiles: DataFrame) -> DataFrame:
    e = tiles.select("image", "row0", "col0", "w", F.posexplode("pix").alias("i", "value"))
    return e.select("image", (F.col("row0") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("row"), (F.col("col0") + F.col("i") % F.col("w")).cast("int").alias("col"), "value")


@query(f"WITH {MOSAIC_SQL} SELECT a.image, a.row, a.col, round(sum(b.value)/9, 6)+0.0 AS value FROM mp a JOIN mp b ON a.image = b.image AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1 GROUP BY ALL")
def blocks_applied(spark, sf):
    return rounded(exploded(blocks.apply_blocks(mosaics(spark, sf), 5, mean3, border=1)), "value", digits=6)


@query(f"WITH {MOSAIC_SQL}, k AS (SELECT unnest(range(3, 31, 3))::INT AS k) SELECT image, r.k AS row, c.k AS col, 0 AS channel, round(max(value)-min(value), 6)+0.0 AS value FROM mp, k r, k c WHERE abs(mp.row+1-r.k)<=2 AND abs(mp.col+1-c.k)<=2 GROUP BY ALL")
def blocks_checked(spark, sf):
    return rounded(blocks.check_blocks(mosaics(spark, sf), 8, 5, 3, lambda b: b.max(axis=(0, 1)) - b.min(axis=(0, 1))), "value", digits=6)


def pyramid(spark, sf: str) -> DataFrame:
    """Twelve embeddings as heat of one frame: three scales of three points and a mask; those that are not there are zero."""
    im = X.images(spark, sf).select(F.floor(F.col("id") / 12).alias("frame"), F.floor(F.col("id") % 12 / 4).cast("int").alias("scale"), (F.col("id") % 4).alias("channel"), "pix")
    whole = im.groupBy("frame").agg(F.collect_list(F.struct("scale", "channel", "pix")).alias("maps"))  # twelve
    plane = lambda s, k: F.coalesce(F.get(F.filter("maps", lambda m: (m["scale"] == s) & (m["channel"] == k)), 0)["pix"], F.array_repeat(F.lit(0.0), 64))
    scaled = whole.select("frame", F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), *[plane(s, k).alias(f"p{k}") for k in range(4)]) for s in range(3)])).alias("m")).select("frame", "m.*")
    pix = F.flatten(F.transform(F.arrays_zip(*[f"p{k}" for k in range(4)]), lambda x: F.array(*[x[f"p{k}"] for k in range(4)])))
    return scaled.select("frame", "scale", *[F.lit(n).alias(c) for c, n in (("height", 8), ("width", 8), ("channels", 4))], pix.alias("pix"))


REGION_SQL = f"""{X.PIXEL_SQL}, fr AS (SELECT DISTINCT id//12 AS frame FROM px),
raw AS (SELECT frame, s.s::INT AS scale, k.k::INT AS channel, r.r::INT AS row, c.c::INT AS col, coalesce(px.value, 0.0) AS v
  FROM fr, (SELECT unnest(range(3)) AS s) s, (SELECT unnest(range(4)) AS k) k, (SELECT unnest(range(8)) AS r) r, (SELECT unnest(range(8)) AS c) c
  LEFT JOIN px ON px.id = frame*12 + s*4 + k AND px.row = r AND px.col = c),
ed AS (SELECT * REPLACE (CASE WHEN row<7 AND col<7 THEN v ELSE 0 END AS v) FROM raw),
m AS (SELECT e.* REPLACE (CASE WHEN k.v>{LEAST} THEN e.v ELSE 0 END AS v) FROM ed e JOIN ed k ON k.channel=3 AND e.frame=k.frame AND e.scale=k.scale AND e.row=k.row AND e.col=k.col),
pk AS (SELECT frame, scale, channel, max(v) AS p FROM m GROUP BY ALL),
bs AS (SELECT frame, arg_min(scale, (-t, scale)) AS best FROM (SELECT frame, scale, round(sum(p) FILTER (channel<3), 9) AS t FROM pk GROUP BY ALL) q GROUP BY frame),
own AS (SELECT frame, channel, arg_min(scale, (-p, scale)) AS scale FROM pk GROUP BY ALL),
hi AS (SELECT frame, count(*) FILTER (s>{LEAST}) AS hits FROM (SELECT frame, row, col, sum(v) AS s FROM m JOIN own USING (frame, channel, scale) GROUP BY ALL) q GROUP BY frame),
ce AS (SELECT unnest(range(3, 7))::INT AS k),
vo AS (SELECT m.frame, a.k AS cr, b.k AS cc, count(DISTINCT CASE WHEN v>{LEAST} THEN channel END) AS n FROM m JOIN bs ON bs.frame=m.frame AND best=scale, ce a, ce b
  WHERE channel<3 AND abs(row+1-a.k) BETWEEN 1 AND 2 AND abs(col+1-b.k) BETWEEN 1 AND 2 GROUP BY ALL),
tp AS (SELECT frame, floor(avg(cr)+0.5)::INT AS cr, floor(avg(cc)+0.5)::INT AS cc FROM vo JOIN (SELECT frame, max(n) AS n FROM vo GROUP BY frame) q USING (frame, n) GROUP BY frame),
sh AS (SELECT frame, cr, cc, greatest(0, 4-cc) AS dx, greatest(0, 4-cr) AS dy FROM tp),
re AS (SELECT frame, best, hits, CASE WHEN hits>=2 THEN cr END AS row, CASE WHEN hits>=2 THEN cc END AS col,
  CASE WHEN hits>=2 THEN greatest(1, cc-3+dx-greatest(0, cc+2+dx-8)) END AS x0, CASE WHEN hits>=2 THEN least(8, cc+2+dx) END AS x1,
  CASE WHEN hits>=2 THEN greatest(1, cr-3+dy-greatest(0, cr+2+dy-8)) END AS y0, CASE WHEN hits>=2 THEN least(8, cr+2+dy) END AS y1
  FROM bs JOIN hi USING (frame) JOIN sh USING (frame))"""


@query(f"WITH {REGION_SQL} SELECT * FROM re")
def multi_crop_regions(spark, sf):
    return detect.regions(blocks.cut(pyramid(spark, sf), 5), LEAST, BLOCK)


@query(f"""WITH {REGION_SQL}, pt AS (SELECT unnest(range(3))::INT AS channel),
de AS (SELECT raw.frame, raw.channel, arg_min((raw.row, raw.col), (-v, raw.col, raw.row)) AS p, max(v) AS q FROM raw JOIN re ON re.frame=raw.frame AND raw.row+1 BETWEEN y0 AND y1 AND raw.col+1 BETWEEN x0 AND x1 WHERE scale=0 AND channel<3 GROUP BY ALL)
SELECT re.frame, pt.channel, CASE WHEN q>{LEAST} THEN (p[2]+2)::DOUBLE ELSE 0::DOUBLE END AS u, CASE WHEN q>{LEAST} THEN (p[1]+2)::DOUBLE ELSE 0::DOUBLE END AS v, CASE WHEN q>{LEAST} THEN round(q::DOUBLE, 6) ELSE 0::DOUBLE END AS quality
FROM re CROSS JOIN pt LEFT JOIN de ON de.frame=re.frame AND de.channel=pt.channel""")
def multi_crop(spark, sf):
    heat = pyramid(spark, sf)
    crops = detect.regions(blocks.cut(heat, 5), LEAST, BLOCK)
    found = detect.detections(blocks.cut(heat.where("scale = 0").drop("scale"), 5), crops, lambda crop: crop, 3, LEAST, side=None)
    return rounded(found, "quality", digits=6)


def filmed(spark, sf: str) -> tuple[DataFrame, Column, DataFrame]:
    """Every user's events as a recording of two cameras: a spot that moves with the number of the event and is gone where the value is missing.

    Returns images (trial, frame, cam, height, width) with where their spot is,
    the expression that makes pix of it (profiles, none where it is dark), and what was digitised by hand (trial,
    frame, point, cam, u, v): the first two of every fifty frames.
    """
    n = F.col("frame")
    at = X.series(spark, sf).select(F.col("track").alias("trial"), n, F.col("u").isNotNull().alias("lit"), (16 + 7 * F.sin(n / 9)).alias("x"), (16 + 7 * F.cos(n / 11)).alias("y"), (13 + 4 * F.sin(n / 13)).alias("z"))
    seen = at.select("trial", "frame", "lit", F.explode(F.array(*[F.struct(F.lit(k).alias("cam"), F.col(c).alias("u"), F.col("z").alias("v")) for k, c in ((1, "x"), (2, "y"))])).alias("s")).select("trial", "frame", "lit", "s.*")
    # a spot is a product of what it is down and across the image: 56 values instead of 768
    along = lambda c, n, d, wide, light: F.transform(F.array(*[F.lit(i + 1.0) for i in range(n)]), lambda i: light * F.exp(-((i - (F.col(c) + d)) ** 2) / wide))
    spot = lambda du, dv, wide, light: F.concat(along("v", 24, dv, wide, light), along("u", 32, du, wide, 1.0))
    pix = F.when(F.col("lit"), F.array(spot(0, 0, 5.0, 1.0), spot(2, -1, 3.0, 0.4))).otherwise(F.array().cast("array<array<double>>"))
    images = seen.select("trial", "frame", "cam", F.lit(24).alias("height"), F.lit(32).alias("width"), "lit", "u", "v")
    return images, pix, seen.where("frame % 50 IN (1, 2)").select("trial", "frame", F.lit(1).alias("point"), "cam", "u", "v")


#: Two cameras at a right angle that see x and z, and y and z.
SIDES = [(k, [float(i in (j, 6)) for i in range(11)]) for k, j in ((1, 0), (2, 1))]


@query()
def auto_tracked(spark, sf):
    images, picture, digitised = filmed(spark, sf)
    rig = spark.createDataFrame(SIDES, "cam int, c array<double>")
    found = autotrack.track_points(images, autotrack.multi_starts(digitised), rig, options=autotrack.Options(half=4, reach=3, gap=1), picture=picture)
    fits = F.transform("sights", lambda s: F.round(s["fit"], 3))
    return rounded(found.select("trial", "frame", "point", fits.alias("fits"), "x", "y", "z", "rmse", "erased", "ended"), "x", "y", "z", "rmse", digits=4)
