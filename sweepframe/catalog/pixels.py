"""Pixel measures on embeddings seen as 8 x 8 grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detections, spatial, vision
from .bindings import grids
from .registry import query
from .statistics import rounded

GRID = """
WITH RECURSIVE gr AS (SELECT vec_id AS frame, label, embedding, generate_subscripts(embedding, 1) - 1 AS p, unnest(embedding)::DOUBLE AS v FROM embeddings),
px AS (SELECT frame, (p // 8)::INT AS y, (p % 8)::INT AS x, v, (v + 0.5) * 255.0::DOUBLE AS g FROM gr)
"""


def cells(spark, sf):
    return vision.grid_cells(grids(spark, sf), "frame", "grid", 8)


@query(GRID + """, c AS (SELECT frame, y, x, g AS r, g * 0.8::DOUBLE AS gg, g * 0.5::DOUBLE AS b, 0.299::DOUBLE * g + 0.587::DOUBLE * (g * 0.8::DOUBLE) + 0.114::DOUBLE * (g * 0.5::DOUBLE) AS l FROM px),
n AS (SELECT *, lag(l) OVER (PARTITION BY frame, y ORDER BY x) AS w, lead(l) OVER (PARTITION BY frame, y ORDER BY x) AS e,
  lag(l) OVER (PARTITION BY frame, x ORDER BY y) AS n, lead(l) OVER (PARTITION BY frame, x ORDER BY y) AS s FROM c)
SELECT frame, round(var_pop(w + e + n + s - 4 * l), 4) AS sharpness, round(stddev_pop(l), 6) AS contrast, round(avg(l), 6) AS brightness,
  round(avg(greatest(r, gg, b) - least(r, gg, b)), 6) AS saturation, round(avg(CASE WHEN l < 40 THEN 1.0 ELSE 0.0 END), 6) AS dark_fraction FROM n GROUP BY frame""")
def grid_quality(spark, sf):
    px = cells(spark, sf).select(
        "frame", F.col("row").alias("y"), F.col("col").alias("x"), F.col("score").alias("r"), (F.col("score") * 0.8).alias("g"), (F.col("score") * 0.5).alias("b"))
    out = vision.frame_quality(px)
    return rounded(out.withColumn("sharpness", F.round("sharpness", 4)))


@query(GRID + """, bx AS (SELECT frame, b AS box_id, (frame % 5 + b)::DOUBLE AS x1, (frame % 4)::DOUBLE AS y1, (frame % 5 + b + 1 + frame % 3)::DOUBLE AS x2, (frame % 4 + 3.5)::DOUBLE AS y2
  FROM (SELECT DISTINCT frame FROM px), range(0, 3) t(b)),
c AS (SELECT *, greatest(0, floor(x1))::INT AS a1, greatest(0, floor(y1))::INT AS b1, least(8, floor(x2))::INT AS a2, least(8, floor(y2))::INT AS b2 FROM bx),
d AS (SELECT *, greatest(4, (a2 - a1) // 2) AS px_, greatest(4, (b2 - b1) // 2) AS py_ FROM c),
h AS (SELECT frame, y, x, g, abs(g - lag(g) OVER (PARTITION BY frame, y ORDER BY x)) AS gx, abs(g - lag(g) OVER (PARTITION BY frame, x ORDER BY y)) AS gy FROM px),
m AS (SELECT d.frame, d.box_id, any_value(a2 - a1) AS bw, any_value(b2 - b1) AS bh,
  avg(CASE WHEN x >= a1 AND x < a2 AND y >= b1 AND y < b2 THEN g END) AS interior,
  avg(CASE WHEN NOT (x >= a1 AND x < a2 AND y >= b1 AND y < b2) THEN g END) AS ring,
  avg(CASE WHEN x > a1 AND x < a2 AND y >= b1 AND y < b2 THEN gx END) AS ex, avg(CASE WHEN x >= a1 AND x < a2 AND y > b1 AND y < b2 THEN gy END) AS ey
  FROM d JOIN h ON h.frame = d.frame AND x >= a1 - px_ AND x < a2 + px_ AND y >= b1 - py_ AND y < b2 + py_ WHERE a2 - a1 >= 2 AND b2 - b1 >= 2 GROUP BY 1, 2)
SELECT bx.frame, bx.box_id, round(interior, 5) AS interior, round(coalesce(ring, interior), 5) AS surround, round(coalesce(ring, interior) - interior, 5) AS contrast,
  round(greatest(bw, bh) / least(bw, bh)::DOUBLE, 5) AS elongation, round(bw * bh / 64.0, 5) AS area_frac, round((ex + ey) / 2, 5) AS edge_density
FROM bx LEFT JOIN m ON m.frame = bx.frame AND m.box_id = bx.box_id""")
def box_contrast(spark, sf):
    g = grids(spark, sf)
    boxes = g.select("frame", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("box_id")).select(
        "frame", "box_id", (F.col("frame") % 5 + F.col("box_id")).cast("double").alias("x1"), (F.col("frame") % 4).cast("double").alias("y1"),
        (F.col("frame") % 5 + F.col("box_id") + 1 + F.col("frame") % 3).cast("double").alias("x2"), (F.col("frame") % 4 + 3.5).cast("double").alias("y2"))
    px = cells(spark, sf).select("frame", F.col("row").alias("y"), F.col("col").alias("x"), F.col("score").alias("luma"))
    out = vision.box_contrast(px, boxes)
    return rounded(out.drop("x1", "y1", "x2", "y2"), 5)


HASH = GRID + """, sp AS (SELECT 'a_train' AS split, frame, y, x, g FROM px
  UNION ALL SELECT 'b_test', frame, y, x, g + ((frame * 7 + (y * 8 + x) * 13) % 11 - 5) * 1.1::DOUBLE FROM px),
bt AS (SELECT split, frame, y, x, g < lead(g) OVER (PARTITION BY split, frame, y ORDER BY x) AS bit FROM sp),
hs AS (SELECT split, frame, sum(CASE WHEN bit THEN 1::BIGINT << (55 - (y * 7 + x)) ELSE 0 END)::BIGINT AS h FROM bt WHERE x < 7 GROUP BY 1, 2)
"""


def hashes(spark, sf):
    g = grids(spark, sf)
    noisy = F.transform("grid", lambda v, i: v + ((F.col("frame") * 7 + i * 13) % 11 - 5) * 1.1)
    both = g.select("frame", F.lit("a_train").alias("split"), "grid").unionByName(
        g.select("frame", F.lit("b_test").alias("split"), noisy.alias("grid")))
    return both.select("split", F.col("frame").alias("image"), vision.difference_hash(F.col("grid"), 8, 8).alias("h"))


@query(HASH + "SELECT split, frame AS image, h FROM hs")
def difference_hashes(spark, sf):
    return hashes(spark, sf)


@query(HASH + """, k AS (SELECT split, h, count(*) AS n, min(frame) AS ex FROM hs GROUP BY 1, 2)
SELECT a.split AS split_a, a.h AS hash_a, a.n AS images_a, a.ex AS example_a, b.split AS split_b, b.h AS hash_b, b.n AS images_b, b.ex AS example_b,
  bit_count(xor(a.h, b.h))::INT AS distance FROM k a JOIN k b ON a.split < b.split AND bit_count(xor(a.h, b.h)) <= 4""")
def dhash_near_duplicates(spark, sf):
    return vision.near_duplicates(hashes(spark, sf), 4, bits=56)


@query(HASH + """SELECT DISTINCT a.split, a.frame AS image FROM hs a JOIN hs b ON a.split <> b.split AND bit_count(xor(a.h, b.h)) <= 4""")
def split_leak_images(spark, sf):
    h = hashes(spark, sf)
    return vision.duplicated_images(h, vision.near_duplicates(h, 4, bits=56)).select("split", "image")


@query(GRID + """, ce AS (SELECT frame, y, x, y * 8 + x AS id, abs(v) AS s FROM px WHERE abs(v) >= 0.15::DOUBLE),
ed AS (SELECT a.frame, a.id AS a, b.id AS b FROM ce a JOIN ce b ON a.frame = b.frame AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
re AS (SELECT frame, id AS a, id AS b FROM ce UNION SELECT re.frame, re.a, ed.b FROM re JOIN ed ON ed.frame = re.frame AND ed.a = re.b),
cp AS (SELECT frame, a AS id, min(b) AS comp FROM re GROUP BY 1, 2),
bo AS (SELECT ce.frame, comp, min(y) AS r0, max(y) AS r1, min(x) AS c0, max(x) AS c1, count(*) AS cells FROM ce JOIN cp ON cp.frame = ce.frame AND cp.id = ce.id GROUP BY 1, 2),
tp AS (SELECT bo.frame, comp, max(s) AS top FROM bo JOIN ce ON ce.frame = bo.frame AND y BETWEEN r0 AND r1 AND x BETWEEN c0 AND c1 GROUP BY 1, 2)
SELECT bo.frame, c0 * 80.0::DOUBLE AS x1, r0 * 60.0::DOUBLE AS y1, (c1 + 1) * 80.0::DOUBLE AS x2, (r1 + 1) * 60.0::DOUBLE AS y2,
  round(least(1.0, top / 0.3), 6) AS score, cells FROM bo JOIN tp USING (frame, comp)""")
def grid_components(spark, sf):
    raw = vision.grid_cells(grids(spark, sf), "frame", "embedding", 8)
    size = raw.withColumn("score", F.abs(F.col("score").cast("double")))
    return rounded(spatial.grid_components(size, 0.15, rows=8, cols=8, width_px=640, height_px=480))


@query(GRID + """SELECT frame AS image, count_if(v > 0 AND abs(v) > 0.1::DOUBLE)::BIGINT AS intersection, count_if(v > 0 OR abs(v) > 0.1::DOUBLE)::BIGINT AS "union",
  round(count_if(v > 0 AND abs(v) > 0.1::DOUBLE) / count_if(v > 0 OR abs(v) > 0.1::DOUBLE)::DOUBLE, 6) AS mask_iou FROM px GROUP BY 1""")
def mask_iou(spark, sf):
    raw = vision.grid_cells(grids(spark, sf), "frame", "embedding", 8)
    v = F.col("score").cast("double")
    masks = F.filter(F.array(F.when(v > 0, "a"), F.when(F.abs(v) > 0.1, "b")), lambda m: m.isNotNull())
    px = raw.select(F.col("frame").alias("image"), F.explode(masks).alias("mask"), F.col("row").alias("y"), F.col("col").alias("x"))
    return rounded(detections.mask_iou(px))
