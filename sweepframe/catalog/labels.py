"""Label lines and annotation documents parsed from columns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources import annotations, documents
from .bindings import box_rows
from .documents import BOXES
from .registry import query
from .statistics import rounded

#: What a line item's label line is: a box, a polygon, or one of the ways to get a line wrong.
KINDS = "CASE WHEN line = 5 THEN 'polygon' WHEN line = 6 THEN 'word' WHEN line = 7 AND image % 2 = 0 THEN 'short' WHEN line = 4 AND image % 3 = 0 THEN 'outside' ELSE 'box' END"
LINES = BOXES + f""", nm AS (SELECT *, {KINDS} AS what, CASE WHEN class_name = 'O' THEN 0 ELSE 1 END AS cls FROM bx),
ln AS (SELECT 'labels/clip' || clip || '/' || image || '.txt' AS path, image, (row_number() OVER (PARTITION BY clip, image ORDER BY line, box_id))::INTEGER AS line_no, cls, what,
  CASE what WHEN 'polygon' THEN [x1 / 64, y1 / 64, x2 / 64, y1 / 64, x2 / 64, y2 / 64] WHEN 'word' THEN [x1 / 64, NULL] WHEN 'short' THEN [x1 / 64, y1 / 64] WHEN 'outside' THEN [1.5, y1 / 64, 0.5, 0.5]
    ELSE [x1 / 64, y1 / 64, (x2 - x1) / 64, (y2 - y1) / 64] END AS coords FROM nm),
er AS (SELECT path, CASE what WHEN 'word' THEN image || '.txt:' || line_no || ': non-numeric token' WHEN 'short' THEN image || '.txt:' || line_no || ': expected 4 (box) or even>=6 (polygon) coords, got 2'
  WHEN 'outside' THEN image || '.txt:' || line_no || ': box not normalised to [0,1]' END AS error, CASE WHEN what IN ('box', 'outside') THEN 'detection' WHEN what = 'polygon' THEN 'segmentation' END AS kind, line_no, cls, coords FROM ln)
"""


def label_lines(spark, sf):
    """A label file per image of a supplier, a line per line item."""
    b = box_rows(spark, sf).withColumns({"what": F.expr(KINDS), "cls": F.when(F.col("class_name") == "O", "0").otherwise("1")})
    text = F.expr("""CASE what WHEN 'polygon' THEN concat_ws(' ', cls, x1 / 64, y1 / 64, x2 / 64, y1 / 64, x2 / 64, y2 / 64) WHEN 'word' THEN concat_ws(' ', cls, x1 / 64, 'wide')
        WHEN 'short' THEN concat_ws(' ', cls, x1 / 64, y1 / 64) WHEN 'outside' THEN concat_ws(' ', cls, 1.5, y1 / 64, 0.5, 0.5) ELSE concat_ws('  ', cls, x1 / 64, y1 / 64, (x2 - x1) / 64, (y2 - y1) / 64) END""")
    path = F.concat(F.lit("labels/clip"), F.col("clip").cast("string"), F.lit("/"), F.col("image").cast("string"), F.lit(".txt"))
    ordered = Window.partitionBy("path").orderBy("line", "box_id", "text")
    return b.select(path.alias("path"), "line", "box_id", text.alias("text")).select("path", F.row_number().over(ordered).alias("line_no"), F.col("text").alias("line"))


@query(LINES + """SELECT path, line_no, cls AS class_id, kind, array_to_string(list_transform(coords, lambda x: coalesce(round(x, 4)::VARCHAR, 'NULL')), ' ') AS coords, error FROM er""")
def label_parse(spark, sf):
    parsed = annotations.parse_label_lines(label_lines(spark, sf))
    shown = F.array_join(F.transform("coords", lambda v: F.coalesce(F.round(v, 4).cast("string"), F.lit("NULL"))), " ")
    return parsed.select("path", "line_no", "class_id", "kind", shown.alias("coords"), "error")


@query(LINES + """SELECT path, CASE WHEN d AND s THEN 'mixed' WHEN d THEN 'detection' WHEN s THEN 'segmentation' ELSE 'none' END AS kind
  FROM (SELECT path, bool_or(coalesce(kind = 'detection', false)) AS d, bool_or(coalesce(kind = 'segmentation', false)) AS s FROM er GROUP BY 1)""")
def label_file_kinds(spark, sf):
    return annotations.label_kinds(annotations.parse_label_lines(label_lines(spark, sf)))


@query(LINES + """SELECT path, error FROM er WHERE error IS NOT NULL UNION ALL SELECT path, regexp_extract(path, '[^/]*$') || ': mixes detection and segmentation lines' FROM er GROUP BY path HAVING bool_or(kind = 'detection') AND bool_or(kind = 'segmentation')""")
def label_file_errors(spark, sf):
    return annotations.label_errors(annotations.parse_label_lines(label_lines(spark, sf)))


@query(LINES + """SELECT regexp_extract(path, '([^/]*)[.]txt$', 1) || '.png' AS image, line_no, cls AS class_id, CASE cls WHEN 0 THEN 'net' ELSE 'class_1' END AS class_name, round((coords[1] - coords[3] / 2) * 640, 4) AS x1, round((coords[2] - coords[4] / 2) * 480, 4) AS y1,
  round((coords[1] + coords[3] / 2) * 640, 4) AS x2, round((coords[2] + coords[4] / 2) * 480, 4) AS y2, 1.0::DOUBLE AS score FROM er WHERE kind = 'detection'""")
def label_boxes_in_pixels(spark, sf):
    lines = label_lines(spark, sf)
    images = box_rows(spark, sf).select("image").distinct().select(F.concat(F.col("image").cast("string"), F.lit(".png")).alias("image"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    return rounded(annotations.label_boxes(annotations.parse_label_lines(lines), images, ["net"]), 4)


def voc_documents(spark, sf):
    """An XML document per image of two suppliers in five; unnamed objects take the default class."""
    b = box_rows(spark, sf).where("line <= 3").select("image", "line", "box_id", F.struct(
        F.when(F.col("line") != 2, F.concat(F.lit("kind"), F.col("clip") % 5)).alias("name"), F.struct(F.col("x1").alias("xmin"), F.col("y1").alias("ymin"), F.col("x2").alias("xmax"), F.col("y2").alias("ymax")).alias("bndbox")).alias("o"))
    per = b.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "box_id", "o"))), lambda s: s["o"]).alias("object"))
    whole = F.struct(F.concat(F.col("image").cast("string"), F.lit(".png")).alias("filename"), F.struct(F.lit(64).alias("width"), F.lit(48).alias("height")).alias("size"), "object")
    return per.select(F.lpad(F.col("image").cast("string"), 12, "0").alias("doc"), F.to_xml(whole, {"rowTag": "annotation"}).alias("text"))


@query(BOXES + """, o AS (SELECT lpad(image::VARCHAR, 12, '0') AS doc, image, row_number() OVER (PARTITION BY image ORDER BY line, box_id) AS i, CASE WHEN line <> 2 THEN 'kind' || (clip % 5) ELSE 'damage' END AS class_name, x1, y1, x2, y2 FROM bx WHERE line <= 3),
c AS (SELECT class_name, (row_number() OVER (ORDER BY f) - 1)::INTEGER AS cls FROM (SELECT class_name, min(doc || '/' || lpad(i::VARCHAR, 3, '0')) AS f FROM o GROUP BY 1))
SELECT image || '.png' AS image, cls, class_name, round(x1 / 64, 6) AS x1, round(y1 / 48, 6) AS y1, round(x2 / 64, 6) AS x2, round(y2 / 48, 6) AS y2 FROM o JOIN c USING (class_name)""")
def document_voc(spark, sf):
    boxes, _ = documents.voc_boxes(voc_documents(spark, sf))
    return rounded(boxes)
