"""Documents built from the driver tables with to_json and parsed back from their column."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parsing import micros
from ..sources import annotations, documents
from .bindings import box_rows, events, sites
from .registry import query, table
from .statistics import rounded

BOXES = """
WITH bx AS (SELECT l_orderkey AS image, ((l_linenumber * 1000003 + l_partkey) * 10007 + l_suppkey) * 101 + l_quantity::BIGINT AS box_id, (l_partkey % 4) * 8.0 AS x1, (l_suppkey % 4) * 8.0 AS y1,
  (l_partkey % 4) * 8.0 + 20.0 + l_quantity % 16 AS x2, (l_suppkey % 4) * 8.0 + 20.0 + l_partkey % 16 AS y2, l_linestatus AS class_name, l_discount * 10.0 AS score, l_linenumber AS line, l_suppkey AS clip FROM lineitem)
"""


def _sorted(*columns: str):
    """All rows of a group as an array of structs, ordered by their first fields."""
    return F.array_sort(F.collect_list(F.struct(*columns)))


def index_documents(spark, sf):
    """Two index documents per supplier, one for each line status, with the times of its shipments; a few are broken."""
    items = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("clip"), F.col("l_linestatus").alias("topic"), (F.floor(micros("l_shipdate") / 1_000_000) + F.col("l_linenumber") / 8.0).alias("t"))
    per = items.groupBy("clip", "topic").agg(F.array_sort(F.collect_list("t")).alias("times"))
    docs = documents.as_documents(per, ["clip", "topic"], [F.col("clip").cast("string").alias("clip"), "topic", F.lit("Image").alias("msgtype"), F.size("times").alias("count"),
                                                          F.array_min("times").alias("t_start"), F.array_max("times").alias("t_end"), "times"])
    broken = F.col("doc").rlike("^[0-9]*7/F$")
    return docs.withColumn("text", F.when(broken, F.expr("left(text, 40)")).otherwise(F.col("text")))


INDEXES = """
WITH d AS (SELECT l_suppkey::VARCHAR AS clip, l_linestatus AS topic, list((epoch(l_shipdate) // 1)::BIGINT + l_linenumber / 8.0::DOUBLE ORDER BY (epoch(l_shipdate) // 1)::BIGINT + l_linenumber / 8.0::DOUBLE) AS times FROM lineitem GROUP BY ALL),
x AS (SELECT * FROM d WHERE NOT (clip LIKE '%7' AND topic = 'F') QUALIFY row_number() OVER (PARTITION BY clip ORDER BY topic) = 1)
"""


@query(INDEXES + "SELECT clip, topic, 'Image' AS msgtype, len(times)::INTEGER AS count, round(times[1], 3) AS t_start, round(times[-1], 3) AS t_end FROM x")
def document_frame_indexes(spark, sf):
    return rounded(documents.frame_indexes(index_documents(spark, sf)).drop("times"), 3)


@query(INDEXES + """, tm AS (SELECT clip, UNNEST(times) AS t, UNNEST(range(len(times))) AS msg_index FROM x),
fr AS (SELECT l_suppkey::VARCHAR AS clip, l_orderkey, l_linenumber, l_partkey, (l_partkey % 400)::INTEGER AS msg_index FROM lineitem)
SELECT clip, l_orderkey, l_linenumber, l_partkey, msg_index, round(t, 3) AS t FROM fr LEFT JOIN tm USING (clip, msg_index)""")
def document_frame_lookup(spark, sf):
    """Frames take their time from the index documents; those past the end of an index stay, without a time."""
    times = documents.frame_times(documents.frame_indexes(index_documents(spark, sf)))
    wanted = table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("string").alias("clip"), "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 400).cast("int").alias("msg_index"))
    # Merged: times come out of arrays, so they look as small as one row per clip.
    return rounded(wanted.join(times.hint("merge"), ["clip", "msg_index"], "left").select("clip", "l_orderkey", "l_linenumber", "l_partkey", "msg_index", "t"), 3)


@query(INDEXES.replace("x AS (", "y AS (") + "SELECT clip || '/' || topic AS doc, 'not a JSON document' AS error FROM d WHERE clip LIKE '%7' AND topic = 'F'")
def document_rejects(spark, sf):
    return documents.rejected(index_documents(spark, sf))


def prediction_documents(spark, sf):
    """A document of predictions per supplier: half of them wrapped with their origin, half bare maps; scores are left out at times."""
    boxes = box_rows(spark, sf).select("clip", F.col("image").cast("string").alias("image"), "line", "box_id", F.struct(
        F.array("x1", "y1", "x2", "y2").alias("bbox"), F.when(F.col("line") != 3, F.col("score")).alias("score"), F.when(F.col("line") != 4, F.col("class_name")).alias("class_name")).alias("b"))
    strong = F.filter(_sorted("line", "box_id", "b"), lambda s: s["b"]["bbox"][0] > 0)
    per = boxes.groupBy("clip", "image").agg(F.transform(strong, lambda s: s["b"]).alias("boxes"))
    per = per.groupBy("clip").agg(F.map_from_entries(F.collect_list(F.struct("image", "boxes"))).alias("images"))
    wrapped = documents.as_documents(per.where("clip % 2 = 0"), ["clip"], [F.lit("det").alias("meta"), "images"])
    return wrapped.unionByName(per.where("clip % 2 = 1").select(F.col("clip").cast("string").alias("doc"), F.to_json("images").alias("text")))


@query(BOXES + """SELECT clip::VARCHAR AS doc, image::VARCHAR AS image, (row_number() OVER (PARTITION BY clip, image ORDER BY line, box_id) - 1)::INTEGER AS box_id, x1, y1, x2, y2, 0 AS class_id,
  CASE WHEN line <> 4 THEN class_name ELSE 'damage' END AS class_name, round(CASE WHEN line <> 3 THEN score ELSE 1.0 END, 6) AS score FROM bx WHERE x1 > 0""")
def document_predictions(spark, sf):
    return rounded(documents.predicted_boxes(documents.predicted_images(prediction_documents(spark, sf))))


@query(BOXES + "SELECT clip::VARCHAR AS doc, count(DISTINCT image) AS images, count(DISTINCT image) - count(DISTINCT CASE WHEN x1 > 0 THEN image END) AS without_boxes FROM bx GROUP BY 1")
def document_predicted_images(spark, sf):
    """Images with an empty list are images all the same."""
    images = documents.predicted_images(prediction_documents(spark, sf))
    return images.groupBy("doc").agg(F.count(F.lit(1)).alias("images"), F.count_if(F.size("boxes") == 0).alias("without_boxes"))


def coco_documents(spark, sf):
    """A label document per customer: orders are images, line items annotations; the last annotation names an image nobody has."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("id"), (613 + F.col("o_orderkey") % 3 * 320).cast("int").alias("width"), F.lit(487).alias("height"),
                                               F.concat(F.lit("pass/clip"), (F.col("o_custkey") % 40).cast("string"), F.lit("_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), F.lit(".png")).alias("file_name"))
    boxes = box_rows(spark, sf).join(orders.select("c", F.col("id").alias("image")), "image").select(
        "c", F.when(F.col("line") < 7, F.col("image")).otherwise(-1).alias("image_id"), F.when(F.col("class_name") == "O", 5).otherwise(2).alias("category_id"),
        F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), F.when(F.col("line") == 1, 1).otherwise(0).alias("iscrowd"))
    images = orders.groupBy("c").agg(F.collect_list(F.struct("id", "width", "height", "file_name")).alias("images"))
    labels = boxes.groupBy("c").agg(F.collect_list(F.struct("image_id", "category_id", "bbox", "iscrowd")).alias("annotations"))
    kinds = F.array(F.struct(F.lit(2).alias("id"), F.lit("hole").alias("name")), F.struct(F.lit(5).alias("id"), F.lit("net").alias("name")))
    # Merged: the size of arrays is not known to the plan.
    return documents.as_documents(images.join(labels.hint("merge"), "c"), ["c"], ["images", "annotations", kinds.alias("categories")])


COCO = BOXES + """, lb AS (SELECT o_custkey::VARCHAR AS doc, bx.*, 613 + image % 3 * 320 AS w, 'clip' || (o_custkey % 40) || '_' || lpad(image::VARCHAR, 9, '0') AS stem, 'clip' || (o_custkey % 40) AS grp
  FROM bx JOIN orders ON o_orderkey = image WHERE line < 7)
"""


@query(COCO + """SELECT stem || '.png' AS image, grp, CASE WHEN class_name = 'O' THEN 5 ELSE 2 END AS cls, round(x1 / w, 6) AS x1, round(y1 / 487.0, 6) AS y1, round(x2 / w, 6) AS x2, round(y2 / 487.0, 6) AS y2 FROM lb""")
def document_coco_boxes(spark, sf):
    docs = coco_documents(spark, sf)
    return rounded(annotations.coco_boxes(*documents.coco_parts(docs, "images", "annotations")))


@query(COCO + """SELECT stem || '.png' AS image, printf('%d %.6f %.6f %.6f %.6f', CASE WHEN class_name = 'O' THEN 1 ELSE 0 END, (x1 + (x2 - x1) / 2) / w, (y1 + (y2 - y1) / 2) / 487.0, (x2 - x1) / w, (y2 - y1) / 487.0) AS line
  FROM lb WHERE line > 1 AND image % 5 <> 0""")
def document_coco_to_yolo(spark, sf):
    """Label lines with contiguous classes; crowds and images whose file is missing leave none."""
    docs = coco_documents(spark, sf)
    images, labels, categories = documents.coco_parts(docs, "images", "annotations", "categories")
    files = images.where("id % 5 <> 0").select("file_name")
    return annotations.coco_to_yolo(images, labels, categories, files)[0]


@query("""SELECT user_id::VARCHAR AS source, (epoch_us(ts) // 1000000)::BIGINT AS time, round(value / 5, 6) AS sea_water_temperature_c, CASE WHEN event_id % 3 <> 0 THEN round(value / 60, 6) END AS sea_surface_wave_height_m FROM events WHERE user_id % 25 <> 0""")
def document_forecasts(spark, sf):
    """A forecast document per user from its events; every 25th is an error payload."""
    e = events(spark, sf)
    details = F.struct((F.col("value") / 5).alias("sea_water_temperature"), F.when(F.col("event_id") % 3 != 0, F.col("value") / 60).alias("sea_surface_wave_height"))
    step = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"), F.struct(F.struct(details.alias("details")).alias("instant")).alias("data"))
    per = e.groupBy("user_id").agg(F.collect_list(step).alias("timeseries"))
    docs = documents.as_documents(per, ["user_id"], [F.struct("timeseries").alias("properties"), F.when(F.col("user_id") % 25 == 0, "quota exceeded").alias("error")])
    return rounded(documents.forecast_hours(docs).select("source", F.unix_seconds("time").alias("time"), "sea_water_temperature_c", "sea_surface_wave_height_m"))


@query("""SELECT s_suppkey::INTEGER AS loknr, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 60 + 10.0::DOUBLE END AS lat, s_acctbal AS capacity, s_name AS name, n_name AS county, CASE WHEN s_suppkey % 2 = 0 THEN 'Matfisk' ELSE '' END AS production_form, '' AS url
  FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_nationkey % 6 <> 5""")
def document_registers(spark, sf):
    """A register document per county; some counties answer with an error."""
    s = sites(spark, sf).join(table(spark, sf, "nation").select(F.col("n_name").alias("county"), "n_nationkey"), "county")
    attributes = F.struct("loknr", "lat", "lon", F.col("capacity").alias("kapasitet_lok"), F.concat(F.lit("  "), "name").alias("navn"), F.col("county").alias("fylke"), F.nullif("production_form", F.lit("")).alias("til_produksjonsform"))
    per = s.groupBy("n_nationkey").agg(F.collect_list(F.struct(attributes.alias("attributes"))).alias("features"))
    docs = documents.as_documents(per, ["n_nationkey"], [F.when(F.col("n_nationkey") % 6 == 5, F.struct(F.lit(400).alias("code"))).alias("error"), "features"])
    return documents.register_sites(docs).select("loknr", "lat", "capacity", "name", "county", "production_form", "url")
