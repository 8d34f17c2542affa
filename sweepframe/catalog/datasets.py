"""Dataset governance on orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing
from ..operators import caching, governance, ranking
from ..plans.seeded import RANGE, draw_sql
from .bindings import events, sample_boxes, samples
from .registry import query, table
from .statistics import rounded

SAMPLES = """
WITH s AS (SELECT o_orderkey AS image, 'clip' || (o_custkey % 40) AS grp, CASE WHEN o_orderkey % 997 = 0 THEN 0 ELSE 640 + o_orderkey % 3 * 320 END::INT AS width,
  CASE WHEN o_orderkey % 997 = 0 THEN 0 ELSE 480 + o_orderkey % 2 * 240 END::INT AS height FROM orders),
r AS (SELECT l_orderkey AS image, ((l_linenumber * 1000003 + l_partkey) * 10007 + l_suppkey) * 101 + l_quantity::BIGINT AS box_id, l_linestatus,
  (l_partkey % 4) * 8.0::DOUBLE / 64.0 AS x1, (l_suppkey % 4) * 8.0::DOUBLE / 64.0 AS y1, ((l_partkey % 4) * 8.0::DOUBLE + 20 + l_quantity % 16) / 64.0 AS x2r,
  ((l_suppkey % 4) * 8.0::DOUBLE + 20 + l_partkey % 16) / 64.0 AS y2r FROM lineitem WHERE l_linenumber <= 2),
b AS (SELECT image, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 1 END AS cls, x1, y1,
  CASE WHEN box_id % 101 = 0 THEN x1 WHEN box_id % 103 = 0 THEN x1 + 1e-4 ELSE x2r + CASE WHEN box_id % 107 = 0 THEN 1 ELSE 0 END END AS x2,
  CASE WHEN box_id % 103 = 0 THEN y1 + 1e-4 ELSE y2r END AS y2 FROM r)
"""


@query(SAMPLES + """, f AS (SELECT b.*, (x2 <= x1 OR y2 <= y1) AS flat FROM b),
h AS (SELECT image, 'degenerate_box' AS kind FROM f WHERE flat
  UNION ALL SELECT image, 'suspiciously_small' FROM f WHERE NOT flat AND (x2 - x1) * (y2 - y1) < 1e-5
  UNION ALL SELECT image, 'box_out_of_bounds' FROM f WHERE least(x1, y1) < -1e-6 OR greatest(x2, y2) > 1 + 1e-6
  UNION ALL SELECT image, 'unreadable' FROM s WHERE width <= 0 OR height <= 0),
c AS (SELECT kind, count(*) AS count, array_to_string((list(image::VARCHAR ORDER BY image::VARCHAR))[1:8], ',') AS files FROM h GROUP BY 1)
SELECT kind, CASE WHEN kind = 'suspiciously_small' THEN 'warning' ELSE 'error' END AS severity, count, files FROM c
UNION ALL SELECT 'class_imbalance', 'warning', n, '' FROM (SELECT min(n) AS n, count(*) AS k FROM (SELECT count(*) AS n FROM b GROUP BY cls)) WHERE k > 1 AND n < 20
UNION ALL SELECT 'few_negatives', 'warning', n, '' FROM (SELECT count(*) - (SELECT count(DISTINCT image) FROM b) AS n, count(*) AS t FROM s) WHERE n / t::DOUBLE < 0.1
UNION ALL SELECT 'too_few_groups', 'warning', g, '' FROM (SELECT count(DISTINCT grp) AS g FROM s) WHERE g < 3""")
def dataset_audit(spark, sf):
    return governance.audit(samples(spark, sf), sample_boxes(spark, sf)).withColumn("files", F.array_join("files", ","))


HEALTH = SAMPLES + """, t AS (SELECT s.*, CASE WHEN image % 10 < 7 THEN 'train' WHEN image % 10 < 9 THEN 'val' ELSE 'test' END AS split FROM s),
n AS (SELECT t.*, coalesce(k, 0) AS k FROM t LEFT JOIN (SELECT image, count(*) AS k FROM b GROUP BY 1) USING (image))
"""


def split_samples(spark, sf):
    digit = F.col("image") % 10
    return samples(spark, sf).withColumn("split", F.when(digit < 7, "train").when(digit < 9, "val").otherwise("test"))


@query(HEALTH + """SELECT split, count(*) AS images, sum(k)::BIGINT AS boxes, count_if(k = 0)::BIGINT AS clean_frames, count(DISTINCT grp) AS groups
  FROM n GROUP BY ROLLUP (split)""")
def dataset_health(spark, sf):
    return governance.health(split_samples(spark, sf), sample_boxes(spark, sf))


@query(SAMPLES + """, k AS (SELECT CASE WHEN x2 <= x1 OR y2 <= y1 THEN 1 END AS flat, CASE WHEN least(x1, y1) < -1e-6 OR greatest(x2, y2) > 1 + 1e-6 THEN 1 END AS far FROM b),
e AS (SELECT (count(flat) > 0)::INT + (count(far) > 0)::INT + (SELECT (count(*) > 0)::INT FROM s WHERE width <= 0) AS n FROM k)
SELECT '' AS empty_splits, n::BIGINT AS blocking_errors, n = 0 AS usable FROM e""")
def dataset_usable(spark, sf):
    boxes, rows = sample_boxes(spark, sf), split_samples(spark, sf)
    issues = governance.audit(rows, boxes)
    out = governance.usable(issues, governance.health(rows, boxes).where(F.col("split").isNotNull()))
    return out.withColumn("empty_splits", F.array_join("empty_splits", ","))


@query(SAMPLES + """SELECT count(*) AS num_images, count(DISTINCT b.image) AS num_labelled_images, count(*) - count(DISTINCT b.image) AS num_unlabelled_images,
  min(CASE WHEN width > 0 THEN width END) AS min_width, min(CASE WHEN width > 0 THEN height END) AS min_height, max(width) AS max_width, max(height) AS max_height,
  count(DISTINCT CASE WHEN width > 0 THEN width || 'x' || height END) AS distinct_sizes, (SELECT count(*) FROM b) AS num_boxes, 0::BIGINT AS num_polygons
FROM s LEFT JOIN (SELECT DISTINCT image FROM b) b ON b.image = s.image""")
def dataset_summary(spark, sf):
    return governance.summary(samples(spark, sf), sample_boxes(spark, sf))


@query(SAMPLES + "SELECT cls, count(*) AS n FROM b GROUP BY 1")
def class_distribution(spark, sf):
    return governance.class_counts(sample_boxes(spark, sf))


@query(f"""WITH g AS (SELECT source AS grp, count(*) AS n, {draw_sql(5, "source")} AS spot FROM documents GROUP BY 1),
r AS (SELECT *, row_number() OVER w AS place, sum(n) OVER w AS upto FROM g WINDOW w AS (ORDER BY spot, grp ROWS UNBOUNDED PRECEDING)),
t AS (SELECT sum(CASE WHEN place <= 3 THEN n ELSE 0 END) AS taken, sum(n) AS whole FROM r),
m AS (SELECT grp, place, (upto - taken - n / 2.0::DOUBLE) / greatest(whole - taken, 1) AS middle FROM r, t)
SELECT doc_id, grp, CASE WHEN place <= 3 THEN ['train', 'val', 'test'][place] WHEN middle < 0.7::DOUBLE THEN 'train'
  WHEN middle < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM documents JOIN m ON grp = source""")
def grouped_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("grp"))
    return docs.join(governance.grouped_split(docs, "grp", seed=5), "grp").select("doc_id", "grp", "split")


@query(f"""SELECT doc_id, CASE WHEN spot < 0.7::DOUBLE THEN 'train' WHEN spot < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, {draw_sql(5, "doc_id")} / {RANGE}::DOUBLE AS spot FROM documents)""")
def ungrouped_split(spark, sf):
    return governance.hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id", seed=5)


LEAKY = "CASE WHEN doc_id % 30 < 10 THEN 'train' WHEN doc_id % 7 < 5 THEN 'train' WHEN doc_id % 7 = 5 THEN 'val' ELSE 'test' END"


@query(f"""SELECT source || '-' || (doc_id % 30) AS grp, count(DISTINCT {LEAKY}) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT {LEAKY}) > 1""")
def split_leak_check(spark, sf):
    """Groups that never straddle (a third of them) beside groups that do."""
    third, digit = F.col("doc_id") % 30, F.col("doc_id") % 7
    docs = table(spark, sf, "documents").select(
        F.concat_ws("-", "source", third.cast("string")).alias("grp"),
        F.when((third < 10) | (digit < 5), "train").when(digit == 5, "val").otherwise("test").alias("split"))
    return governance.straddling_groups(docs)


@query("""SELECT l_partkey, arg_min(l_orderkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_orderkey, arg_min(l_suppkey, (l_shipdate, l_orderkey, l_linenumber)) AS l_suppkey
  FROM lineitem GROUP BY 1""")
def distinct_first(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return ranking.first_per_group(rows, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber"]).select("l_partkey", "l_orderkey", "l_suppkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') o ON o_orderkey = l_orderkey")
def hard_negative_pick(spark, sf):
    flagged = table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(flagged, "l_orderkey", "left_semi")


@query("""SELECT event_id, user_id, value AS purchase_value, NULL::DOUBLE AS view_k FROM events WHERE event_type = 'purchase'
  UNION ALL SELECT event_id, user_id, NULL, json_extract_string(props, '$.k')::DOUBLE FROM events WHERE event_type = 'view'""")
def union_streams_missing_cols(spark, sf):
    e = events(spark, sf)
    a = e.where(F.col("event_type") == "purchase").select("event_id", "user_id", F.col("value").alias("purchase_value"))
    b = e.where(F.col("event_type") == "view").select(
        "event_id", "user_id", parsing.safe_double(F.get_json_object("props", "$.k")).alias("view_k"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT doc_id AS frame, 'length' AS model, 0.25::DOUBLE AS conf, (n_chars % 4)::INT AS ndet, round((n_chars % 100) / 100.0, 6) AS score
  FROM documents WHERE lang <> 'en'""")
def scoring_cache(spark, sf):
    """Documents scored by a user's batch function; English ones are cached already."""
    docs = table(spark, sf, "documents")
    cache = docs.where(F.col("lang") == "en").select(
        F.col("doc_id").alias("frame"), F.lit("length").alias("model"), F.lit(0.25).alias("conf"))

    def scorer(batches):
        for pdf in batches:
            yield pdf[["frame"]].assign(ndet=(pdf["n_chars"] % 4).astype("int32"), score=(pdf["n_chars"] % 100) / 100.0)

    frames = docs.select(F.col("doc_id").alias("frame"), "n_chars")
    return rounded(caching.score_missing(frames, cache, "length", 0.25, scorer))


@query("""SELECT l_orderkey AS frame, max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS fp_det, max(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS fp_seg,
  count_if(l_linestatus = 'O')::BIGINT AS ndet_det, count_if(l_linestatus = 'F')::BIGINT AS ndet_seg,
  round(max(CASE WHEN l_linestatus = 'O' THEN l_discount END), 6) AS score_det, round(max(CASE WHEN l_linestatus = 'F' THEN l_discount END), 6) AS score_seg
  FROM lineitem GROUP BY 1""")
def wide_model_columns(spark, sf):
    """Long per-model scores pivoted into the wide frame table."""
    scores = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("frame"), F.when(F.col("l_linestatus") == "O", "det").otherwise("seg").alias("model")
    ).agg(F.count(F.lit(1)).alias("ndet"), F.max("l_discount").alias("score"))
    return rounded(caching.pivot_models(scores, ["det", "seg"]))


