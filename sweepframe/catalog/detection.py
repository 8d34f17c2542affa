"""Detection tables derived from line items: orders are images, lines 1-2 truth, the rest predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxpairs, detections, gates, matching
from ..plans import pin
from .bindings import box_rows, gt_boxes, images, predictions
from .registry import query, table
from .statistics import rounded
from .verdicts import IMAGES, scores

BOXES = """
WITH RECURSIVE bx AS (SELECT l_orderkey AS image,
  ((l_linenumber * 1000003 + l_partkey) * 10007 + l_suppkey) * 101 + l_quantity::BIGINT AS box_id,
  (l_partkey % 4) * 8.0::DOUBLE AS x1, (l_suppkey % 4) * 8.0::DOUBLE AS y1, (l_partkey % 4) * 8.0::DOUBLE + 20 + l_quantity % 16 AS x2,
  (l_suppkey % 4) * 8.0::DOUBLE + 20 + l_partkey % 16 AS y2, l_linestatus AS class_name, l_discount * 10.0::DOUBLE AS score,
  l_linenumber AS line, l_suppkey AS clip, CASE WHEN l_tax > 0 THEN l_quantity - 20.0 END AS contrast FROM lineitem),
gt AS (SELECT * FROM bx WHERE line <= 2), pr AS (SELECT * FROM bx WHERE line > 2),
im AS (SELECT o_orderkey AS image, o_orderpriority AS "set" FROM orders)
"""


def iou_sql(a: str, b: str, eps: str = "") -> str:
    inter = (
        f"(greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * "
        f"greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"
    )
    areas = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1))"
    return f"({inter} / ({areas} - {inter}{eps}))"


def match_sql(thresholds, pr="pr", gt="gt", key="image", cls="") -> str:
    """Greedy matching as a recursive walk along each image's ranking."""
    th = " UNION ALL ".join(f"SELECT {t}::DOUBLE AS thr" for t in thresholds)
    using = key + (f", {cls}" if cls else "")
    same = " AND ".join(f"{{0}}.{k} IS NOT DISTINCT FROM {{1}}.{k}" for k in using.replace(" ", "").split(","))
    cols = ", ".join(f"m.{k}" for k in using.replace(" ", "").split(","))
    return f""",
th AS ({th}),
pairs AS (SELECT {', '.join('p.' + k for k in using.replace(' ', '').split(','))}, p.box_id AS pid, g.box_id AS gid, {iou_sql('p', 'g')} AS iou
  FROM {pr} p JOIN {gt} g ON {same.format('p', 'g')}),
pn AS (SELECT {using}, box_id, score, row_number() OVER (PARTITION BY {using} ORDER BY score DESC, box_id) AS n FROM {pr}),
cand AS (SELECT {using}, pid, thr, list(gid ORDER BY iou DESC, gid) AS gids FROM pairs, th WHERE iou > 0 AND iou >= thr GROUP BY ALL),
m AS (SELECT DISTINCT {using}, thr, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS pid, NULL::DOUBLE AS score, NULL::BIGINT AS gid FROM pn, th
  UNION ALL
  SELECT {using}, thr, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pid, score, pick FROM (
    SELECT {cols}, m.thr, pn.n, m.used, pn.box_id AS pid, pn.score,
      list_filter(coalesce(c.gids, []::BIGINT[]), lambda g: NOT list_contains(m.used, g))[1] AS pick
    FROM m JOIN pn ON {same.format('m', 'pn')} AND pn.n = m.n + 1
    LEFT JOIN cand c ON {same.format('m', 'c')} AND c.pid = pn.box_id AND c.thr = m.thr)),
mt AS (SELECT * FROM m WHERE n > 0)
"""


PRF = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END, 6) AS recall,
  round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END, 6) AS f1"""


def matched(spark, sf, thresholds=0.5, **options):
    return matching.greedy_match(
        detections.scored(predictions(spark, sf), images(spark, sf)), gt_boxes(spark, sf), iou_threshold=thresholds, **options
    )


@query(BOXES + match_sql([0.5]) + f"""SELECT thr AS iou_threshold, tp, fp, g - tp AS fn, {PRF.replace('fn', '(g - tp)')} FROM (
  SELECT thr, count(gid) AS tp, count(*) - count(gid) AS fp, (SELECT count(*) FROM gt) AS g FROM mt GROUP BY thr)""")
def greedy_match_prf(spark, sf):
    return rounded(detections.match_totals(matched(spark, sf), gt_boxes(spark, sf)))


@query(BOXES + match_sql([0.5]) + "SELECT image, pid AS box_id, gid AS gt_id, round(score, 6) AS score FROM mt")
def greedy_match_rows(spark, sf):
    return rounded(matched(spark, sf).select("image", "box_id", "gt_id", "score"))


AP_SQL = """,
ra AS (SELECT {keys}thr, row_number() OVER w AS r, sum(CASE WHEN gid IS NULL THEN 0 ELSE 1 END) OVER w AS tp FROM mt
  WINDOW w AS (PARTITION BY {keys}thr ORDER BY score DESC, image, pid ROWS UNBOUNDED PRECEDING)),
pc AS (SELECT {keys}thr, tp / r::DOUBLE AS precision, tp / g::DOUBLE AS recall FROM ra {gtj}),
lv AS (SELECT i * 0.01::DOUBLE AS lev FROM range(0, 101) t(i)),
mx AS (SELECT {keys}thr, lev, max(precision) AS p FROM pc, lv WHERE recall >= lev GROUP BY ALL),
ap AS (SELECT {keys}thr, sum(p) / 101 AS ap FROM mx GROUP BY ALL)
"""
GT_ALL = ", (SELECT count(*) AS g FROM gt)"
IOUS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


@query(BOXES + match_sql([0.5, 0.75]) + AP_SQL.format(keys="", gtj=GT_ALL) + "SELECT thr AS iou_threshold, round(ap, 6) AS ap FROM ap")
def average_precision(spark, sf):
    return rounded(detections.average_precision(matched(spark, sf, [0.5, 0.75]), gt_boxes(spark, sf)))


@query(BOXES + match_sql(IOUS) + AP_SQL.format(keys="", gtj=GT_ALL) + """SELECT round(sum(ap) / 10, 4) AS map_50_95,
  round(max(CASE WHEN thr = 0.5::DOUBLE THEN ap END), 4) AS map_50, round(max(CASE WHEN thr = 0.75::DOUBLE THEN ap END), 4) AS map_75 FROM ap""")
def map_50_95(spark, sf):
    return detections.coco_map(matched(spark, sf, list(detections.COCO_IOUS)), gt_boxes(spark, sf))


def per_class_sql(pr: str = "pr", gt: str = "gt") -> str:
    """Every class of the truths or the predictions, with zeros where one side has none."""
    return match_sql([0.5], pr=pr, gt=gt, cls="class_name") + AP_SQL.format(
        keys="class_name, ", gtj=f"JOIN (SELECT class_name, count(*) AS g FROM {gt} GROUP BY 1) USING (class_name)") + f""",
t AS (SELECT class_name, count(gid) AS tp, count(*) - count(gid) AS fp FROM mt GROUP BY 1),
g AS (SELECT class_name, count(*) AS g FROM {gt} GROUP BY 1),
u AS (SELECT k.class_name, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(g, 0) - coalesce(tp, 0) AS fn, coalesce(ap, 0) AS ap
  FROM (SELECT class_name FROM {pr} UNION SELECT class_name FROM {gt}) k LEFT JOIN t USING (class_name) LEFT JOIN g USING (class_name) LEFT JOIN ap USING (class_name))
"""


@query(BOXES + per_class_sql() + f"SELECT class_name, tp, fp, fn, {PRF}, round(ap, 6) AS ap FROM u")
def per_class_prf(spark, sf):
    return rounded(_per_class(spark, sf))


#: A detector that knows one class, truths of both and of a third.
ONE_SIDED = BOXES + """, p1 AS (SELECT * REPLACE (CASE WHEN line = 4 THEN 'extra' ELSE class_name END AS class_name) FROM pr WHERE class_name <> 'F')"""


@query(ONE_SIDED + per_class_sql(pr="p1") + f"SELECT class_name, tp, fp, fn, {PRF}, round(ap, 6) AS ap FROM u")
def per_class_one_sided(spark, sf):
    """Classes that only the truths or only the predictions have."""
    return rounded(_per_class(spark, sf, _one_sided(spark, sf)))


@query(ONE_SIDED + per_class_sql(pr="p1") + f"""SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1, round(avg(ap), 4) AS ap
  FROM (SELECT {PRF}, ap FROM u)""")
def macro_average_one_sided(spark, sf):
    return detections.macro_average(_per_class(spark, sf, _one_sided(spark, sf)))


def _one_sided(spark, sf):
    extra = F.when(F.col("line") == 4, "extra").otherwise(F.col("class_name"))
    return predictions(spark, sf).where(F.col("class_name") != "F").withColumn("class_name", extra)


@query(BOXES + """SELECT round(thr, 6) AS iou_threshold, 0 AS tp, 0 AS fp, (SELECT count(*) FROM gt) AS fn, 0.0::DOUBLE AS ap FROM (VALUES (0.5::DOUBLE), (0.75::DOUBLE)) t(thr)""")
def silent_detector(spark, sf):
    """No prediction reaches the detector's own threshold: misses, not an empty report."""
    truths = gt_boxes(spark, sf)
    m = matching.greedy_match(predictions(spark, sf).where(F.col("score") > 1000), truths, iou_threshold=[0.5, 0.75])
    totals = detections.match_totals(m, truths, iou_thresholds=[0.5, 0.75]).select("iou_threshold", "tp", "fp", "fn")
    return rounded(totals.join(detections.average_precision(m, truths, iou_thresholds=[0.5, 0.75]), "iou_threshold"))


def _per_class(spark, sf, preds=None):
    keys = ["image", "class_name"]
    truths = gt_boxes(spark, sf)
    # Read by the totals, the ranking and the keys of its report.
    m = pin(matching.greedy_match(predictions(spark, sf) if preds is None else preds, truths, keys).drop("match_iou"))
    totals = detections.match_totals(m, truths, ["class_name"])
    return totals.join(detections.average_precision(m, truths, ["class_name"]), ["class_name", "iou_threshold"]).drop("iou_threshold")


@query(BOXES + per_class_sql() + f"""SELECT round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1, round(avg(ap), 4) AS ap
  FROM (SELECT {PRF}, ap FROM u)""")
def macro_average(spark, sf):
    return detections.macro_average(_per_class(spark, sf))


SWEEP_SQL = match_sql([0.5]) + """,
cf AS (SELECT unnest([{confs}]::DOUBLE[]) AS conf),
sw AS (SELECT conf, count(CASE WHEN score >= conf THEN gid END) AS tp, count(CASE WHEN score >= conf AND gid IS NULL THEN 1 END) AS fp FROM mt, cf GROUP BY conf),
sv AS (SELECT conf, tp, fp, (SELECT count(*) FROM gt) - tp AS fn FROM sw)
"""
SWEEP = BOXES + SWEEP_SQL.format(confs="0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9")


@query(SWEEP + f"SELECT conf, tp, fp, fn, {PRF} FROM sv")
def conf_sweep_f1(spark, sf):
    return rounded(detections.confidence_sweep(matched(spark, sf), gt_boxes(spark, sf)).drop("iou_threshold"))


@query(SWEEP + f"SELECT conf, tp, fp, fn, {PRF} FROM sv ORDER BY 2.0 * tp / (2 * tp + fp + fn) DESC, conf LIMIT 1")
def best_f1_threshold(spark, sf):
    return rounded(detections.best_f1(detections.confidence_sweep(matched(spark, sf), gt_boxes(spark, sf))))


@query(BOXES + SWEEP_SQL.format(confs="0.05,0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8") + """,
cl AS (SELECT im.image FROM im ANTI JOIN gt USING (image)),
cp AS (SELECT conf, count(pr.score) AS n FROM cf LEFT JOIN (SELECT pr.* FROM pr SEMI JOIN cl USING (image)) pr ON pr.score >= conf GROUP BY conf)
SELECT conf, round(n / (SELECT count(*) FROM cl)::DOUBLE, 3) AS fp_per_clean_frame, round(tp / (tp + fn)::DOUBLE, 3) AS recall,
  round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, 3) AS precision FROM sv JOIN cp USING (conf)""")
def froc_curve(spark, sf):
    truths = gt_boxes(spark, sf)
    clean = images(spark, sf).join(truths.select("image"), "image", "left_anti")
    sweep = detections.confidence_sweep(matched(spark, sf), truths, detections.FROC_CONFS)
    silent = predictions(spark, sf).join(clean.select("image"), "image", "left_semi")
    return detections.froc(sweep, silent, clean.agg(F.count(F.lit(1))).scalar())


@query(BOXES + SWEEP_SQL.format(confs="0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8") + f""",
cl AS (SELECT im.image, max(score) AS top FROM (SELECT image FROM im ANTI JOIN gt USING (image)) im LEFT JOIN pr USING (image) GROUP BY 1),
fr AS (SELECT conf, avg(CASE WHEN top >= conf THEN 1.0 ELSE 0.0 END) AS rate FROM cf, cl GROUP BY conf)
SELECT conf, {PRF}, round(rate, 6) AS undamaged_fp_rate FROM sv JOIN fr USING (conf)""")
def sensitivity_sweep(spark, sf):
    confs = [round(0.1 * i, 1) for i in range(1, 9)]
    boxes = detections.confidence_sweep(matched(spark, sf), gt_boxes(spark, sf), confs)
    frame_level = gates.threshold_sweep(scores(spark, sf), confs)
    return rounded(boxes.join(F.broadcast(frame_level.select("conf", F.col("false_alarm_rate").alias("undamaged_fp_rate"))), "conf").select(
        "conf", "precision", "recall", "f1", "undamaged_fp_rate"))


@query(IMAGES + """SELECT "set", count(*) AS frames, sum(ndet)::BIGINT AS detections, round(avg(ndet), 3) AS mean_per_frame,
  count_if(ndet > 0)::BIGINT AS alarming, round(avg(CASE WHEN ndet > 0 THEN 1.0 ELSE 0.0 END), 3) AS fp_frame_rate
  FROM sc WHERE NOT damaged GROUP BY ROLLUP ("set")""")
def fp_by_set(spark, sf):
    clean = images(spark, sf).join(gt_boxes(spark, sf).select("image"), "image", "left_anti")
    return detections.false_alarms_by_set(detections.detection_counts(clean, predictions(spark, sf)))


@query(IMAGES + """, c AS (SELECT count_if(damaged AND f)::BIGINT AS tp, count_if(NOT damaged AND f)::BIGINT AS fp,
  count_if(NOT damaged AND NOT f)::BIGINT AS tn, count_if(damaged AND NOT f)::BIGINT AS fn
  FROM (SELECT damaged, coalesce(top_score >= 0.25::DOUBLE, false) AS f FROM sc))
SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 6) AS accuracy, """ + PRF + " FROM c")
def image_level_confusion(spark, sf):
    return rounded(detections.image_confusion(scores(spark, sf)))


NMS_SQL = f""",
bn AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, box_id) AS n FROM pr),
cf AS (SELECT b.image, b.box_id, list(a.box_id) AS rivals FROM bn a JOIN bn b ON a.image = b.image AND a.n < b.n
  WHERE {iou_sql('a', 'b', ' + 1e-9')} > 0.45 GROUP BY 1, 2),
m AS (SELECT DISTINCT image, 0::BIGINT AS n, []::BIGINT[] AS kept, NULL::BIGINT AS box_id, NULL::DOUBLE AS score, NULL::BOOLEAN AS keep FROM bn
  UNION ALL
  SELECT image, n, CASE WHEN ok THEN list_append(kept, bid) ELSE kept END, bid, score, ok FROM (
    SELECT m.image, bn.n, m.kept, bn.box_id AS bid, bn.score, NOT list_has_any(m.kept, coalesce(c.rivals, []::BIGINT[])) AS ok
    FROM m JOIN bn ON bn.image = m.image AND bn.n = m.n + 1 LEFT JOIN cf c ON c.image = m.image AND c.box_id = bn.box_id))
SELECT image, box_id, round(score, 6) AS score FROM m WHERE keep"""


@query(BOXES + NMS_SQL)
def nms_boxes(spark, sf):
    slim = predictions(spark, sf).select("image", "box_id", "x1", "y1", "x2", "y2", "score")
    return rounded(matching.nms(slim).select("image", "box_id", "score"))


@query(BOXES + f"SELECT p.image, p.box_id AS left_id, g.box_id AS right_id, round({iou_sql('p', 'g')}, 9) AS iou FROM pr p JOIN gt g USING (image) WHERE {iou_sql('p', 'g')} > 0")
def iou_pairs(spark, sf):
    return rounded(boxpairs.pair_iou(predictions(spark, sf), gt_boxes(spark, sf), ["image"]), 9)


def _detectors(spark, sf):
    p = predictions(spark, sf)
    return p.where(F.col("line") % 2 == 1), p.where(F.col("line") % 2 == 0)


MODES = ("det", "seg", "union", "agree")
ENSEMBLE = BOXES + f""",
de AS (SELECT * FROM pr WHERE line % 2 = 1 AND score >= 0.25::DOUBLE), se AS (SELECT * FROM pr WHERE line % 2 = 0 AND score >= 0.25::DOUBLE),
va AS (SELECT 'det' AS variant, * FROM de UNION ALL SELECT 'seg', * FROM se
  UNION ALL SELECT 'union', * FROM de UNION ALL SELECT 'union', * FROM se
  UNION ALL SELECT 'agree', * FROM de d WHERE EXISTS (SELECT 1 FROM se s WHERE s.image = d.image AND {iou_sql('d', 's')} >= 0.3::DOUBLE))
"""


def _variants(spark, sf):
    det, seg = _detectors(spark, sf)
    parts = [detections.ensemble(det, seg, mode).withColumn("variant", F.lit(mode)) for mode in MODES]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(ENSEMBLE + """, cl AS (SELECT im.* FROM im ANTI JOIN gt USING (image)), vs AS (SELECT DISTINCT variant FROM va),
n AS (SELECT v.variant, cl."set", cl.image, count(va.box_id) AS ndet FROM cl CROSS JOIN vs v LEFT JOIN va ON va.image = cl.image AND va.variant = v.variant GROUP BY ALL)
SELECT variant, "set", count(*) AS frames, sum(ndet)::BIGINT AS detections, round(avg(ndet), 4) AS mean_per_frame,
  round(avg(CASE WHEN ndet > 0 THEN 1.0 ELSE 0.0 END), 6) AS fp_frame_rate FROM n GROUP BY 1, 2""")
def ensemble_modes(spark, sf):
    clean = images(spark, sf).join(gt_boxes(spark, sf).select("image"), "image", "left_anti")
    slots = clean.withColumn("variant", F.explode(F.array(*[F.lit(m) for m in MODES])))
    found = _variants(spark, sf).groupBy("image", "variant").agg(F.count(F.lit(1)).alias("ndet"))
    counts = slots.join(found, ["image", "variant"], "left").fillna(0, ["ndet"])
    return rounded(counts.groupBy("variant", "set").agg(
        F.count(F.lit(1)).alias("frames"), F.sum("ndet").alias("detections"), F.round(F.avg("ndet"), 4).alias("mean_per_frame"),
        F.avg(F.when(F.col("ndet") > 0, 1.0).otherwise(0.0)).alias("fp_frame_rate"),
    ))


@query(ENSEMBLE + ", vg AS (SELECT v.variant, gt.* FROM gt, (SELECT DISTINCT variant FROM va) v)"
       + match_sql([0.3], pr="va", gt="vg", cls="variant") + f"""SELECT variant, tp, fp, g - tp AS fn, {PRF.replace('fn', '(g - tp)')} FROM (
  SELECT variant, count(gid) AS tp, count(*) - count(gid) AS fp, (SELECT count(*) FROM gt) AS g FROM mt GROUP BY variant)""")
def ensemble_prf(spark, sf):
    keys = ["image", "variant"]
    truths = gt_boxes(spark, sf).withColumn("variant", F.explode(F.array(*[F.lit(m) for m in MODES])))
    # The union mode may hold a box id twice only if a model does; ids stay unique per variant here.
    m = matching.greedy_match(
        _variants(spark, sf), gt_boxes(spark, sf), keys, iou_threshold=0.3, variants=["variant"], among=box_rows(spark, sf))
    return rounded(detections.match_totals(m, truths, ["variant"]).drop("iou_threshold"))


@query(ENSEMBLE + ", v3 AS (SELECT * FROM va WHERE variant <> 'agree'), vg AS (SELECT v.variant, gt.* FROM gt, (VALUES ('det'), ('seg'), ('union'), ('agree')) v(variant))"
       + match_sql([0.3], pr="v3", gt="vg", cls="variant") + f"""SELECT variant, tp, fp, g - tp AS fn, {PRF.replace('fn', '(g - tp)')} FROM (
  SELECT k.variant, count(gid) AS tp, count(pid) - count(gid) AS fp, (SELECT count(*) FROM gt) AS g
  FROM (VALUES ('det'), ('seg'), ('union'), ('agree')) k(variant) LEFT JOIN mt USING (variant) GROUP BY k.variant)""")
def ensemble_empty_variant(spark, sf):
    """A variant that reports nothing keeps its row."""
    truths = gt_boxes(spark, sf).withColumn("variant", F.explode(F.array(*[F.lit(m) for m in MODES])))
    found = _variants(spark, sf).where(F.col("variant") != "agree")
    m = matching.greedy_match(
        found, gt_boxes(spark, sf), ["image", "variant"], iou_threshold=0.3, variants=["variant"], among=box_rows(spark, sf))
    return rounded(detections.match_totals(m, truths, ["variant"]).drop("iou_threshold"))


METHOD = BOXES + """, mp AS (SELECT CASE WHEN line % 2 = 1 THEN 'odd' ELSE 'even' END AS method, * FROM pr),
mg AS (SELECT v.method, gt.* FROM gt, (VALUES ('odd'), ('even')) v(method))
"""


@query(METHOD + match_sql([0.5], pr="mp", gt="mg", cls="method") + AP_SQL.format(keys="method, ", gtj=GT_ALL) + f""",
t AS (SELECT method, tp, fp, g - tp AS fn FROM (SELECT method, count(gid) AS tp, count(*) - count(gid) AS fp, (SELECT count(*) FROM gt) AS g FROM mt GROUP BY method)),
tops AS (SELECT method, image, max(score) AS top FROM mp GROUP BY 1, 2),
il AS (SELECT v.method, avg(CASE WHEN (g.image IS NOT NULL) = coalesce(tops.top >= 0.25::DOUBLE, false) THEN 1.0 ELSE 0.0 END) AS acc
  FROM im CROSS JOIN (VALUES ('odd'), ('even')) v(method) LEFT JOIN (SELECT DISTINCT image FROM gt) g ON g.image = im.image
  LEFT JOIN tops ON tops.image = im.image AND tops.method = v.method GROUP BY 1)
SELECT method, tp, fp, fn, {PRF}, round(ap, 6) AS ap, round(acc, 6) AS image_accuracy FROM t JOIN ap USING (method) JOIN il USING (method)""")
def method_comparison(spark, sf):
    methods = ("odd", "even")
    preds = predictions(spark, sf).withColumn("method", F.when(F.col("line") % 2 == 1, "odd").otherwise("even"))
    each = F.explode(F.array(*[F.lit(m) for m in methods]))
    truths = gt_boxes(spark, sf).withColumn("method", each)
    # Read by the totals, the ranking and the keys of its report.
    m = pin(matching.greedy_match(preds, gt_boxes(spark, sf), ["image", "method"], variants=["method"]).drop("match_iou"))
    slots = images(spark, sf).withColumn("method", each)
    top = preds.groupBy("image", "method").agg(F.max("score").alias("top_score"))
    known = gt_boxes(spark, sf).select("image").distinct().withColumn("damaged", F.lit(True))
    per_image = slots.join(known, "image", "left").join(top, ["image", "method"], "left").fillna(False, ["damaged"])
    accuracy = detections.image_confusion(per_image, keys=["method"]).select("method", F.col("accuracy").alias("image_accuracy"))
    return rounded(
        detections.match_totals(m, truths, ["method"]).drop("iou_threshold")
        .join(detections.average_precision(m, truths, ["method"]).drop("iou_threshold"), "method").join(accuracy, "method")
    )


@query(BOXES + match_sql([0.5]) + """SELECT im.image, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(g, 0) - coalesce(tp, 0) AS fn FROM im
  LEFT JOIN (SELECT image, count(gid) AS tp, count(*) - count(gid) AS fp FROM mt GROUP BY 1) USING (image)
  LEFT JOIN (SELECT image, count(*) AS g FROM gt GROUP BY 1) USING (image)""")
def eval_per_image(spark, sf):
    return detections.per_image(matched(spark, sf), gt_boxes(spark, sf), images(spark, sf))


@query(BOXES + match_sql([0.5]) + """, q AS (SELECT im.image, coalesce(fp, 0) AS fp FROM im
  LEFT JOIN (SELECT image, count(*) - count(gid) AS fp FROM mt GROUP BY 1) USING (image))
SELECT image, fp FROM q ORDER BY fp DESC, image LIMIT 8""")
def worst_frames(spark, sf):
    """The eight images with most false positives (a top-k report)."""
    per = detections.per_image(matched(spark, sf), gt_boxes(spark, sf), images(spark, sf))
    return per.orderBy(F.col("fp").desc(), "image").limit(8).select("image", "fp")


@query("""SELECT d.lang, count_if(quality = 1)::BIGINT AS positives, count_if(quality = 0)::BIGINT AS negatives,
  round(sum(CASE WHEN quality = 1 THEN rk END - CASE WHEN quality = 1 THEN 0 END) , 1) AS rank_sum,
  round((sum(CASE WHEN quality = 1 THEN rk END) - count_if(quality = 1) * (count_if(quality = 1) + 1) / 2.0)
    / nullif(count_if(quality = 1) * count_if(quality = 0), 0), 6) AS auroc
FROM (SELECT *, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS rk
  FROM labels JOIN documents USING (doc_id)) d GROUP BY 1""".replace(
    "  round(sum(CASE WHEN quality = 1 THEN rk END - CASE WHEN quality = 1 THEN 0 END) , 1) AS rank_sum,\n", ""))
def auroc(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return rounded(detections.auroc(rows, "n_chars", "quality", ["lang"]))


@query(BOXES + """, s AS (SELECT class_name, unnest(['score', 'elongation', 'contrast']) AS measure,
  unnest([score, greatest(x2 - x1, y2 - y1) / least(x2 - x1, y2 - y1), contrast]) AS v, contrast FROM pr WHERE contrast IS NOT NULL),
d AS (SELECT class_name, avg(CASE WHEN contrast > 0 THEN 1.0 ELSE 0.0 END) AS sd FROM pr WHERE contrast IS NOT NULL GROUP BY 1)
SELECT class_name, measure, count(v) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10,
  round(quantile_cont(v, 0.9), 6) AS p90, round(any_value(sd), 6) AS share_darker,
  CASE WHEN any_value(sd) > 0.6 THEN 'consistent with dark damage' ELSE 'refuted' END AS reading FROM s JOIN d USING (class_name) GROUP BY 1, 2""")
def box_stat_summary(spark, sf):
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = predictions(spark, sf).where(F.col("contrast").isNotNull()).select(
        "class_name", "score", (F.greatest(wide, high) / F.least(wide, high)).alias("elongation"), "contrast")
    return rounded(detections.box_stat_summary(rows, "class_name", ["score", "elongation", "contrast"]))


POLARITY = BOXES + """, th AS (SELECT unnest([-1e9, 0.0, 10.0, 15.0, 20.0]::DOUBLE[]) AS min_contrast),
fl AS (SELECT im.image, im."set", g.image IS NOT NULL AS damaged, min_contrast,
  bool_or(coalesce(pr.box_id IS NOT NULL AND coalesce(contrast, 1e300) >= min_contrast, false)) AS hit,
  bool_or(coalesce(pr.score >= 0.25::DOUBLE AND coalesce(contrast, 1e300) >= min_contrast, false)) AS sure
  FROM im CROSS JOIN th LEFT JOIN (SELECT DISTINCT image FROM gt) g ON g.image = im.image LEFT JOIN pr ON pr.image = im.image GROUP BY ALL),
rt AS (SELECT min_contrast, "set", count(*) AS frames, count_if(hit)::BIGINT AS alarming FROM fl WHERE NOT damaged GROUP BY GROUPING SETS ((min_contrast, "set"), (min_contrast))),
rc AS (SELECT min_contrast, count_if(sure) / count(*)::DOUBLE AS recall FROM fl WHERE damaged GROUP BY 1),
po AS (SELECT rt.*, recall, alarming / frames::DOUBLE AS rate FROM rt JOIN rc USING (min_contrast))
"""


def _polarity(spark, sf):
    known = gt_boxes(spark, sf).select("image").distinct().withColumn("damaged", F.lit(True))
    universe = images(spark, sf).join(known, "image", "left").fillna(False, ["damaged"])
    return detections.polarity_sweep(predictions(spark, sf), universe, [-1e9, 0.0, 10.0, 15.0, 20.0])


@query(POLARITY + 'SELECT min_contrast, "set", frames, alarming, round(recall, 6) AS recall, round(rate, 6) AS rate FROM po')
def polarity_sweep(spark, sf):
    return rounded(_polarity(spark, sf))


@query(POLARITY + """SELECT min_contrast, round(rate, 6) AS rate, round(recall, 6) AS recall FROM po WHERE "set" IS NULL
  AND recall >= (SELECT recall FROM po WHERE "set" IS NULL ORDER BY min_contrast LIMIT 1) ORDER BY rate, min_contrast LIMIT 1""")
def polarity_best(spark, sf):
    return rounded(detections.best_polarity(_polarity(spark, sf)))


@query(BOXES + "SELECT image, box_id, round(contrast, 6) AS contrast FROM pr WHERE contrast IS NULL OR contrast >= 10")
def polarity_filter(spark, sf):
    return rounded(detections.polarity_filter(predictions(spark, sf)).select("image", "box_id", "contrast"))


@query("""WITH r AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'baseline' ELSE 'treatment' END AS arm, l_returnflag AS "set",
  strftime(l_shipdate, '%Y') AS seed, avg(l_discount) AS value FROM lineitem GROUP BY ALL),
p AS (SELECT "set", arm, avg(value) AS mean, min(value) AS lo, max(value) AS hi FROM r GROUP BY ALL)
SELECT a."set", round(a.mean, 6) AS mean_a, round(a.lo, 6) AS lo_a, round(a.hi, 6) AS hi_a, round(b.mean, 6) AS mean_b,
  round(b.lo, 6) AS lo_b, round(b.hi, 6) AS hi_b, round(b.mean - a.mean, 6) + 0.0 AS delta,
  CASE WHEN NOT (b.hi < a.lo OR a.hi < b.lo) THEN 'inconclusive' WHEN b.mean < a.mean THEN 'reduced' ELSE 'increased' END AS verdict
FROM p a JOIN p b ON a."set" = b."set" AND a.arm = 'baseline' AND b.arm = 'treatment'""")
def seed_arm_comparison(spark, sf):
    runs = table(spark, sf, "lineitem").groupBy(
        F.when(F.col("l_linestatus") == "O", "baseline").otherwise("treatment").alias("arm"),
        F.col("l_returnflag").alias("set"), F.date_format("l_shipdate", "yyyy").alias("seed"),
    ).agg(F.avg("l_discount").alias("value"))
    return rounded(detections.seed_comparison(runs, "baseline", "treatment"))


@query(BOXES + """, v AS (SELECT 'raw' AS variant, image, count(*) AS n FROM pr GROUP BY 2 UNION ALL SELECT 'confident', image, count(*) FROM pr WHERE score >= 0.5::DOUBLE GROUP BY 2
  UNION ALL SELECT 'odd', image, count(*) FROM pr WHERE line % 2 = 1 GROUP BY 2),
f AS (SELECT x.variant, im.image, g.image IS NOT NULL AS damaged, coalesce(v.n, 0) AS ndet FROM im CROSS JOIN (VALUES ('raw'), ('confident'), ('odd')) x(variant)
  LEFT JOIN (SELECT DISTINCT image FROM gt) g ON g.image = im.image LEFT JOIN v ON v.image = im.image AND v.variant = x.variant),
p AS (SELECT variant, count_if(NOT damaged)::BIGINT AS clean_frames, avg(CASE WHEN NOT damaged THEN (ndet > 0)::INT END) AS alarm_rate,
  sum(CASE WHEN NOT damaged THEN ndet ELSE 0 END)::BIGINT AS boxes, avg(CASE WHEN damaged THEN (ndet > 0)::INT END) AS recall FROM f GROUP BY 1)
SELECT variant, clean_frames, round(alarm_rate, 6) AS alarm_rate, boxes, round(recall, 6) AS recall,
  round(alarm_rate - (SELECT alarm_rate FROM p WHERE variant = 'raw'), 6) + 0.0 AS delta FROM p""")
def variant_ablation(spark, sf):
    p = predictions(spark, sf)
    found = p.groupBy("image").agg(
        F.count(F.lit(1)).alias("raw"), F.count_if(F.col("score") >= 0.5).alias("confident"), F.count_if(F.col("line") % 2 == 1).alias("odd"))
    known = gt_boxes(spark, sf).select("image").distinct().withColumn("damaged", F.lit(True))
    wide = images(spark, sf).join(known, "image", "left").join(found, "image", "left").fillna(False, ["damaged"]).fillna(0)
    tall = wide.unpivot(["image", "damaged"], ["raw", "confident", "odd"], "variant", "ndet")
    return rounded(detections.variant_ablation(tall))


@query(BOXES + """SELECT im.image, coalesce(n, 0) AS ndet, round(coalesce(s, 0.0), 6) AS score, CASE WHEN n > 0 THEN 1 ELSE 0 END AS fp FROM im
  LEFT JOIN (SELECT image, count(*) AS n, max(score) AS s FROM pr WHERE score >= 0.25::DOUBLE GROUP BY 1) USING (image)""")
def scored_left_join(spark, sf):
    confident = predictions(spark, sf).where(F.col("score") >= 0.25)
    return rounded(detections.detection_counts(images(spark, sf).select("image"), confident))


@query("SELECT DISTINCT l_orderkey AS image FROM lineitem ANTI JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON o_orderkey = l_orderkey WHERE l_linenumber > 2")
def unscored_images(spark, sf):
    """Images with predictions that have no ground-truth entry; finished orders are the labelled ones."""
    labelled = table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("image"))
    return detections.unscored_images(predictions(spark, sf), labelled)
