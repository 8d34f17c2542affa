"""Gates, pass reports and the release gate on line items, orders and users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates
from .bindings import events, frames, gt_boxes, images, predictions
from .registry import query, table
from .statistics import FRAMES, rounded

SPEC = gates.Envelope(0.2, 0.8, 0.3)
GATED = FRAMES + """, g AS (SELECT *, CASE WHEN NOT locked THEN 'unknown' WHEN standoff < 0.2 OR standoff > 0.8 OR net_speed > 0.3
    THEN 'out_of_envelope' ELSE 'in_envelope' END AS status,
  CASE WHEN NOT locked THEN ['net-plane estimate not locked'] ELSE list_filter([
    CASE WHEN standoff < 0.2 THEN printf('standoff %.2f m below validated minimum %.2f m', standoff, 0.2::DOUBLE) END,
    CASE WHEN standoff > 0.8 THEN printf('standoff %.2f m above validated maximum %.2f m', standoff, 0.8::DOUBLE) END,
    CASE WHEN net_speed > 0.3 THEN printf('sweep speed %.2f m/s above validated maximum %.2f m/s', net_speed, 0.3::DOUBLE) END],
    lambda x: x IS NOT NULL) END AS reasons FROM fr)
"""


def gated(spark, sf):
    return gates.envelope_gate(frames(spark, sf), SPEC)


@query(GATED + """SELECT l_orderkey, l_linenumber, partkey, clip, round(standoff, 4) AS standoff, round(net_speed, 4) AS net_speed, locked,
  status, array_to_string(reasons, '; ') AS reasons FROM g""")
def envelope_gate(spark, sf):
    return gated(spark, sf).select(
        "l_orderkey", "l_linenumber", "partkey", "clip", F.round("standoff", 4).alias("standoff"),
        F.round("net_speed", 4).alias("net_speed"), "locked", "status", F.concat_ws("; ", "reasons").alias("reasons"),
    )


@query(GATED + """, v AS (SELECT clip, count(*) AS frames, count_if(status = 'in_envelope') AS in_envelope,
  count_if(status = 'out_of_envelope') AS out_of_envelope, count_if(status = 'unknown') AS unknown FROM g GROUP BY clip)
SELECT clip, frames, in_envelope::BIGINT AS in_envelope, out_of_envelope::BIGINT AS out_of_envelope, unknown::BIGINT AS unknown,
  round(in_envelope / frames::DOUBLE, 4) AS compliance,
  CASE WHEN in_envelope / frames::DOUBLE >= 0.95 THEN 'accept — inspection flown inside validated conditions'
       WHEN in_envelope / frames::DOUBLE >= 0.80 THEN 'accept with note — a minority of frames fell outside validated conditions'
       ELSE 're-fly recommended — most frames fell outside validated conditions' END AS verdict FROM v""")
def pass_validity(spark, sf):
    return gates.validity(gated(spark, sf), ["clip"])


@query(GATED + """, r AS (SELECT linestatus, unnest(reasons) AS r FROM g),
k AS (SELECT linestatus, split_part(r, ' ', 1) || ' ' || split_part(r, ' ', 2) AS reason, count(*) AS n FROM r GROUP BY 1, 2)
SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY linestatus ORDER BY n DESC, reason) <= 5""")
def top_reasons(spark, sf):
    return gates.top_reasons(gated(spark, sf), ["linestatus"])


@query(GATED + """, t AS (SELECT clip, count(*) AS n FROM g GROUP BY clip),
s AS (SELECT clip, status, count(*) AS frames FROM g WHERE status <> 'in_envelope' GROUP BY 1, 2),
r AS (SELECT clip, status, reason, count(*) AS n FROM (SELECT clip, status, unnest(reasons) AS reason FROM g WHERE status <> 'in_envelope') GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY clip, status ORDER BY count(*) DESC, reason) <= 3)
SELECT s.clip, s.status, s.frames, round(s.frames / t.n::DOUBLE, 4) AS share, r.reason, r.n
FROM s JOIN t USING (clip) JOIN r ON r.clip = s.clip AND r.status = s.status""")
def not_inspected(spark, sf):
    return gates.not_inspected(gated(spark, sf), ["clip"])


BAND = gates.Band(10000.0, 80000.0, 5.0, 45.0)


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, list_filter([
  CASE WHEN floor(l_extendedprice) < 10000 THEN format('sharpness {:.0f} below validated minimum 10000 (blur / light loss)', floor(l_extendedprice)) END,
  CASE WHEN floor(l_extendedprice) > 80000 THEN format('sharpness {:.0f} above validated maximum 80000 (fine structure resolved)', floor(l_extendedprice)) END,
  CASE WHEN l_quantity < 5 THEN format('contrast {:.1f} below validated minimum 5.0', l_quantity) END,
  CASE WHEN l_quantity > 45 THEN format('contrast {:.1f} above validated maximum 45.0', l_quantity) END], lambda x: x IS NOT NULL) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, len(r) = 0 AS in_band, array_to_string(r, '; ') AS reasons FROM b""")
def band_check(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.floor("l_extendedprice").cast("double").alias("sharpness"),
        F.col("l_quantity").alias("contrast"),
    )
    out = gates.band_check(rows, BAND)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "in_band", F.concat_ws("; ", "band_reasons").alias("reasons"))


RUNS = """
WITH e AS (SELECT user_id, event_id, event_type = 'error' AS hit FROM events),
c AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
r AS (SELECT user_id, run::BIGINT AS run, count(*) AS frames, min(event_id) AS first, max(event_id) AS last FROM c WHERE hit GROUP BY 1, 2)
"""


@query(RUNS + "SELECT * FROM r")
def event_runs(spark, sf):
    return gates.event_runs(events(spark, sf), ["user_id"], ["event_id"], F.col("event_type") == "error")


@query("""
WITH e AS (SELECT user_id, event_id, event_type = 'error' AS hit, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events),
c AS (SELECT *, sum(CASE WHEN hit AND NOT coalesce(event_id - b > 100, false) THEN 0 ELSE 1 END)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
r AS (SELECT user_id, run, count(*) AS frames FROM c WHERE hit GROUP BY 1, 2)
SELECT user_id, count(*) AS candidate_events, count_if(frames >= 3)::BIGINT AS confirmed_events, max(frames) AS longest_event FROM r GROUP BY 1""")
def event_runs_with_gap(spark, sf):
    """Runs that also end where the frame number jumps."""
    runs = gates.event_runs(
        events(spark, sf), ["user_id"], ["event_id"], F.coalesce(F.col("event_type") == "error", F.lit(False)), max_index_gap=100
    )
    return gates.run_summary(runs, ["user_id"])


@query("""
WITH fr AS (SELECT user_id AS clip, event_id, value / 100.0 AS standoff, value / 1000.0 AS net_speed, event_type <> 'signup' AS locked,
  value AS sharpness, CASE WHEN event_type = 'error' THEN 2 WHEN event_type = 'click' THEN 1 ELSE 0 END AS ndet FROM events),
g AS (SELECT *, CASE WHEN NOT locked THEN 'unknown' WHEN standoff < 0.05 OR standoff > 0.9 OR net_speed > 0.2 THEN 'out_of_envelope' ELSE 'in_envelope' END AS status,
  sum(CASE WHEN ndet > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM fr),
r AS (SELECT clip, run, count(*) AS frames FROM g WHERE ndet > 0 GROUP BY 1, 2),
rs AS (SELECT clip, count(*) AS candidate_events, count_if(frames >= 3)::BIGINT AS confirmed_events, max(frames) AS longest_event FROM r GROUP BY 1),
v AS (SELECT clip, count(*) AS frames, count_if(status = 'in_envelope')::BIGINT AS in_envelope, count_if(status = 'out_of_envelope')::BIGINT AS out_of_envelope,
  count_if(status = 'unknown')::BIGINT AS unknown, round(avg(standoff), 3) AS standoff_mean, round(min(standoff), 2) AS standoff_min,
  round(max(standoff), 2) AS standoff_max, round(avg(net_speed), 3) AS net_speed_mean, round(avg(sharpness), 1) AS sharpness_mean,
  count_if(ndet > 0)::BIGINT AS frames_with_detection, sum(ndet)::BIGINT AS total_detections,
  round(avg(CASE WHEN status = 'in_envelope' THEN (ndet > 0)::INT END), 4) AS rate_in_envelope,
  round(avg(CASE WHEN status <> 'in_envelope' THEN (ndet > 0)::INT END), 4) AS rate_outside_envelope,
  round(avg((sharpness >= 20 AND sharpness <= 200)::INT), 4) AS share_in_band FROM g GROUP BY clip)
SELECT v.*, round(in_envelope / frames::DOUBLE, 4) AS compliance,
  CASE WHEN in_envelope / frames::DOUBLE >= 0.95 THEN 'accept — inspection flown inside validated conditions'
       WHEN in_envelope / frames::DOUBLE >= 0.80 THEN 'accept with note — a minority of frames fell outside validated conditions'
       ELSE 're-fly recommended — most frames fell outside validated conditions' END AS verdict,
  coalesce(candidate_events, 0) AS candidate_events, coalesce(confirmed_events, 0) AS confirmed_events, coalesce(longest_event, 0) AS longest_event
FROM v LEFT JOIN rs USING (clip)""")
def pass_report(spark, sf):
    rows = events(spark, sf).select(
        F.col("user_id").alias("clip"), "event_id", (F.col("value") / 100.0).alias("standoff"),
        (F.col("value") / 1000.0).alias("net_speed"), (F.col("event_type") != "signup").alias("locked"),
        F.col("value").alias("sharpness"),
        F.when(F.col("event_type") == "error", 2).when(F.col("event_type") == "click", 1).otherwise(0).alias("ndet"),
    )
    return gates.pass_report(
        rows, gates.Envelope(0.05, 0.9, 0.2), order=["event_id"], ndet="ndet", band=(20.0, 200.0)
    )


IMAGES = """
WITH im AS (SELECT o_orderkey AS image, o_orderpriority AS "set" FROM orders),
gt AS (SELECT DISTINCT l_orderkey AS image FROM lineitem WHERE l_linenumber <= 2),
tp AS (SELECT l_orderkey AS image, max(l_discount * 10.0) AS top_score, count(*) AS ndet FROM lineitem WHERE l_linenumber > 2 GROUP BY 1),
sc AS (SELECT im.image, im."set", gt.image IS NOT NULL AS damaged, top_score, coalesce(ndet, 0) AS ndet
  FROM im LEFT JOIN gt USING (image) LEFT JOIN tp USING (image)),
th AS (SELECT round(0.05 * i, 2)::DOUBLE AS conf FROM range(1, 19) t(i)),
sw AS (SELECT conf, count_if(NOT damaged)::BIGINT AS clean_frames, count_if(damaged)::BIGINT AS damaged_frames,
  count_if(NOT damaged AND coalesce(top_score >= conf, false))::BIGINT AS false_alarm_frames,
  count_if(damaged AND coalesce(top_score >= conf, false))::BIGINT AS detected_frames FROM sc, th GROUP BY conf),
sr AS (SELECT *, false_alarm_frames / clean_frames::DOUBLE AS false_alarm_rate, detected_frames / damaged_frames::DOUBLE AS recall,
  CASE WHEN detected_frames + false_alarm_frames > 0 THEN detected_frames / (detected_frames + false_alarm_frames)::DOUBLE END AS precision FROM sw)
"""
RATES = "round(false_alarm_rate, 6) AS false_alarm_rate, round(recall, 6) AS recall, round(precision, 6) AS precision"
COUNTS = "conf, clean_frames, damaged_frames, false_alarm_frames, detected_frames"


def scores(spark, sf):
    return gates.image_scores(images(spark, sf), gt_boxes(spark, sf), predictions(spark, sf))


@query(IMAGES + f"SELECT {COUNTS}, {RATES} FROM sr WHERE conf = 0.25::DOUBLE")
def release_measure(spark, sf):
    return rounded(gates.release_measure(scores(spark, sf), 0.25))


@query(IMAGES + f"SELECT {COUNTS}, {RATES} FROM sr")
def threshold_sweep(spark, sf):
    return rounded(gates.threshold_sweep(scores(spark, sf)))


@query(IMAGES + f"""SELECT 0.4::DOUBLE AS target_false_alarm_rate, true AS achievable, conf, {RATES} FROM sr
WHERE false_alarm_rate <= 0.4 ORDER BY conf LIMIT 1""")
def choose_threshold(spark, sf):
    return rounded(gates.choose_threshold(gates.threshold_sweep(scores(spark, sf)), 0.4))


@query(IMAGES + """, m AS (SELECT * FROM sr WHERE conf = 0.25::DOUBLE),
c AS (SELECT 0 AS position, 'clean frames' AS "check", clean_frames::DOUBLE AS value, 50.0 AS bound, '>=' AS rule, clean_frames >= 50 AS passed FROM m
UNION ALL SELECT 1, 'damaged frames', damaged_frames::DOUBLE, 50.0, '>=', damaged_frames >= 50 FROM m
UNION ALL SELECT 2, 'false alarm rate', round(false_alarm_rate, 6), 0.05, '<=', coalesce(false_alarm_rate <= 0.05, false) FROM m
UNION ALL SELECT 3, 'recall', round(recall, 6), 0.8, '>=', coalesce(recall >= 0.8, false) FROM m)
SELECT position, "check", value::DOUBLE AS value, bound::DOUBLE AS bound, rule, passed,
  CASE WHEN (SELECT bool_and(passed) FROM c) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM c""")
def release_gate(spark, sf):
    return rounded(gates.release_gate(gates.release_measure(scores(spark, sf), 0.25)))
