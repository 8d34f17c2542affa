"""Passes in time: tracks, alerts, heartbeats, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detections, ranking, spatial, tracking
from .bindings import TRACK_ORDER, events, motion, pass_boxes, pass_frames
from .registry import query, table
from .statistics import rounded


def tracks_sql(conf: float = 0.25, iou: float = 0.2, max_age: int = 2, min_hits: int = 3) -> str:
    """Common tables ending in ``asg``, the tracker as a recursion over the frames of all passes at once.

    A pass carries its live tracks as a list. In each frame they choose in turn: a fold over one-track
    states, whose accumulator holds the tracks settled so far and the boxes still free.
    """
    side = lambda a, b: f"greatest(0.0::DOUBLE, least({a}2, {b}2) - greatest({a}1, {b}1))"
    area = lambda r: f"greatest(0.0::DOUBLE, {r}.x2 - {r}.x1) * greatest(0.0::DOUBLE, {r}.y2 - {r}.y1)"
    inter = f"({side('k.x', 'bs[j].x')} * {side('k.y', 'bs[j].y')})"
    ratio = f"CASE WHEN {area('k')} + {area('bs[j]')} - {inter} > 0 THEN {inter} / ({area('k')} + {area('bs[j]')} - {inter}) ELSE 0.0::DOUBLE END"
    score = ratio.replace("k.", "x.t[1].")
    # The best free box of a track, as a list of none or one; a list is DuckDB's way to name a value.
    best = f"""[list_max(list_filter(list_transform(a.free, lambda j: {{'iou': {score}, 'j': j}}), lambda c: c.iou >= {iou}))]"""
    moved = """CASE WHEN b IS NULL THEN {'no': x.t[1].no, 'x1': x.t[1].x1, 'y1': x.t[1].y1, 'x2': x.t[1].x2, 'y2': x.t[1].y2, 'hits': x.t[1].hits, 'misses': x.t[1].misses + 1, 'j': NULL::BIGINT}
      ELSE {'no': x.t[1].no, 'x1': bs[b.j].x1, 'y1': bs[b.j].y1, 'x2': bs[b.j].x2, 'y2': bs[b.j].y2, 'hits': x.t[1].hits + 1, 'misses': 0::BIGINT, 'j': b.j} END"""
    fold = f"""list_reduce(list_transform(live, lambda k: {{'t': [k], 'free': []::BIGINT[]}}),
      lambda a, x: list_transform({best}, lambda b: {{'t': list_append(a.t, {moved}), 'free': list_filter(a.free, lambda j: b IS NULL OR j <> b.j)}})[1], {{'t': live[1:0], 'free': range(1, len(bs) + 1)}})"""
    track = "STRUCT(no BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, hits BIGINT, misses BIGINT, j BIGINT)"
    return f"""
WITH RECURSIVE bx AS (SELECT l_suppkey AS clip, l_orderkey AS frame_idx, ((l_linenumber * 1000003 + l_partkey) * 10007 + l_suppkey) * 101 + l_quantity::BIGINT AS box_id, ((l_partkey % 4) * 8.0)::DOUBLE AS x1, ((l_suppkey % 4) * 8.0)::DOUBLE AS y1,
  ((l_partkey % 4) * 8.0 + 20.0 + l_quantity % 16)::DOUBLE AS x2, ((l_suppkey % 4) * 8.0 + 20.0 + l_partkey % 16)::DOUBLE AS y2, (l_discount * 10.0)::DOUBLE AS score, l_quantity FROM lineitem),
fr AS (SELECT clip, frame_idx, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) AS n, max(l_quantity) AS latency_ms, count(*) AS boxes,
  coalesce(list({{'box_id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY box_id) FILTER (WHERE score >= {conf}), []) AS bs FROM bx GROUP BY clip, frame_idx),
tr(clip, n, live, born, out) AS (
  SELECT DISTINCT clip, 0::BIGINT, []::{track}[], 0::BIGINT, []::STRUCT(box_id BIGINT, no BIGINT, hits BIGINT)[] FROM fr
  UNION ALL
  SELECT clip, n, list_concat(list_filter(f.t, lambda k: k.misses <= {max_age}), list_transform(f.free, lambda j, i: {{'no': born + i - 1, 'x1': bs[j].x1, 'y1': bs[j].y1, 'x2': bs[j].x2, 'y2': bs[j].y2, 'hits': 1::BIGINT, 'misses': 0::BIGINT, 'j': j}}))::{track}[], born + len(f.free),
    list_concat(list_transform(list_filter(f.t, lambda k: k.misses = 0), lambda k: {{'box_id': bs[k.j].box_id, 'no': k.no, 'hits': k.hits}}), list_transform(f.free, lambda j, i: {{'box_id': bs[j].box_id, 'no': born + i - 1, 'hits': 1::BIGINT}}))::STRUCT(box_id BIGINT, no BIGINT, hits BIGINT)[]
  FROM (SELECT clip, fr.n, born, bs, CASE WHEN len(live) = 0 THEN {{'t': live, 'free': range(1, len(bs) + 1)}} ELSE {fold} END AS f FROM tr JOIN fr USING (clip) WHERE fr.n = tr.n + 1)
), asg AS (SELECT clip, frame_idx, o.box_id, o.no AS track_id, o.hits, o.hits = 1 AS is_new, o.hits >= {min_hits} AS confirmed FROM (SELECT clip, n, unnest(out) AS o FROM tr) JOIN fr USING (clip, n)),
al AS (SELECT clip, track_id, min(frame_idx) AS frame_idx, arg_min(box_id, frame_idx) AS box_id, arg_min(hits, frame_idx) AS hits FROM asg WHERE confirmed GROUP BY ALL)
"""


TRACKS = tracks_sql()


def assigned(spark, sf):
    return tracking.assign_tracks(pass_frames(spark, sf), pass_boxes(spark, sf))


def alerts(spark, sf):
    return tracking.first_alerts(assigned(spark, sf))


@query(TRACKS + "SELECT * FROM asg")
def temporal_confirm(spark, sf):
    return assigned(spark, sf)


@query(TRACKS + "SELECT clip, frame_idx, box_id, x1, y1, x2, y2, round(score, 6) AS score, track_id, hits FROM asg JOIN bx USING (clip, frame_idx, box_id) WHERE confirmed")
def confirmed_sequence(spark, sf):
    return rounded(tracking.confirmed_boxes(assigned(spark, sf), pass_boxes(spark, sf)))


@query(TRACKS + "SELECT * FROM al")
def first_alerts(spark, sf):
    return alerts(spark, sf)


@query(TRACKS + """SELECT clip, frame_idx, n AS frames, (SELECT count(*) FROM al WHERE al.clip = fr.clip AND al.frame_idx <= fr.frame_idx) AS alerts FROM fr WHERE n % 50 = 0""")
def heartbeats(spark, sf):
    return tracking.heartbeats(pass_frames(spark, sf), alerts(spark, sf), 50)


@query(TRACKS + """SELECT clip, count(*) AS frames, round(avg(latency_ms), 2) AS mean_latency_ms, round(count(*) * 1000.0 / sum(latency_ms), 2) AS throughput_fps, sum(boxes)::BIGINT AS raw_detections,
  (SELECT count(*) FROM al WHERE al.clip = fr.clip) AS confirmed_alerts FROM fr GROUP BY clip""")
def stream_run_summary(spark, sf):
    return rounded(tracking.run_summary(pass_frames(spark, sf), pass_boxes(spark, sf), alerts(spark, sf), "latency_ms"))


@query(TRACKS + """, c AS (SELECT clip, frame_idx, count(*) AS ok FROM asg WHERE confirmed GROUP BY 1, 2), p AS (SELECT len(bs) AS raw, coalesce(ok, 0) AS ok FROM fr LEFT JOIN c USING (clip, frame_idx))
SELECT count(*) AS frames, sum(raw)::BIGINT AS raw_detections, sum(ok)::BIGINT AS confirmed_detections, round(1 - sum(ok) / sum(raw)::DOUBLE, 3) AS detection_reduction,
  round(avg((raw > 0)::INTEGER), 3) AS raw_fp_frame_rate, round(avg((ok > 0)::INTEGER), 3) AS confirmed_fp_frame_rate FROM p""")
def temporal_reduction(spark, sf):
    frames = pass_frames(spark, sf).select("clip", "frame_idx")
    raw = pass_boxes(spark, sf).where(F.col("score") >= 0.25).groupBy("clip", "frame_idx").agg(F.count(F.lit(1)).alias("raw"))
    ok = assigned(spark, sf).where("confirmed").groupBy("clip", "frame_idx").agg(F.count(F.lit(1)).alias("confirmed"))
    on = ["clip", "frame_idx"]
    return detections.temporal_reduction(frames.join(raw, on, "left").join(ok, on, "left").fillna(0))


@query(TRACKS + """, mo AS (SELECT l_suppkey AS clip, l_orderkey AS frame_idx, (epoch_us(l_shipdate) // 86400000000)::BIGINT AS day, ((l_linenumber * 1000003 + l_partkey) * 10007 + l_suppkey) * 101 + l_quantity::BIGINT AS box_id,
  CASE WHEN l_tax > 0 THEN (l_quantity - 25.0) * 20.0 END AS dx FROM lineitem),
od AS (SELECT clip, frame_idx, sum(coalesce(abs(dx), 0) * 1.36 / 1000) OVER (PARTITION BY clip ORDER BY day, frame_idx, box_id ROWS UNBOUNDED PRECEDING) AS m FROM mo)
SELECT al.*, round(along, 3) AS along_m FROM al LEFT JOIN (SELECT clip, frame_idx, max(m) AS along FROM od GROUP BY 1, 2) USING (clip, frame_idx)""")
def alert_positions(spark, sf):
    travelled = spatial.odometer(motion(spark, sf), TRACK_ORDER).groupBy("clip", F.col("image").alias("frame_idx")).agg(
        F.max("travelled_m").alias("travelled_m"))
    return tracking.alert_positions(alerts(spark, sf), travelled)


@query("""WITH f AS (SELECT l_suppkey AS clip, l_orderkey AS frame_idx, max(l_discount) AS s FROM lineitem GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) - 1 AS n FROM f),
h AS (SELECT *, max(CASE WHEN n % 5 = 0 THEN n END) OVER (PARTITION BY clip ORDER BY n ROWS UNBOUNDED PRECEDING) AS at FROM n)
SELECT h.clip, h.frame_idx, round(c.s, 6) AS ood_score, c.s >= 0.08 AS ood FROM h JOIN n c ON c.clip = h.clip AND c.n = h.at""")
def ood_every_nth(spark, sf):
    frames = pass_frames(spark, sf)
    return rounded(tracking.ood_every_nth(frames, "ood_raw", 0.08, 5).select("clip", "frame_idx", "ood_score", "ood"))


@query("""SELECT user_id, hour, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type, count(*) - 1 AS dropped
  FROM (SELECT *, epoch_us(ts) // 3600000000 AS hour FROM events) GROUP BY 1, 2""")
def latest_per_trigger(spark, sf):
    rows = events(spark, sf).withColumn("hour", F.floor(F.col("t_us") / F.lit(3_600_000_000)))
    return tracking.latest_per_trigger(rows.select("user_id", "hour", "t_us", "event_id", "event_type"), ["user_id", "hour"], "t_us").drop("t_us")


@query("""SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events)
  WHERE n % 3 = 0 AND n / 3 < 10""")
def sample_every_n(spark, sf):
    """Every third event of a user, ten at most: the sampling operator itself."""
    return ranking.every_nth(events(spark, sf).select("event_id", "user_id"), ["user_id"], ["event_id"], 3, cap=10)


@query("""SELECT event_id, user_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_error FROM events""")
def carry_forward(spark, sf):
    rows = events(spark, sf).select("event_id", "user_id", F.when(F.col("event_type") == "error", F.col("value")).alias("v"))
    return ranking.carry_forward(rows, ["user_id"], ["event_id"], "v", "last_error").drop("v")


@query("""WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT event_id, user_id, CASE WHEN r <= floor(n * 0.6::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.6::DOUBLE) + 5 THEN 'discarded' ELSE 'held_out' END AS part FROM n""")
def temporal_split_gap(spark, sf):
    return ranking.temporal_split(events(spark, sf).select("event_id", "user_id"), ["user_id"], ["event_id"], 0.6, 5)


@query("SELECT p_partkey, CASE WHEN row_number() OVER (ORDER BY p_partkey) <= 200 THEN 'val' ELSE 'train' END AS part FROM part")
def sorted_train_val(spark, sf):
    return ranking.sorted_train_val(table(spark, sf, "part").select("p_partkey"), "p_partkey", 200)


@query("""SELECT user_id, arg_min(event_id, ts) AS first_event, arg_max(event_id, ts) AS last_event, min(epoch_us(ts)) AS t_first, max(epoch_us(ts)) AS t_last
  FROM events GROUP BY 1""")
def first_last_sample(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(
        F.min_by("event_id", "t_us").alias("first_event"), F.max_by("event_id", "t_us").alias("last_event"),
        F.min("t_us").alias("t_first"), F.max("t_us").alias("t_last"))


@query("""SELECT user_id, event_id, event_type FROM events WHERE event_type = 'error'
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 10""")
def recent_events(spark, sf):
    """The ten newest errors of every user (a top-k report)."""
    rows = events(spark, sf).where(F.col("event_type") == "error")
    return ranking.top_per_group(rows, ["user_id"], [F.col("t_us").desc(), F.col("event_id").desc()], 10).select("user_id", "event_id", "event_type")
