"""Time alignment on events: clicks are frames, the other types are streams, users are clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import wilson
from ..operators import timealign
from .bindings import events
from .registry import query

SIX_HOURS = 6 * 3600 * 1_000_000

ASOF = """
WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t_us FROM events),
c AS (SELECT event_id, user_id, value, t_us FROM e WHERE event_type = 'click'),
{parts}
"""

ASOF_PART = """
{s} AS (SELECT * FROM e WHERE event_type = '{s}'),
{s}_b AS (SELECT c.event_id AS cid, r.event_id, r.value, r.t_us FROM c ASOF LEFT JOIN {s} r
          ON c.user_id = r.user_id AND c.t_us >= r.t_us),
{s}_f AS (SELECT c.event_id AS cid, r.event_id, r.value, r.t_us FROM c ASOF LEFT JOIN {s} r
          ON c.user_id = r.user_id AND c.t_us <= r.t_us),
{s}_n AS (
  SELECT c.event_id AS cid,
    CASE WHEN b.t_us IS NOT NULL AND (f.t_us IS NULL OR c.t_us - b.t_us <= f.t_us - c.t_us)
         THEN b.event_id ELSE f.event_id END AS event_id,
    CASE WHEN b.t_us IS NOT NULL AND (f.t_us IS NULL OR c.t_us - b.t_us <= f.t_us - c.t_us)
         THEN b.value ELSE f.value END AS value,
    CASE WHEN b.t_us IS NOT NULL AND (f.t_us IS NULL OR c.t_us - b.t_us <= f.t_us - c.t_us)
         THEN b.t_us ELSE f.t_us END AS t_us
  FROM c JOIN {s}_b b ON b.cid = c.event_id JOIN {s}_f f ON f.cid = c.event_id),
{s}_m AS (
  SELECT n.cid, n.event_id, n.value, n.t_us FROM {s}_n n JOIN c ON c.event_id = n.cid
  WHERE abs(n.t_us - c.t_us) <= 21600000000)
"""


def _asof_sql(select: str) -> str:
    parts = ",".join(ASOF_PART.format(s=s) for s in ("purchase", "view"))
    joined = f""",
j AS (SELECT c.event_id, c.user_id, c.value, c.t_us,
        p.event_id AS purchase_event_id, p.value AS purchase_value, p.t_us AS purchase_t_us,
        v.event_id AS view_event_id, v.value AS view_value, v.t_us AS view_t_us
      FROM c LEFT JOIN purchase_m p ON p.cid = c.event_id LEFT JOIN view_m v ON v.cid = c.event_id)
{select}"""
    return ASOF.format(parts=parts) + joined


def _joined(spark, sf):
    e = events(spark, sf)
    shape = ["event_id", "user_id", "value", "t_us"]
    streams = {s: e.where(F.col("event_type") == s).select(*shape) for s in ("purchase", "view")}
    return timealign.asof_nearest(
        e.where(F.col("event_type") == "click").select(*shape), streams,
        by=["user_id"], time="t_us", tolerance=SIX_HOURS, tiebreak="event_id",
    )


@query(_asof_sql("SELECT * FROM j"))
def asof_nearest_streams(spark, sf):
    return _joined(spark, sf)


@query(_asof_sql("""
SELECT count(*) AS frames, count(t_us) AS timestamped, round(count(t_us) * 100.0 / count(*), 2) AS timestamped_pct,
  count(purchase_value) AS matched, round(count(purchase_value) * 100.0 / count(*), 2) AS matched_pct FROM j"""))
def asof_coverage(spark, sf):
    return timealign.join_coverage(_joined(spark, sf), "purchase_value", time="t_us")


@query(_asof_sql("""
, s AS (SELECT CASE WHEN purchase_value IS NULL THEN 'unknown' WHEN purchase_value >= 50 THEN 'high' ELSE 'low' END AS state,
          CASE WHEN value >= 50 THEN 1 ELSE 0 END AS failed FROM j),
g AS (SELECT state, count(*) AS n, sum(failed)::BIGINT AS k FROM s GROUP BY state)
SELECT state, n, k, round(k / n, 6) AS rate,
  round(greatest(0, (k/n + 3.8416/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4.0*n*n))) / (1 + 3.8416/n)), 6) AS ci_lo,
  round(least(1, (k/n + 3.8416/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 3.8416/(4.0*n*n))) / (1 + 3.8416/n)), 6) AS ci_hi
FROM g"""))
def click_failure_by_state(spark, sf):
    """Share of high-value clicks by the state of the nearest purchase, with its interval."""
    j = _joined(spark, sf)
    state = (
        F.when(F.col("purchase_value").isNull(), "unknown")
        .when(F.col("purchase_value") >= 50, "high").otherwise("low")
    )
    g = j.groupBy(state.alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= 50).alias("k")
    )
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select(
        "state", "n", "k", F.round(F.col("k") / F.col("n"), 6).alias("rate"),
        F.round(lo, 6).alias("ci_lo"), F.round(hi, 6).alias("ci_hi"),
    )
