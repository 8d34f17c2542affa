"""The canned reports over views derived from suppliers and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from ..sources import artifacts
from .bindings import frames
from .registry import query, table

INSPECTIONS = """
WITH insp AS (SELECT l_suppkey AS clip, strftime(min(l_shipdate), '%Y-%m-%d') AS day, count(*) AS frames,
  avg(CASE WHEN l_tax > 0.01 THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN l_quantity <= 25 THEN 1.0 ELSE 0.0 END) AS quality,
  count_if(l_returnflag = 'R')::BIGINT AS frames_with_detection, count_if(l_returnflag = 'R' AND l_linestatus = 'O')::BIGINT AS confirmed_events,
  avg(l_discount) AS temp, avg(l_quantity) AS depth, avg(l_extendedprice) AS standoff, avg(l_tax) AS speed FROM lineitem GROUP BY 1)
"""


def register(spark, sf):
    """Derived ``inspections``, ``frames`` and ``evidence`` views."""
    items = table(spark, sf, "lineitem")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    items.groupBy(F.col("l_suppkey").alias("clip")).agg(
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("day"), F.count(F.lit(1)).alias("frames"),
        share(F.col("l_tax") > 0.01).alias("coverage"), share(F.col("l_quantity") <= 25).alias("quality_share_in_band"),
        F.count_if(F.col("l_returnflag") == "R").alias("frames_with_detection"),
        F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")).alias("confirmed_events"),
        F.round(F.avg("l_discount"), 6).alias("water_temperature_c"), F.round(F.avg("l_quantity"), 6).alias("depth_m_mean"),
        F.round(F.avg("l_extendedprice"), 4).alias("standoff_m_mean"), F.round(F.avg("l_tax"), 6).alias("net_speed_ms_mean"),
        F.lit(None).cast("double").alias("sharpness_mean"),
    ).withColumn("verdict", F.when(F.col("coverage") >= 0.78, "accept").otherwise("re-fly")).createOrReplaceTempView("inspections")
    frames(spark, sf).select(
        "clip", F.col("year").alias("day"), "standoff", "sharpness", F.col("event").alias("fp_det_v1")
    ).createOrReplaceTempView("frames")
    claims = table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        F.col("s_name").alias("topic"), F.concat(F.lit("balance in "), "n_name").alias("statement"),
        F.when(F.col("s_acctbal") < 0, "not_validated").when(F.col("s_acctbal") < 5000, "inferred_from_measurements")
        .otherwise("measured_on_real_data").alias("level"),
        F.lit(None).cast("string").alias("artifact"), F.format_string("region %d", "n_regionkey").alias("caveat"),
    )
    claims.createOrReplaceTempView("evidence")


@query(INSPECTIONS + """SELECT clip, frames, round(coverage * 100, 1) AS coverage_pct, round(quality * 100, 1) AS quality_pct,
  frames_with_detection, confirmed_events, CASE WHEN coverage >= 0.78 THEN 'accept' ELSE 're-fly' END AS verdict FROM insp""")
def report_quality(spark, sf):
    register(spark, sf)
    return reports.run_report(spark, "pass_quality")


@query("""SELECT round(l_quantity / 50.0 * 5) / 5 AS standoff_band_m, count(*) AS frames,
  sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT AS false_alarms,
  round(avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 100, 1) AS false_alarm_pct FROM lineitem GROUP BY 1""")
def report_bands(spark, sf):
    register(spark, sf)
    return reports.run_report(spark, "detections_by_standoff")


@query("""SELECT strftime(l_shipdate, '%Y') AS day, l_suppkey AS clip, count(*) AS frames,
  round(avg(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 100, 1) AS det_v1_fa_pct, round(avg(l_extendedprice), 1) AS sharpness
  FROM lineitem GROUP BY 1, 2""")
def report_cluster_day(spark, sf):
    register(spark, sf)
    return reports.run_report(spark, "clip_vs_day")


@query("""SELECT s_name AS topic, 'balance in ' || n_name AS statement, 'region ' || n_regionkey AS caveat
  FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0""")
def report_claims(spark, sf):
    register(spark, sf)
    return reports.run_report(spark, "unvalidated")


@query(INSPECTIONS + """SELECT clip, frames, round(temp, 6) AS water_temperature_c, round(depth, 6) AS depth_m_mean,
  round(standoff, 4) AS standoff_m_mean, round(speed, 6) AS net_speed_ms_mean FROM insp""")
def report_environment(spark, sf):
    register(spark, sf)
    return reports.run_report(spark, "water")


@query(INSPECTIONS + """SELECT i.clip, s_name AS site, s_acctbal AS capacity, n_name AS county, i.frames,
  count(*) AS bad_frames, round(avg(l_quantity / 50.0), 6) AS standoff
  FROM insp i JOIN supplier ON s_suppkey = i.clip JOIN nation ON n_nationkey = s_nationkey
  JOIN lineitem ON l_suppkey = i.clip AND l_returnflag = 'R'
  WHERE i.coverage < 0.78 GROUP BY ALL""")
def cross_report_join(spark, sf):
    """Passes ⋈ frames ⋈ sites through free SQL with a named parameter."""
    register(spark, sf)
    table(spark, sf, "supplier").createOrReplaceTempView("sites")
    table(spark, sf, "nation").createOrReplaceTempView("counties")
    return reports.sql(spark, """
        SELECT i.clip, s_name AS site, s_acctbal AS capacity, n_name AS county, i.frames,
               count(*) AS bad_frames, round(avg(f.standoff), 6) AS standoff
        FROM inspections i JOIN sites ON s_suppkey = i.clip JOIN counties ON n_nationkey = s_nationkey
        JOIN frames f ON f.clip = i.clip AND f.fp_det_v1 = 1
        WHERE i.coverage < :bound GROUP BY ALL ORDER BY capacity DESC, clip""", args={"bound": 0.78})


@query("""SELECT CASE WHEN s_acctbal < 0 THEN 'not_validated' WHEN s_acctbal < 5000 THEN 'inferred_from_measurements'
  ELSE 'measured_on_real_data' END AS level, count(*) AS claims FROM supplier GROUP BY 1""")
def evidence_levels(spark, sf):
    register(spark, sf)
    return reports.claims(spark).groupBy("level").agg(F.count(F.lit(1)).alias("claims"))
