"""The reporting layer: artifacts as views, canned reports by name, free SQL."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.boxes import register_sql_functions
from ..sources import artifacts


def build_views(spark: SparkSession, paths: Mapping[str, str], claims: DataFrame | None = None) -> dict[str, str]:
    """Register every artifact that exists as a temporary view and say what was registered.

    ``paths`` may name ``frames``, ``inspections``, ``telemetry`` and ``sites``. Missing ones
    are left out. Files are read in place, nothing is copied; calling again replaces views.
    """
    readers = {
        "frames": artifacts.read_frames, "inspections": artifacts.read_inspections, "sites": artifacts.read_sites,
    }
    views: dict[str, str] = {}
    for name, reader in readers.items():
        path = paths.get(name)
        if path is not None and artifacts.exists(spark, path):
            reader(spark, path).createOrReplaceTempView(name)
            views[name] = path
    lake = paths.get("telemetry")
    if lake is not None and artifacts.exists(spark, lake):
        for stream in artifacts.telemetry_streams(spark, lake):
            artifacts.read_stream(spark, lake, stream).createOrReplaceTempView(f"telemetry_{stream}")
            views[f"telemetry_{stream}"] = lake
    if claims is not None:
        claims.createOrReplaceTempView("evidence")
        views["evidence"] = "claims"
    register_sql_functions(spark)
    return views


def sql(spark: SparkSession, text: str, limit: int | None = None, args: Mapping | None = None) -> DataFrame:
    """Free SQL over the views, with named parameters and a row limit for display."""
    out = spark.sql(text, args=dict(args)) if args else spark.sql(text)
    return out if limit is None else out.limit(limit)


def pass_quality(spark: SparkSession) -> DataFrame:
    """Passes from least to most verified coverage."""
    return spark.table("inspections").select(
        "clip", "frames", F.round(F.col("coverage") * 100, 1).alias("coverage_pct"),
        F.round(F.col("quality_share_in_band") * 100, 1).alias("quality_pct"),
        "frames_with_detection", "confirmed_events", "verdict", "coverage",
    ).orderBy("coverage", "quality_pct", "clip").drop("coverage")


def detections_by_standoff(spark: SparkSession, model: str = "det_v1") -> DataFrame:
    """False alarms per 0.2 m standoff band."""
    fp = F.col(f"fp_{model}")
    return (
        spark.table("frames").where(F.col("standoff").isNotNull())
        .groupBy((F.round(F.col("standoff") * 5) / 5).alias("standoff_band_m"))
        .agg(F.count(F.lit(1)).alias("frames"), F.sum(fp).alias("false_alarms"),
             F.round(F.avg(fp) * 100, 1).alias("false_alarm_pct"))
        .orderBy("standoff_band_m")
    )


def clip_vs_day(spark: SparkSession, model: str = "det_v1") -> DataFrame:
    """Spread between clips next to the day effect."""
    return (
        spark.table("frames").groupBy("day", "clip")
        .agg(F.count(F.lit(1)).alias("frames"),
             F.round(F.avg(F.col(f"fp_{model}")) * 100, 1).alias(f"{model}_fa_pct"),
             F.round(F.avg("sharpness"), 1).alias("sharpness"))
        .orderBy("day", F.col(f"{model}_fa_pct").desc(), "clip")
    )


def unvalidated(spark: SparkSession) -> DataFrame:
    """Claims nobody may make."""
    return spark.table("evidence").where(F.col("level") == "not_validated").select("topic", "statement", "caveat")


def water(spark: SparkSession) -> DataFrame:
    """Water temperature, depth, standoff and speed per pass."""
    return spark.table("inspections").select(
        "clip", "frames", "water_temperature_c", "depth_m_mean", "standoff_m_mean", "net_speed_ms_mean"
    ).orderBy("clip")


REPORTS: dict[str, Callable[[SparkSession], DataFrame]] = {
    f.__name__: f for f in (pass_quality, detections_by_standoff, clip_vs_day, unvalidated, water)
}


def run_report(spark: SparkSession, name: str) -> DataFrame:
    """One canned report by name; an unknown name is an error that lists the choices."""
    if name not in REPORTS:
        raise KeyError(f"unknown report {name!r}, choose from {sorted(REPORTS)}")
    return REPORTS[name](spark)


def passes(spark: SparkSession) -> DataFrame:
    """The inspected passes with their capture conditions."""
    return spark.table("inspections").select(
        "clip", "day", "frames", "standoff_m_mean", "net_speed_ms_mean", "depth_m_mean", "water_temperature_c",
        "sharpness_mean",
    )


def claims(spark: SparkSession, topic: str | None = None, level: str | None = None) -> DataFrame:
    """Evidence ledger, optionally one topic or one level."""
    out = spark.table("evidence")
    if topic is not None:
        out = out.where(F.col("topic") == topic)
    return out if level is None else out.where(F.col("level") == level)
