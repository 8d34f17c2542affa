"""Artifacts of the reporting layer: frame table, reports, telemetry lake, register, ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIM_SCHEMA = "topic STRING, statement STRING, level STRING, artifact STRING, caveat STRING"

REPORT_SCHEMA = """
clip STRING, day STRING, frames BIGINT, error STRING,
capture STRUCT<standoff_m_mean: DOUBLE, net_speed_ms_mean: DOUBLE, depth_m_mean: DOUBLE,
               water_temperature_c: DOUBLE, sharpness_mean: DOUBLE>,
validity_geometry STRUCT<compliance: DOUBLE, verdict: STRING>,
validity_quality STRUCT<share_in_band: DOUBLE>,
detections STRUCT<model: STRING, frames_with_detection: BIGINT, confirmed_events_min3_frames: BIGINT>,
_corrupt STRING
"""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything, on whatever file system it names."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm_path)
    return files is not None and len(files) > 0


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_frames(frames: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The wide frame table, one folder per clip so that a clip filter prunes files."""
    frames.write.mode(mode).partitionBy("clip").parquet(path)


def read_inspections(spark: SparkSession, path: str) -> DataFrame:
    """Pass reports, one JSON document per file, as one row each.

    Unreadable documents and documents holding ``error`` are left out.
    """
    raw = spark.read.schema(REPORT_SCHEMA).json(
        path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt"
    ).withColumn("source_report", F.col("_metadata.file_path"))
    return raw.where(F.col("_corrupt").isNull() & F.col("error").isNull()).select(
        "clip", "day", "frames",
        F.col("validity_geometry.compliance").alias("coverage"), F.col("validity_geometry.verdict").alias("verdict"),
        F.col("validity_quality.share_in_band").alias("quality_share_in_band"),
        F.col("capture.sharpness_mean"), F.col("capture.standoff_m_mean"), F.col("capture.net_speed_ms_mean"),
        F.col("capture.depth_m_mean"), F.col("capture.water_temperature_c"),
        F.col("detections.model"), F.col("detections.frames_with_detection"),
        F.col("detections.confirmed_events_min3_frames").alias("confirmed_events"), "source_report",
    )


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Reports or verdicts as JSON lines."""
    reports.write.mode(mode).json(path)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of site rows, schema inferred."""
    return spark.read.json(path, multiLine=True)


def evidence(spark: SparkSession, rows: Sequence[tuple], level: str | None = None) -> DataFrame:
    """Claims kept in code as a table, optionally one evidence level."""
    table = spark.createDataFrame(list(rows), CLAIM_SCHEMA)
    return table if level is None else table.where(F.col("level") == level)


# Telemetry lake --------------------------------------------------------------------------


def write_stream(samples: DataFrame, lake: str, mode: str = "append") -> None:
    """Samples of one or many streams into ``stream=…/clip=…`` folders; both columns prune."""
    samples.write.mode(mode).partitionBy("stream", "clip").parquet(lake)


def read_stream(spark: SparkSession, lake: str, stream: str, clip: str | None = None) -> DataFrame:
    """One stream, of one clip or of all; only its folders are listed for reading."""
    rows = spark.read.option("mergeSchema", "true").parquet(f"{lake}/stream={stream}").withColumn(
        "stream", F.lit(stream)
    )
    rows = rows.withColumn("filename", F.col("_metadata.file_name"))
    return rows if clip is None else rows.where(F.col("clip") == clip)


def telemetry_streams(spark: SparkSession, lake: str) -> list[str]:
    """Names of the streams in a lake, from its folder names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{lake}/stream=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().getName().split("=", 1)[1] for status in found or [])


def read_stream_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Single-file exports named ``<clip>__<stream>.parquet``, clip and stream taken from the name."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "")
    return spark.read.option("mergeSchema", "true").parquet(pattern).select(
        "*", F.substring_index(name, "__", 1).alias("clip"),
        F.regexp_extract(name, "^.+?__(.*)$", 1).alias("stream"),
    )
