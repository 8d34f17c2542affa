"""Live session counters, newest-frame semantics, streaming time alignment, request metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.tracking import latest_per_trigger


def session_status(frames: DataFrame) -> DataFrame:
    """Running counters per session, for complete or update mode.

    ``frames``: ``session, ts, inferred BOOLEAN, latency_ms, confirmed``. Captured frames that
    were not inferred were dropped.
    """
    newest = F.max_by(F.struct("latency_ms", "confirmed"), F.when(F.col("inferred"), F.col("ts")))
    span = F.max("ts").cast("double") - F.min("ts").cast("double")
    return frames.groupBy("session").agg(
        F.count(F.lit(1)).alias("captured"), F.count_if("inferred").alias("inferred"), F.count_if(~F.col("inferred")).alias("dropped"),
        F.round(F.try_divide(F.count_if("inferred"), span), 2).alias("inference_fps"),
        F.round(F.try_divide(F.count(F.lit(1)), span), 2).alias("capture_fps"), newest.alias("_n"),
    ).select("session", "captured", "inferred", "dropped", "inference_fps", "capture_fps",
             F.round("_n.latency_ms", 1).alias("latency_ms"), F.col("_n.confirmed").alias("confirmed_now"))


def newest_frames(frames: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Per trigger and session only the newest frame goes on, with the number it superseded."""

    def keep(batch: DataFrame, epoch: int) -> None:
        latest_per_trigger(batch, ["session"], "ts").withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return frames.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def align_streams(
    frames: DataFrame, samples: DataFrame, tolerance: str = "500 milliseconds", delay: str = "10 seconds"
) -> DataFrame:
    """Nearest sample of the same clip within the tolerance, both sides streaming, append mode.

    ``frames``: ``clip, frame, ts``. ``samples``: ``clip, ts, value``. A first stateful step
    joins on the interval, a second keeps the nearest per frame (the earlier one at equal
    distance) once the watermark has passed it. Unmatched frames come out with NULLs.
    """
    left = frames.select("clip", "frame", F.col("ts").alias("frame_ts")).withWatermark("frame_ts", delay)
    right = samples.select(F.col("clip").alias("s_clip"), F.col("ts").alias("sample_ts"), "value").withWatermark("sample_ts", delay)
    near = F.expr(
        f"clip = s_clip AND sample_ts >= frame_ts - INTERVAL {tolerance} AND sample_ts <= frame_ts + INTERVAL {tolerance}")
    gap = F.abs(F.col("sample_ts").cast("double") - F.col("frame_ts").cast("double"))
    best = F.min_by(F.struct("sample_ts", "value"), F.when(F.col("sample_ts").isNotNull(), F.struct(gap, F.col("sample_ts"))))
    return left.join(right, near, "leftOuter").groupBy("clip", "frame", "frame_ts").agg(best.alias("_b")).select("clip", "frame", "frame_ts", "_b.*")


def request_rates(requests: DataFrame, window: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Requests, errors and mean latency per path and event-time window."""
    return requests.withWatermark("ts", delay).groupBy(F.window("ts", window), "path").agg(
        F.count(F.lit(1)).alias("requests"), F.sum(F.col("error").cast("bigint")).alias("errors"), F.round(F.avg("latency_ms"), 2).alias("latency_ms_avg"))
