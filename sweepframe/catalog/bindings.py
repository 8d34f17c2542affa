"""The roles the driver tables play: streams, clips, frames, boxes, tracks, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import micros
from .registry import table


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their time in microseconds and the number inside ``props``."""
    return table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", "value", "props", micros("ts").alias("t_us"), "ts",
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as frames: supplier = clip, quantity = standoff, discount = speed, tax = lock."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("clip"),
        F.date_format("l_shipdate", "yyyy").alias("year"),
        (F.col("l_quantity") / 50.0).alias("standoff"),
        (F.col("l_discount") * 4.0).alias("net_speed"),
        (F.col("l_tax") > 0.01).alias("locked"),
        F.col("l_extendedprice").alias("sharpness"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == "R").cast("int").alias("event"),
        F.col("l_linestatus").alias("linestatus"), F.col("l_partkey").alias("partkey"),
        "l_shipdate", "l_orderkey", "l_linenumber",
    )


def _corners() -> list[Column]:
    x1, y1 = (F.col("l_partkey") % 4) * 8.0, (F.col("l_suppkey") % 4) * 8.0
    x2, y2 = x1 + 20.0 + F.col("l_quantity") % 16, y1 + 20.0 + F.col("l_partkey") % 16
    return [x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")]


def box_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as boxes on order images; lines 1-2 are ground truth, the others predictions."""
    number = (
        (F.col("l_linenumber") * 1000003 + F.col("l_partkey")) * 10007 + F.col("l_suppkey")
    ) * 101 + F.col("l_quantity").cast("bigint")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("image"), number.alias("box_id"), *_corners(),
        F.col("l_linestatus").alias("class_name"), (F.col("l_discount") * 10.0).alias("score"),
        F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("clip"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity") - 20.0).alias("contrast"),
    )


def gt_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return box_rows(spark, sf).where(F.col("line") <= 2)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return box_rows(spark, sf).where(F.col("line") > 2)


def images(spark: SparkSession, sf: str) -> DataFrame:
    """Every order is an image; those without a ground-truth box are clean."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_orderpriority").alias("set"))


def motion(spark: SparkSession, sf: str, boxes: bool = False) -> DataFrame:
    """Line items of a supplier in shipping order as frame motions; untaxed lines are unmatched. ``boxes`` adds the box of each."""
    taxed = F.col("l_tax") > 0
    number = (
        (F.col("l_linenumber") * 1000003 + F.col("l_partkey")) * 10007 + F.col("l_suppkey")
    ) * 101 + F.col("l_quantity").cast("bigint")
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("clip"), (micros("l_shipdate") / F.lit(86_400_000_000)).cast("bigint").alias("day"),
        F.col("l_orderkey").alias("image"), number.alias("box_id"),
        F.when(taxed, (F.col("l_quantity") - 25.0) * 20.0).alias("dx_px"),
        F.when(taxed, (F.round(F.col("l_discount") * 100.0) - 5.0) * 64.0).alias("dy_px"),
        (0.5 + F.round(F.col("l_discount") * 100.0) / 8.7).alias("standoff"),
        (F.col("l_quantity") / 5.0).alias("depth_m"),
        (F.col("l_extendedprice") / 1013.0).alias("travel_m"),
        *([*_corners(), (F.col("l_discount") * 10.0).alias("score")] if boxes else []),
    )


TRACK_ORDER = ["day", "image", "box_id"]


def pens(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as pens; every fiftieth has an impossible circumference."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("pen_id"), F.when(k % 50 == 49, 0.0).otherwise(100.37 + k % 80).alias("circumference_m"),
        (10.0 + k % 10).alias("cylinder_depth_m"), (0.0 + k % 7).alias("cone_depth_m"),
        (0.0 + k * 37 % 360).alias("barge_bearing_deg"), (0.0 + k * 11 % 360).alias("start_bearing_deg"),
        (k % 2 == 0).alias("clockwise"),
    )


def pass_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of one supplier's pass; the order number is the frame number."""
    return box_rows(spark, sf).withColumnRenamed("image", "frame_idx").select(
        "clip", "frame_idx", "box_id", "x1", "y1", "x2", "y2", "score"
    )


def pass_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of every pass, with a latency; frames whose boxes are all weak stay in."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("clip"), F.col("l_orderkey").alias("frame_idx")).agg(
        F.max("l_quantity").alias("latency_ms"), F.max("l_discount").alias("ood_raw")
    )


def grids(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 8 x 8 luma grids in 0..255, with their raw vector and label."""
    light = F.transform("embedding", lambda v: (v.cast("double") + 0.5) * 255.0)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("frame"), light.alias("grid"), "embedding", "label"
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as annotated images of a customer's clip; a few cannot be sized."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("image"), F.concat(F.lit("clip"), (F.col("o_custkey") % 40).cast("string")).alias("grp"),
        F.when(k % 997 == 0, 0).otherwise(640 + k % 3 * 320).cast("int").alias("width"),
        F.when(k % 997 == 0, 0).otherwise(480 + k % 2 * 240).cast("int").alias("height"),
    )


def sample_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """First lines of an order as boxes in image fractions, some flat, tiny or outside."""
    b = gt_boxes(spark, sf)
    x1, y1 = F.col("x1") / 64.0, F.col("y1") / 64.0
    x2 = F.when(F.col("box_id") % 101 == 0, x1).when(F.col("box_id") % 103 == 0, x1 + 1e-4).otherwise(F.col("x2") / 64.0 + F.when(F.col("box_id") % 107 == 0, 1.0).otherwise(0.0))
    y2 = F.when(F.col("box_id") % 103 == 0, y1 + 1e-4).otherwise(F.col("y2") / 64.0)
    return b.select(
        "image", "box_id", F.when(F.col("class_name") == "O", 0).otherwise(1).alias("cls"),
        x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
    )


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as licensed localities; nations are counties, customers' segments the operators."""
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").join(
        table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    ).select(
        k.alias("loknr"), F.col("s_name").alias("name"), F.when(k % 5 == 0, "SLETTET").otherwise("AKTIV").alias("status"),
        F.when(k % 7 != 0, k % 60 + 10.0).alias("lat"), F.when(k % 7 != 0, k % 30 + 0.5).alias("lon"),
        F.col("n_name").alias("county"), F.col("s_acctbal").alias("capacity"),
        F.when(k % 3 == 0, "STK").otherwise("TN").alias("capacity_unit"), F.when(k % 3 == 0, "LAND").otherwise("SJØ").alias("placement"),
        F.concat(F.lit("Fjord "), (k % 4).cast("string"), F.lit(" AS, Havn "), (k % 6).cast("string"), F.lit(" AS")).alias("operators"),
        F.when(k % 2 == 0, "Matfisk").otherwise("").alias("production_form"),
    )


def forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Events per hour as forecast hours: mean value scaled to waves, count to current."""
    e = events(spark, sf)
    return e.groupBy((F.col("user_id") % 10).alias("loknr"), F.floor(F.col("t_us") / F.lit(3_600_000_000)).alias("time")).agg(
        (F.avg("value") / 60.0 + 0.0123).alias("sea_surface_wave_height_m"),
        (F.count(F.lit(1)) * 0.09).alias("sea_water_speed_ms"), F.round(F.avg("value") / 5.0, 4).alias("sea_water_temperature_c"),
    )


def daily_temperature(spark: SparkSession, sf: str) -> DataFrame:
    """Mean event value per user and day as water temperature of a cohort."""
    e = events(spark, sf)
    return e.groupBy(F.col("user_id").alias("cohort"), F.floor(F.col("t_us") / F.lit(86_400_000_000)).alias("step")).agg(
        (F.avg("value") / 5.0 - 1.0).alias("temperature_c")
    ).withColumn("initial_weight_g", 100.0 + F.col("cohort"))
