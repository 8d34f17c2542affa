"""Landed JSON documents: frame indexes, predictions, forecasts, the licence register, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_SCHEMA = "clip STRING, topic STRING, msgtype STRING, count INT, t_start DOUBLE, t_end DOUBLE, times ARRAY<DOUBLE>"
BOX = "STRUCT<bbox: ARRAY<DOUBLE>, score: DOUBLE, class_id: INT, class_name: STRING>"
# Field names of the public forecast and register documents.
FORECAST_FIELDS = {
    "sea_water_temperature_c": "sea_water_temperature", "sea_water_speed_ms": "sea_water_speed",
    "sea_surface_wave_height_m": "sea_surface_wave_height", "sea_water_to_direction_deg": "sea_water_to_direction",
    "sea_surface_wave_from_direction_deg": "sea_surface_wave_from_direction",
}
REGISTER_TEXT = {
    "name": "navn", "status": "status_lokalitet", "county": "fylke", "municipality": "kommune", "capacity_unit": "kapasitet_unittype",
    "placement": "plassering", "species": "til_arter", "operators": "til_innehavere", "permits": "til_tillatelser",
    "production_form": "til_produksjonsform",
}


def read_frame_index(spark: SparkSession, pattern: str, topic: str | None = None) -> DataFrame:
    """One index document per clip: that of the wanted topic, else the first by file name."""
    docs = spark.read.schema(INDEX_SCHEMA).json(pattern, multiLine=True).withColumn("_file", F.col("_metadata.file_path"))
    preferred = F.lit(1) if topic is None else F.when(F.col("topic") == topic, 0).otherwise(1)
    pick = F.min_by(F.struct("topic", "msgtype", "count", "t_start", "t_end", "times"), F.struct(preferred, "_file"))
    return docs.groupBy("clip").agg(pick.alias("_d")).select("clip", "_d.*")


def read_predictions(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """``(images, boxes)`` of prediction documents; a bare ``{image: [...]}`` map is read too.

    Images with an empty list are in ``images`` only.
    """
    docs = spark.read.text(pattern, wholetext=True)
    kind = f"MAP<STRING, ARRAY<{BOX}>>"
    wrapped = F.get_json_object("value", "$.images")
    per_image = docs.select(F.explode(F.from_json(F.coalesce(wrapped, F.col("value")), kind)).alias("image", "_boxes"))
    boxes = per_image.select("image", F.posexplode("_boxes").alias("box_id", "b")).select(
        "image", "box_id", *[F.col("b.bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))],
        F.coalesce("b.class_id", F.lit(0)).alias("class_id"), F.coalesce("b.class_name", F.lit("damage")).alias("class_name"),
        F.coalesce("b.score", F.lit(1.0)).alias("score"))
    return per_image.select("image").distinct(), boxes


def write_predictions(images: DataFrame, boxes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines ``{"image": …, "boxes": […]}``, one per image, empty ones included."""
    entry = F.struct(
        F.array(*[F.round(c, 2) for c in ("x1", "y1", "x2", "y2")]).alias("bbox"), F.round("score", 4).alias("score"), "class_id", "class_name")
    per = boxes.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("box_id", entry.alias("e")))), lambda s: s["e"]).alias("boxes"))
    out = images.select("image").distinct().join(per, "image", "left")
    out.withColumn("boxes", F.coalesce("boxes", F.array().cast(dict(per.dtypes)["boxes"]))).write.mode(mode).json(path)


def read_prediction_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_predictions` wrote, as ``(images, boxes)``."""
    rows = spark.read.schema(f"image STRING, boxes ARRAY<{BOX}>").json(path)
    boxes = rows.select("image", F.posexplode("boxes").alias("box_id", "b")).select(
        "image", "box_id", *[F.col("b.bbox")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], "b.class_id", "b.class_name", "b.score")
    return rows.select("image"), boxes


def read_forecast(spark: SparkSession, pattern: str) -> DataFrame:
    """Hourly rows of landed forecast documents; ``source`` is the file, steps without values stay."""
    details = ", ".join(f"{f}: DOUBLE" for f in FORECAST_FIELDS.values())
    schema = f"properties STRUCT<timeseries: ARRAY<STRUCT<time: STRING, data: STRUCT<instant: STRUCT<details: STRUCT<{details}>>>>>>"
    docs = spark.read.schema(schema).json(pattern, multiLine=True).withColumn("source", F.col("_metadata.file_name"))
    steps = docs.select("source", F.explode("properties.timeseries").alias("s"))
    return steps.select(
        "source", F.to_timestamp("s.time").alias("time"), *[F.col(f"s.data.instant.details.{f}").alias(c) for c, f in FORECAST_FIELDS.items()])


def read_register(spark: SparkSession, pattern: str) -> DataFrame:
    """Site rows of landed register documents; an error payload fails the read when it runs."""
    text = ", ".join(f"{f}: STRING" for f in (*REGISTER_TEXT.values(), "lokalitet_url_ekstern", "lokalitet_url"))
    schema = f"error STRING, features ARRAY<STRUCT<attributes: STRUCT<loknr: INT, lat: DOUBLE, lon: DOUBLE, kapasitet_lok: DOUBLE, {text}>>>"
    docs = spark.read.schema(schema).json(pattern, multiLine=True)
    failed = F.raise_error(F.concat(F.lit("register error: "), "error"))
    sane = docs.withColumn("features", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("features")))
    a = sane.select(F.explode("features").alias("f")).select("f.attributes.*")
    clean = lambda c: F.coalesce(F.trim(c), F.lit(""))
    return a.select(
        F.coalesce("loknr", F.lit(0)).alias("loknr"), "lat", "lon", F.coalesce("kapasitet_lok", F.lit(0.0)).alias("capacity"),
        *[clean(f).alias(c) for c, f in REGISTER_TEXT.items()],
        F.coalesce(F.nullif(F.trim("lokalitet_url_ekstern"), F.lit("")), F.trim("lokalitet_url"), F.lit("")).alias("url"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Alert and heartbeat rows as JSON lines."""
    events.write.mode(mode).json(path)
