"""Landed JSON documents held in a column: frame indexes, predictions, COCO labels, forecasts, registers.

Every parser takes a table with a document per row (``doc`` names it, ``text`` is its JSON) and parses it
to VARIANT, so documents of one table may differ in shape and a field that is missing, null or of another
kind is NULL. Arrays and maps are exploded in the plan: what moves is one row per element, and Spark
prunes what nobody asks for. Text that is no JSON, or a document that says ``error``, is never an
exception; :func:`rejected` lists it. Documents too large for a row are read with :mod:`elements`, which
gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import pin
from .annotations import DEFAULT_CLASS, VOC_SCHEMA
from .landed import FORECAST_FIELDS, REGISTER_TEXT

BOX = {"class_id": "int", "class_name": "string", "score": "double"}
COCO = {
    "images": {"id": "bigint", "width": "int", "height": "int", "file_name": "string"},
    "annotations": {"image_id": "bigint", "category_id": "bigint", "bbox": "array<double>", "iscrowd": "int"},
    "categories": {"id": "bigint", "name": "string"},
}


def parsed(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``doc, v``: documents as VARIANT; NULL where the text is no JSON.

    The parsed document comes out of an array of one: filters on it stay above, so a text is parsed once.
    """
    return docs.select(F.col(doc).alias("doc"), F.explode(F.array(F.try_parse_json(F.col(text).cast("string")))).alias("v"))


def field(value: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", kind)


def rejected(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``doc, error`` of the documents no parser takes rows from."""
    said = F.coalesce(field("v", "error", "string"), F.when(field("v", "error", "variant").isNotNull() & ~F.is_variant_null(field("v", "error", "variant")), F.to_json(field("v", "error", "variant"))))
    error = F.when(F.col("v").isNull(), "not a JSON document").otherwise(said)
    return parsed(docs, doc, text).select("doc", error.alias("error")).where("error IS NOT NULL")


def _accepted(docs: DataFrame, doc: str, text: str) -> DataFrame:
    says = field("v", "error", "variant")
    return parsed(docs, doc, text).where(F.col("v").isNotNull() & (says.isNull() | F.is_variant_null(says)))


def items(docs: DataFrame, path: str, doc: str = "doc", text: str = "text") -> DataFrame:
    """``doc, pos, v``: the elements of an array inside each document, in order."""
    return _accepted(docs, doc, text).select("doc", F.posexplode(field("v", path, "array<variant>")).alias("pos", "v"))


def entries(docs: DataFrame, path: str | None = None, doc: str = "doc", text: str = "text") -> DataFrame:
    """``doc, key, v``: the members of an object inside each document, or of the document itself."""
    inside = _accepted(docs, doc, text)
    inside = inside.select("doc", F.coalesce(field("v", path, "variant"), F.col("v")).alias("v")) if path else inside
    object_ = inside.select("doc", F.to_json("v").alias("_j"), "v").where(F.schema_of_variant("v").startswith("OBJECT"))
    return object_.select("doc", F.explode(F.from_json("_j", "map<string, variant>")).alias("key", "v"))


# Frame indexes ---------------------------------------------------------------------------


def frame_indexes(docs: DataFrame, topic: str | None = None, doc: str = "doc", text: str = "text") -> DataFrame:
    """``clip, topic, msgtype, count, t_start, t_end, times``: one index per clip.

    The document of the wanted topic wins, else the one that comes first by name.
    """
    kinds = {"clip": "string", "topic": "string", "msgtype": "string", "count": "int", "t_start": "double", "t_end": "double", "times": "array<double>"}
    rows = _accepted(docs, doc, text).select("doc", *[field("v", c, k).alias(c) for c, k in kinds.items()])
    wanted = F.lit(1) if topic is None else F.when(F.col("topic") == topic, 0).otherwise(1)
    best = F.min_by(F.struct(*[c for c in kinds if c != "clip"]), F.struct(wanted, "doc"))
    return rows.where("clip IS NOT NULL").groupBy("clip").agg(best.alias("_d")).select("clip", "_d.*")


def frame_times(indexes: DataFrame) -> DataFrame:
    """``clip, msg_index, t``: when each message of a clip was taken."""
    return indexes.select("clip", F.posexplode("times").alias("msg_index", "t"))


# Predictions -----------------------------------------------------------------------------


def predicted_images(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``doc, image, boxes``: images of prediction documents, ``boxes`` an array of VARIANT; a bare map is read too."""
    per_image = entries(docs, "images", doc, text).select("doc", F.col("key").alias("image"), F.try_variant_get("v", "$", "array<variant>").alias("boxes"))
    return per_image.where("boxes IS NOT NULL")


def predicted_boxes(images: DataFrame) -> DataFrame:
    """``doc, image, box_id, x1, y1, x2, y2, class_id, class_name, score`` of :func:`predicted_images`; empty lists give no row."""
    rows = images.select("doc", "image", F.posexplode("boxes").alias("box_id", "v")).withColumn("_b", field("v", "bbox", "array<double>"))
    given = {c: field("v", c, k) for c, k in BOX.items()}
    defaults = {"class_id": F.lit(0), "class_name": F.lit("damage"), "score": F.lit(1.0)}
    return rows.select("doc", "image", "box_id", *[F.get("_b", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))], *[F.coalesce(given[c], defaults[c]).alias(c) for c in BOX])


# COCO ------------------------------------------------------------------------------------


def coco_part(docs: DataFrame, part: str, doc: str = "doc", text: str = "text") -> DataFrame:
    """Rows of ``images``, ``annotations`` or ``categories``, as :func:`annotations.read_coco` gives them."""
    return typed_part(items(docs, part, doc, text), part)


def coco_parts(docs: DataFrame, *parts: str, doc: str = "doc", text: str = "text") -> list[DataFrame]:
    """The rows of :func:`coco_part` for each of ``parts``; a document is built and parsed once for all of them."""
    def kind(part: str) -> str:
        return ", ".join(f"{c}: {k}" for c, k in (COCO[part] | ({"segmentation": "variant"} if part == "annotations" else {})).items())

    stored = pin(_accepted(docs, doc, text).select("doc", *[field("v", p, f"array<struct<{kind(p)}>>").alias(p) for p in parts]))
    text_of = {"segmentation": F.to_json("segmentation").alias("segmentation")}
    rows = lambda p: stored.select("doc", F.explode(p).alias("_r")).select("doc", "_r.*")
    return [part.select(*[text_of.get(c, F.col(c)) for c in part.columns]) for part in map(rows, parts)]


def typed_part(rows: DataFrame, part: str) -> DataFrame:
    """The columns of a COCO part from elements ``doc, v``, whichever way they were read."""
    out = rows.select("doc", *[field("v", c, k).alias(c) for c, k in COCO[part].items()], *([F.to_json(field("v", "segmentation", "variant")).alias("segmentation")] if part == "annotations" else []))
    return out


# Forecasts and registers -----------------------------------------------------------------


def forecast_hours(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``source, time`` and the hourly values of forecast documents; steps without values stay."""
    steps = items(docs, "properties.timeseries", doc, text)
    details = {c: field("v", f"data.instant.details.{f}", "double") for c, f in FORECAST_FIELDS.items()}
    return steps.select(F.col("doc").alias("source"), F.try_to_timestamp(field("v", "time", "string")).alias("time"), *[v.alias(c) for c, v in details.items()])


def register_sites(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Site rows of register documents, text trimmed and never null; error payloads are left to :func:`rejected`."""
    rows = items(docs, "features", doc, text)
    at = lambda f, kind: field("v", f"attributes.{f}", kind)
    clean = lambda c: F.coalesce(F.trim(c), F.lit(""))
    url = F.coalesce(F.nullif(F.trim(at("lokalitet_url_ekstern", "string")), F.lit("")), F.trim(at("lokalitet_url", "string")), F.lit(""))
    return rows.select(
        F.coalesce(at("loknr", "int"), F.lit(0)).alias("loknr"), at("lat", "double").alias("lat"), at("lon", "double").alias("lon"), F.coalesce(at("kapasitet_lok", "double"), F.lit(0.0)).alias("capacity"),
        *[clean(at(f, "string")).alias(c) for c, f in REGISTER_TEXT.items()], url.alias("url"))


def as_documents(rows: DataFrame, keys: Sequence[str], fields: Sequence[Column]) -> DataFrame:
    """``doc, text``: one JSON document per row of ``rows``, named by its keys."""
    return rows.select(F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("doc"), F.to_json(F.struct(*fields)).alias("text"))


# Pascal VOC ------------------------------------------------------------------------------


def voc_boxes(docs: DataFrame, doc: str = "doc", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(boxes in image fractions, classes: class_name, cls)`` of XML documents in a column.

    Class numbers follow the first place a class is seen at, by document name and place in it; an
    unnamed object has the default class. Text that is no such document gives no rows.
    """
    rows = docs.select(F.col(doc).alias("doc"), F.from_xml(F.col(text), VOC_SCHEMA, {"mode": "PERMISSIVE"}).alias("a"))
    named = rows.select("doc", "a.filename", "a.size", F.posexplode("a.object").alias("_i", "o")).withColumn(
        "class_name", F.coalesce(F.nullif(F.trim("o.name"), F.lit("")), F.lit(DEFAULT_CLASS)))
    first = named.groupBy("class_name").agg(F.min(F.struct("doc", "_i")).alias("_first"))  # a row per class
    classes = first.select("class_name", (F.row_number().over(Window.orderBy("_first")) - 1).alias("cls"))
    w, h = F.col("size.width").cast("double"), F.col("size.height").cast("double")
    at = lambda c: F.coalesce(F.col(f"o.bndbox.{c}"), F.lit(0.0))
    boxes = named.where(F.col("o.bndbox").isNotNull()).join(classes, "class_name").select(
        F.col("filename").alias("image"), "cls", "class_name", F.try_divide(at("xmin"), w).alias("x1"), F.try_divide(at("ymin"), h).alias("y1"),
        F.try_divide(at("xmax"), w).alias("x2"), F.try_divide(at("ymax"), h).alias("y2"))
    return boxes, classes
