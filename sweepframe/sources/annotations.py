"""Annotation formats: YOLO label text, COCO documents, Pascal VOC documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parsing import group_of, stem

COCO_SCHEMA = """
images ARRAY<STRUCT<id: BIGINT, width: INT, height: INT, file_name: STRING>>,
annotations ARRAY<STRUCT<image_id: BIGINT, category_id: BIGINT, bbox: ARRAY<DOUBLE>, iscrowd: INT, segmentation: STRING>>,
categories ARRAY<STRUCT<id: BIGINT, name: STRING>>
"""
VOC_SCHEMA = """
filename STRING, size STRUCT<width: INT, height: INT>,
object ARRAY<STRUCT<name: STRING, bndbox: STRUCT<xmin: DOUBLE, ymin: DOUBLE, xmax: DOUBLE, ymax: DOUBLE>>>
"""
DEFAULT_CLASS = "damage"


# YOLO ------------------------------------------------------------------------------------


def read_label_lines(spark: SparkSession, pattern: str) -> DataFrame:
    """``path, line_no, line`` of label files; numbering starts at the first non-blank line."""
    files = spark.read.text(pattern, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
    lines = files.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("_i", "line"))
    return lines.select("path", (F.col("_i") + 1).alias("line_no"), "line")


def parse_label_lines(lines: DataFrame) -> DataFrame:
    """``path, line_no, class_id, kind, coords, error`` for every non-blank line.

    Four coordinates are a box, an even number from six on a polygon. A box outside [0, 1] is
    kept and reported; a line that cannot be read has no ``kind``.
    """
    numbers = F.split(F.trim("line"), r"\s+").try_cast("array<double>")
    # Out of an array of one: filters on what is derived stay above, so a line is read once.
    rows = lines.where(F.trim("line") != "").select("path", "line_no", F.explode(F.array(numbers)).alias("_n"))
    coords = F.slice("_n", 2, F.size("_n") - 1)
    rows = rows.withColumn("coords", F.when(F.size("_n") > 1, coords).otherwise(F.array().cast("array<double>")))
    count = F.size("coords")
    broken = F.get(F.sort_array("_n"), F.lit(0)).isNull()  # nulls sort first
    kind = F.when(broken, None).when(count == 4, "detection").when((count >= 6) & (count % 2 == 0), "segmentation")
    outside = (F.array_min("coords") < 0) | (F.array_max("coords") > 1)
    where = F.concat(F.substring_index("path", "/", -1), F.lit(":"), F.col("line_no").cast("string"), F.lit(": "))
    # The sentences below are outputs that must match the published ones word for word.
    error = (
        F.when(broken, F.concat(where, F.lit("non-numeric token")))
        .when(kind.isNull(), F.concat(where, F.lit("expected 4 (box) or even>=6 (polygon) coords, got "), count.cast("string")))
        .when((kind == "detection") & outside, F.concat(where, F.lit("box not normalised to [0,1]")))
    )
    return rows.select("path", "line_no", F.get("_n", F.lit(0)).cast("int").alias("class_id"), kind.alias("kind"), "coords", error.alias("error"))


def label_kinds(parsed: DataFrame) -> DataFrame:
    """``path, kind``: detection, segmentation, mixed or none, per label file."""
    boxes = F.bool_or(F.coalesce(F.col("kind") == "detection", F.lit(False)))
    shapes = F.bool_or(F.coalesce(F.col("kind") == "segmentation", F.lit(False)))
    return parsed.groupBy("path").agg(
        F.when(boxes & shapes, "mixed").when(boxes, "detection").when(shapes, "segmentation").otherwise("none").alias("kind"))


def label_errors(parsed: DataFrame) -> DataFrame:
    """``path, error``: the errors of lines, and one per file that mixes kinds; lines are read once.

    A line counts for its file, under no error, and for its own error if it has one.
    """
    own = F.struct("error", F.lit(None).cast("string").alias("kind"))
    of_file = F.struct(F.lit(None).cast("string").alias("error"), "kind")
    said = parsed.select("path", F.explode(F.when(F.col("error").isNull(), F.array(of_file)).otherwise(F.array(of_file, own))).alias("s")).select("path", "s.*")
    found = said.groupBy("path", "error").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.col("kind") == "detection").alias("boxes"), F.bool_or(F.col("kind") == "segmentation").alias("shapes"))
    mixed = F.when(F.col("boxes") & F.col("shapes"), F.concat(F.substring_index("path", "/", -1), F.lit(": mixes detection and segmentation lines")))
    errors = found.select("path", F.coalesce("error", mixed).alias("error"), F.when(F.col("error").isNull(), 1).otherwise(F.col("n")).alias("n"))
    return errors.where(F.col("error").isNotNull()).select("path", "error", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_i")).drop("_i")


def _class_name(index: Column, classes: Sequence[str]) -> Column:
    names = F.array(*[F.lit(c) for c in classes])
    known = (index >= 0) & (index < len(classes))
    return F.when(known, F.get(names, index)).otherwise(F.concat(F.lit("class_"), index.cast("string")))


def label_boxes(parsed: DataFrame, images: DataFrame, classes: Sequence[str] = (DEFAULT_CLASS,)) -> DataFrame:
    """Boxes in pixels; ``images`` has ``image, width, height`` and meets labels by file stem."""
    sized = images.select("image", "width", "height", stem(F.col("image")).alias("_stem"))
    c = F.col("coords")
    boxes = parsed.where(F.col("kind") == "detection").withColumn("_stem", stem(F.col("path"))).join(sized, "_stem")
    return boxes.select(
        "image", "line_no", "class_id", _class_name(F.col("class_id"), classes).alias("class_name"),
        ((c[0] - c[2] / 2) * F.col("width")).alias("x1"), ((c[1] - c[3] / 2) * F.col("height")).alias("y1"),
        ((c[0] + c[2] / 2) * F.col("width")).alias("x2"), ((c[1] + c[3] / 2) * F.col("height")).alias("y2"), F.lit(1.0).alias("score"))


def label_polygons(parsed: DataFrame, images: DataFrame, classes: Sequence[str] = (DEFAULT_CLASS,)) -> DataFrame:
    """Polygons in pixels, one row per polygon with ``points ARRAY<STRUCT<x, y>>``."""
    sized = images.select("image", "width", "height", stem(F.col("image")).alias("_stem"))
    shapes = parsed.where(F.col("kind") == "segmentation").withColumn("_stem", stem(F.col("path"))).join(sized, "_stem")
    spots = F.sequence(F.lit(0), (F.size("coords") / 2 - 1).cast("int"))
    points = F.transform(spots, lambda i: F.struct(
        (F.get("coords", i * 2) * F.col("width")).alias("x"), (F.get("coords", i * 2 + 1) * F.col("height")).alias("y")))
    return shapes.select("image", "line_no", "class_id", _class_name(F.col("class_id"), classes).alias("class_name"), points.alias("points"))


def write_yolo(boxes: DataFrame, path: str, classes: Sequence[str] = (DEFAULT_CLASS,), mode: str = "overwrite") -> None:
    """Label lines as ``image<TAB>line`` text under ``split=…``, and the class list next to them.

    ``boxes`` has ``split, image, cls, x1, y1, x2, y2`` in image fractions; an image without a
    box appears with NULL coordinates and an empty line.
    """
    spark = boxes.sparkSession
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    line = F.when(F.col("cls").isNotNull(), F.format_string(
        "%d %.6f %.6f %.6f %.6f", "cls", (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, wide, high)).otherwise("")
    boxes.select("split", F.concat_ws("\t", F.col("image").cast("string"), line).alias("value")).write.mode(mode).partitionBy("split").text(f"{path}/labels")
    names = spark.createDataFrame([(i, c) for i, c in enumerate(classes)], "class_id INT, class_name STRING")
    names.coalesce(1).write.mode(mode).json(f"{path}/classes")


# COCO ------------------------------------------------------------------------------------


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(images, annotations, categories)`` of COCO documents; ``doc`` tells documents apart."""
    raw = spark.read.schema(COCO_SCHEMA).json(path, multiLine=True).withColumn("doc", F.col("_metadata.file_path"))
    part = lambda name: raw.select("doc", F.explode(name).alias("_r")).select("doc", "_r.*")
    return part("images"), part("annotations"), part("categories")


def coco_boxes(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Boxes in image fractions; annotations of unknown images drop out."""
    im = images.select("doc", F.col("id").alias("image_id"), "file_name", F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"))
    b = F.col("bbox")
    # Merged: labels look small as files, and as a broadcast they would be many times larger.
    return annotations.join(im.hint("merge"), ["doc", "image_id"]).select(
        F.substring_index("file_name", "/", -1).alias("image"), group_of(stem(F.col("file_name"))).alias("grp"),
        F.coalesce("category_id", F.lit(0)).cast("int").alias("cls"), (b[0] / F.col("w")).alias("x1"), (b[1] / F.col("h")).alias("y1"),
        ((b[0] + b[2]) / F.col("w")).alias("x2"), ((b[1] + b[3]) / F.col("h")).alias("y2"))


def coco_classes(categories: DataFrame, class_map: Mapping[int, int] | None = None, single_class: bool = False) -> DataFrame:
    """``doc, category_id, class_id, class_name``: contiguous by id, by an explicit map, or all one class."""
    c = categories.select("doc", F.col("id").alias("category_id"), F.col("name").alias("class_name"))
    if single_class:
        return c.withColumns({"class_id": F.lit(0), "class_name": F.lit("object")}).select("doc", "category_id", "class_id", "class_name")
    if class_map is not None:
        pairs = F.create_map(*[F.lit(int(v)) for kv in class_map.items() for v in kv])
        mapped = F.get(F.filter(F.array(F.try_element_at(pairs, F.col("category_id").cast("int"))), lambda v: v.isNotNull()), F.lit(0))
        return c.withColumn("class_id", mapped).where(F.col("class_id").isNotNull()).select("doc", "category_id", "class_id", "class_name")
    dense = F.row_number().over(Window.partitionBy("doc").orderBy("category_id")) - 1
    return c.withColumn("class_id", dense).select("doc", "category_id", "class_id", "class_name")


def coco_to_yolo(
    images: DataFrame, annotations: DataFrame, categories: DataFrame, files: DataFrame, *,
    segmentation: bool = False, class_map: Mapping[int, int] | None = None, single_class: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(label lines: image, line; skipped: file_name)``.

    ``files`` lists the image names that exist. Images that are missing or have no size are
    skipped, crowds and unmapped categories leave no line. With ``segmentation`` an
    annotation that has polygons gives one line per polygon of three points or more.
    """
    sized = (F.coalesce(F.col("width"), F.lit(0)) > 0) & (F.coalesce(F.col("height"), F.lit(0)) > 0)
    # Merged: names, labels and classes come out of arrays, so they look small by rows of documents, and as a broadcast they would be many times larger.
    present = files.select(F.col("file_name")).distinct().hint("merge")
    kept = images.where(sized).join(present, "file_name", "left_semi")
    skipped = images.where(~sized).select("file_name").unionByName(images.where(sized).join(present, "file_name", "left_anti").select("file_name"))
    ann = annotations.where(F.coalesce(F.col("iscrowd"), F.lit(0)) == 0).join(
        kept.select("doc", F.col("id").alias("image_id"), "file_name", "width", "height").hint("merge"), ["doc", "image_id"])
    rows = ann.join(coco_classes(categories, class_map, single_class).select("doc", "category_id", "class_id").hint("merge"), ["doc", "category_id"])
    nested = F.from_json("segmentation", "ARRAY<ARRAY<DOUBLE>>")
    flat = F.from_json("segmentation", "ARRAY<DOUBLE>")
    polygons = F.when(F.coalesce(F.size(F.get(nested, F.lit(0))), F.lit(-1)) >= 0, nested).when(
        F.coalesce(F.size(flat), F.lit(-1)) > 0, F.array(flat)).otherwise(F.array().cast("array<array<double>>"))
    has_shape = F.col("segmentation").isNotNull() & ~F.trim("segmentation").isin("[]", "{}", "")
    number = lambda v: F.format_string("%.6f", v)
    as_shape = F.transform(F.filter(polygons, lambda p: F.size(p) >= 6), lambda p: F.concat_ws(" ", F.col("class_id").cast("string"), F.array_join(
        F.transform(F.slice(p, F.lit(1), (F.floor(F.size(p) / 2) * 2).cast("int")), lambda v, i: number(v / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")))), " ")))
    b = F.col("bbox")
    as_box = F.when(F.size(b) == 4, F.array(F.concat_ws(
        " ", F.col("class_id").cast("string"), number((b[0] + b[2] / 2) / F.col("width")), number((b[1] + b[3] / 2) / F.col("height")),
        number(b[2] / F.col("width")), number(b[3] / F.col("height"))))).otherwise(F.array().cast("array<string>"))
    lines = F.when(has_shape, as_shape).otherwise(as_box) if segmentation else as_box
    return rows.select(F.substring_index("file_name", "/", -1).alias("image"), F.explode(lines).alias("line")), skipped


# Pascal VOC ------------------------------------------------------------------------------


def read_voc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(boxes in image fractions, classes: cls, class_name)``; class numbers in first-seen order."""
    raw = spark.read.schema(VOC_SCHEMA).format("xml").option("rowTag", "annotation").load(path).withColumn("path", F.col("_metadata.file_path"))
    objects = raw.select("path", "filename", "size", F.posexplode("object").alias("_i", "o"))
    named = objects.withColumn("class_name", F.coalesce(F.nullif(F.trim("o.name"), F.lit("")), F.lit(DEFAULT_CLASS)))
    first = named.groupBy("class_name").agg(F.min(F.struct("path", "_i")).alias("_first"))
    classes = first.select("class_name", (F.row_number().over(Window.orderBy("_first")) - 1).alias("cls"))
    w, h = F.col("size.width").cast("double"), F.col("size.height").cast("double")
    at = lambda c: F.coalesce(F.col(f"o.bndbox.{c}"), F.lit(0.0))
    boxes = named.where(F.col("o.bndbox").isNotNull()).join(F.broadcast(classes), "class_name").select(
        F.col("filename").alias("image"), "cls", "class_name", F.try_divide(at("xmin"), w).alias("x1"), F.try_divide(at("ymin"), h).alias("y1"),
        F.try_divide(at("xmax"), w).alias("x2"), F.try_divide(at("ymax"), h).alias("y2"))
    return boxes, classes
