"""Dataset governance: audits, summaries, leakage-safe splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import ordered_columns, pin
from ..plans.seeded import RANGE, draw
from .ranking import top_per_group

# Bounds of the audit and the split ratios.
MIN_BOX_FRACTION = 1e-5
EDGE_SLACK = 1e-6
MIN_GROUPS = 3
RARE_CLASS = 20
MIN_CLEAN_SHARE = 0.1
SPLITS = ("train", "val", "test")
RATIOS = (0.7, 0.15, 0.15)


def audit(samples: DataFrame, boxes: DataFrame, max_examples: int = 8) -> DataFrame:
    """Issues as rows ``kind, severity, count, files``; no row means nothing was found.

    ``samples`` has ``image, grp, width, height``; ``boxes`` has ``image, cls, x1, y1, x2, y2``
    in image fractions. Examples are the first image names of an issue.
    """
    wide, high = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    flat = (wide <= 0) | (high <= 0)
    area = F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)
    outside = (F.least("x1", "y1") < -EDGE_SLACK) | (F.greatest("x2", "y2") > 1 + EDGE_SLACK)
    found = F.filter(F.array(
        F.when(flat, "degenerate_box"), F.when(~flat & (area < MIN_BOX_FRACTION), "suspiciously_small"),
        F.when(outside, "box_out_of_bounds"),
    ), lambda k: k.isNotNull())
    hits = boxes.select("image", F.explode(found).alias("kind")).unionByName(
        samples.where((F.col("width") <= 0) | (F.col("height") <= 0)).select("image", F.lit("unreadable").alias("kind")))
    counts = hits.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))
    per_image = hits.select("kind", F.col("image").cast("string").alias("image"))
    examples = top_per_group(per_image, ["kind"], [F.col("image")], max_examples).groupBy("kind").agg(
        F.array_sort(F.collect_list("image")).alias("files"))
    listed = counts.join(examples, "kind")

    labelled = boxes.select("image").distinct().withColumn("_labelled", F.lit(1))
    whole = samples.join(labelled, "image", "left").agg(
        F.count(F.lit(1)).alias("samples"), F.count("_labelled").alias("labelled"), F.count_distinct("grp").alias("groups"))
    classes = boxes.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).agg(
        F.count(F.lit(1)).alias("classes"), F.min("n").alias("rarest"))
    clean = F.col("samples") - F.col("labelled")
    rarest = F.when(F.col("classes") > 1, F.col("rarest"))
    issue = lambda test, kind, number, severity="warning": F.when(test, F.struct(
        F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), number.cast("bigint").alias("count")))
    some = F.col("samples") > 0
    general = whole.withColumn("_c", classes.select(F.struct("classes", "rarest")).scalar()).withColumns({
        "classes": F.col("_c.classes"), "rarest": F.col("_c.rarest"),
    }).select(F.inline(F.filter(F.array(
        issue(~some, "empty", F.lit(0), "error"),
        issue(some & (F.col("labelled") == 0), "no_labels", F.lit(0)),
        issue(some & (F.col("groups") < MIN_GROUPS), "too_few_groups", F.col("groups")),
        issue(some & (rarest < RARE_CLASS), "class_imbalance", F.col("rarest")),
        issue(some & (F.col("labelled") > 0) & (F.try_divide(clean, "samples") < MIN_CLEAN_SHARE), "few_negatives", clean),
    ), lambda i: i.isNotNull())))
    severity = F.when(F.col("kind") == "suspiciously_small", "warning").otherwise("error")
    return listed.select("kind", severity.alias("severity"), "count", "files").unionByName(
        general.withColumn("files", F.array().cast("array<string>")))


def health(samples: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images, boxes, clean frames and groups per split and over all (split NULL); ``samples`` carries ``split``."""
    per = boxes.groupBy("image").agg(F.count(F.lit(1)).alias("_boxes"))
    rows = samples.join(per, "image", "left").fillna(0, ["_boxes"])
    return rows.rollup("split").agg(
        F.count(F.lit(1)).alias("images"), F.sum("_boxes").alias("boxes"),
        F.count_if(F.col("_boxes") == 0).alias("clean_frames"), F.count_distinct("grp").alias("groups"))


def usable(issues: DataFrame, health_rows: DataFrame) -> DataFrame:
    """One row: blocking errors, splits that received nothing, and whether the dataset may be used."""
    errors = issues.agg(F.count_if(F.col("severity") == "error")).scalar()
    filled = health_rows.agg(F.collect_set("split").alias("_filled"))
    empty = F.array_except(F.array(*[F.lit(s) for s in SPLITS]), "_filled")
    blocking = errors + F.when(F.size(empty) > 0, 1).otherwise(0)
    return filled.select(empty.alias("empty_splits"), blocking.alias("blocking_errors"), (blocking == 0).alias("usable"))


def class_counts(boxes: DataFrame, key: str = "cls") -> DataFrame:
    return boxes.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def summary(samples: DataFrame, boxes: DataFrame, polygons: DataFrame | None = None) -> DataFrame:
    """One row: images with and without labels, boxes, polygons, size range and number of distinct sizes."""
    labelled = boxes.select("image")
    if polygons is not None:
        labelled = labelled.unionByName(polygons.select("image"))
    marked = samples.join(labelled.distinct().withColumn("_l", F.lit(1)), "image", "left")
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    shape = F.when(sized, F.concat_ws("x", "width", "height"))
    out = marked.agg(
        F.count(F.lit(1)).alias("num_images"), F.count("_l").alias("num_labelled_images"),
        (F.count(F.lit(1)) - F.count("_l")).alias("num_unlabelled_images"),
        F.min(F.when(sized, F.col("width"))).alias("min_width"), F.min(F.when(sized, F.col("height"))).alias("min_height"),
        F.max(F.when(sized, F.col("width"))).alias("max_width"), F.max(F.when(sized, F.col("height"))).alias("max_height"),
        F.count_distinct(shape).alias("distinct_sizes"),
    )
    out = out.withColumn("num_boxes", boxes.agg(F.count(F.lit(1))).scalar())
    pieces = F.lit(0).cast("bigint") if polygons is None else polygons.agg(F.count(F.lit(1))).scalar()
    return out.withColumn("num_polygons", pieces)


# Splits ----------------------------------------------------------------------------------


def _check(ratios: Sequence[float]) -> None:
    if abs(sum(ratios) - 1.0) > 1e-6:
        raise ValueError(f"split ratios must sum to 1, got {sum(ratios)}")


def grouped_split(
    samples: DataFrame, group: str = "grp", ratios: Sequence[float] = RATIOS, seed: int = 0
) -> DataFrame:
    """``group, split``: whole groups stay together; join it back on the group.

    Groups stand on a line in the order of a seeded hash (md5, which any engine can repeat). The
    first of them go to the wanted splits, one each, so no wanted split is empty while there are
    groups. The others go where the middle of their rows falls when the line of their rows is cut by
    the ratios. The definition doesn't depend on how many groups there are, and no task or driver
    holds them all.
    """
    _check(ratios)
    wanted = [i for i, r in enumerate(ratios) if r > 0]
    units = samples.groupBy(F.col(group).cast("string").alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    units = pin(units.withColumns({"line": F.lit(1), "spot": draw(seed, "grp")}))
    ranked = ordered_columns(units, ["line"], ["spot", "grp"], sums={"place": F.lit(1).cast("bigint"), "rows": F.col("n")})
    founders = len(wanted)
    ranked = pin(ranked)
    first = F.col("place") <= founders
    taken = ranked.where(first).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).scalar()
    whole = ranked.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).scalar()
    middle = (F.col("rows") - taken - F.col("n") / 2.0) / F.greatest(whole - taken, F.lit(1))
    edges, total = [], 0.0
    for i in wanted:
        total += ratios[i]
        edges.append(total)
    founder, other = F.lit(SPLITS[wanted[-1]]), F.lit(SPLITS[wanted[-1]])
    for no, (i, edge) in reversed(list(enumerate(zip(wanted, edges), 1))):
        founder = F.when(F.col("place") == no, SPLITS[i]).otherwise(founder)
        if no < founders:
            other = F.when(middle < edge, SPLITS[i]).otherwise(other)
    return ranked.select(F.col("grp").alias(group), F.when(first, founder).otherwise(other).alias("split"))


def hash_split(rows: DataFrame, unit: str, ratios: Sequence[float] = RATIOS, seed: int = 0) -> DataFrame:
    """Adds ``split`` by seeded hash of a unit: the ungrouped split, no shuffle at all."""
    _check(ratios)
    spot = draw(seed, unit) / float(RANGE)
    split = F.when(spot < ratios[0], SPLITS[0]).when(spot < ratios[0] + ratios[1], SPLITS[1]).otherwise(SPLITS[2])
    return rows.withColumn("split", split)


def straddling_groups(samples: DataFrame, group: str = "grp", split: str = "split") -> DataFrame:
    """Groups found in more than one split; an empty result is what a safe split looks like."""
    return samples.groupBy(group).agg(F.count_distinct(split).alias("splits")).where(F.col("splits") > 1)
