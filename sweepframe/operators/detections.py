"""Detection quality: precision and recall, average precision, sweeps, ensembles, AUROC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import group_quantiles, ordered_columns, pin
from .boxpairs import agreeing

# The threshold lists the published evaluations use.
COCO_IOUS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
CONF_SWEEP = tuple(round(0.1 * i, 2) for i in range(1, 10))
FROC_CONFS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; a zero denominator gives 0.0 here, unlike in the frame-level gate."""
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(tp, tp + fp), zero)
    recall = F.coalesce(F.try_divide(tp, tp + fn), zero)
    f1 = F.coalesce(F.try_divide(2.0 * precision * recall, precision + recall), zero)
    return {"precision": precision, "recall": recall, "f1": f1}


def scored(predictions: DataFrame, images: DataFrame, image: str = "image") -> DataFrame:
    """Predictions on images that have a ground-truth entry, even an empty one."""
    return predictions.join(images.select(image), image, "left_semi")


def unscored_images(predictions: DataFrame, images: DataFrame, image: str = "image") -> DataFrame:
    return predictions.select(image).distinct().join(images.select(image), image, "left_anti")


def _levels(counts: DataFrame, iou_thresholds: Sequence[float] | None) -> Column:
    """The IoU thresholds reported on: those given, else those met, else 0.5."""
    if iou_thresholds is not None:
        return F.array(*[F.lit(float(t)) for t in iou_thresholds])
    met = counts.agg(F.collect_set("iou_threshold").alias("t")).select(
        F.when(F.size("t") > 0, F.col("t")).otherwise(F.array(F.lit(0.5)))).scalar()
    return met


def _reported(counts: DataFrame, truths: DataFrame, keys: list[str], iou_thresholds: Sequence[float] | None) -> DataFrame:
    """Every key that has a truth or a prediction, at every IoU threshold: what a report has rows for."""
    if keys:
        base = counts.select(*keys).unionByName(truths.select(*keys)).distinct()
    else:
        base = counts.sparkSession.range(1).select(F.lit(1).alias("_one"))
    return base.withColumn("iou_threshold", F.explode(_levels(counts, iou_thresholds))).drop("_one")


def _counted_once(counts: DataFrame, keys: list[str], iou_thresholds: Sequence[float] | None) -> DataFrame:
    """Counts of a match, stored where the report also takes its keys or thresholds from them: the match runs once."""
    return pin(counts) if keys or iou_thresholds is None else counts


def match_totals(
    matches: DataFrame, truths: DataFrame, keys: Sequence[str] = (), iou_thresholds: Sequence[float] | None = None
) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` per IoU threshold and ``keys`` (both tables carry them).

    A key without predictions has a row of misses, one without truths a row of false alarms; without
    keys there is always a row.
    """
    keys = list(keys)
    hits = _counted_once(matches.groupBy(*keys, "iou_threshold").agg(
        F.count("gt_id").alias("tp"), F.count_if(F.col("gt_id").isNull()).alias("fp")
    ), keys, iou_thresholds)
    rows = _reported(hits, truths, keys, iou_thresholds)
    return _with_truth_counts(rows.join(hits, [*keys, "iou_threshold"], "left").fillna(0, ["tp", "fp"]), truths, keys)


def _with_truth_counts(hits: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    if keys:
        totals = truths.groupBy(*keys).agg(F.count(F.lit(1)).alias("gt"))
        joined = hits.join(totals, keys, "left").fillna(0, ["gt"])
    else:
        joined = hits.withColumn("gt", truths.agg(F.count(F.lit(1))).scalar())
    fn = F.col("gt") - F.col("tp")
    return joined.withColumn("fn", fn).withColumns(prf(F.col("tp"), F.col("fp"), F.col("fn"))).drop("gt")


def per_image(matches: DataFrame, truths: DataFrame, images: DataFrame, image: str = "image") -> DataFrame:
    """``image, tp, fp, fn`` for every scored image; no row at all when there is no label to judge by."""
    hits = matches.groupBy(image).agg(
        F.count("gt_id").alias("tp"), F.count_if(F.col("gt_id").isNull()).alias("fp")
    )
    totals = truths.groupBy(image).agg(F.count(F.lit(1)).alias("gt"))
    labels = truths.agg(F.count(F.lit(1))).scalar()
    out = images.select(image).join(hits, image, "left").join(totals, image, "left").fillna(0, ["tp", "fp", "gt"])
    return out.where(labels > 0).select(image, "tp", "fp", (F.col("gt") - F.col("tp")).alias("fn"))


def confidence_sweep(
    matches: DataFrame, truths: DataFrame, thresholds: Sequence[float] = CONF_SWEEP, keys: Sequence[str] = (),
    iou_thresholds: Sequence[float] | None = None,
) -> DataFrame:
    """Precision, recall and F1 at every confidence, from one match; rows as in :func:`match_totals`.

    Predictions are counted by the number of thresholds they reach; only those counts are
    spread over the thresholds.
    """
    keys = list(keys)
    levels = sorted(float(t) for t in thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in levels]), lambda t: t <= F.col("score")))
    counts = _counted_once(matches.groupBy(*keys, "iou_threshold", reached.alias("_level")).agg(
        F.count("gt_id").alias("_tp"), F.count_if(F.col("gt_id").isNull()).alias("_fp")
    ), keys, iou_thresholds)
    steps = F.array(*[F.struct(F.lit(i + 1).alias("no"), F.lit(t).alias("conf")) for i, t in enumerate(levels)])
    spread = counts.withColumn("_s", F.explode(steps))
    in_ = F.col("_level") >= F.col("_s")["no"]
    hits = spread.groupBy(*keys, "iou_threshold", F.col("_s")["conf"].alias("conf")).agg(
        F.coalesce(F.sum(F.when(in_, F.col("_tp"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(in_, F.col("_fp"))), F.lit(0)).alias("fp"),
    )
    rows = _reported(counts, truths, keys, iou_thresholds).withColumn("conf", F.explode(F.array(*[F.lit(t) for t in levels])))
    return _with_truth_counts(rows.join(hits, [*keys, "iou_threshold", "conf"], "left").fillna(0, ["tp", "fp"]), truths, keys)


def best_f1(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The sweep row of highest F1, the lowest threshold among equals."""
    row = F.min_by(F.struct("conf", "tp", "fp", "fn", "precision", "recall", "f1"), F.struct(-F.col("f1"), "conf"))
    return sweep.groupBy(*keys).agg(row.alias("_r")).select(*keys, "_r.*")


def pr_curve(matches: DataFrame, truths: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cumulative true and false positives over the ranking (score, image, box), with precision and recall."""
    keys = [*keys, "iou_threshold"]
    rows = matches.select(
        *keys, (-F.col("score")).alias("_rank"), "image", "box_id",
        F.col("gt_id").isNotNull().cast("bigint").alias("_hit"),
    )
    rows = pin(rows)  # matching is the costly part; the ranking reads its result twice
    ranked = ordered_columns(
        rows, keys, ["_rank", "image", "box_id"], sums={"tp": F.col("_hit"), "fp": F.lit(1) - F.col("_hit")}
    )
    groups = [k for k in keys if k != "iou_threshold"]
    if groups:
        totals = truths.groupBy(*groups).agg(F.count(F.lit(1)).alias("gt"))
        ranked = ranked.join(totals, groups, "left")
    else:
        ranked = ranked.withColumn("gt", truths.agg(F.count(F.lit(1))).scalar())
    return ranked.withColumns({
        "precision": F.col("tp") / (F.col("tp") + F.col("fp")), "recall": F.try_divide("tp", "gt"),
    }).drop("_hit")


def _hits_of_all(matches: DataFrame, truths: DataFrame, keys: list[str], levels: list[float]) -> DataFrame | None:
    """``keys, iou_threshold, precision, recall`` at the true positives of :func:`pr_curve`, from one row a prediction.

    A false positive never has the best precision of its recall. None where a prediction lacks one of the
    ``levels`` or occurs twice: such matches have a ranking per threshold.
    """
    at = F.col("iou_threshold")
    mark = F.coalesce(*[F.when(at == t, F.lit(1 << i).cast("bigint")) for i, t in enumerate(levels)])
    rows = pin(matches.where(at.isin(levels)).groupBy(*keys, (-F.col("score")).alias("_rank"), "image", "box_id").agg(
        F.coalesce(F.bit_or(F.when(F.col("gt_id").isNotNull(), mark)), F.lit(0).cast("bigint")).alias("_hits"),
        F.bit_or(mark).alias("_met"), F.count(F.lit(1)).alias("_n")))
    if not rows.where((F.col("_met") != (1 << len(levels)) - 1) | (F.col("_n") != len(levels))).isEmpty():
        return None
    hit = [F.shiftright("_hits", i).bitwiseAND(F.lit(1).cast("bigint")) for i in range(len(levels))]
    ranked = ordered_columns(
        rows.drop("_met", "_n"), keys, ["_rank", "image", "box_id"], sums={"_r": F.lit(1), **{f"_t{i}": h for i, h in enumerate(hit)}})
    each = F.array(*[F.when(h == 1, F.struct(F.lit(t).alias("iou_threshold"), F.col(f"_t{i}").alias("tp"))) for i, (t, h) in enumerate(zip(levels, hit))])
    points = ranked.select(*keys, "_r", F.inline(F.filter(each, lambda p: p.isNotNull())))
    if keys:
        points = points.join(truths.groupBy(*keys).agg(F.count(F.lit(1)).alias("gt")), keys, "left")
    else:
        points = points.withColumn("gt", truths.agg(F.count(F.lit(1))).scalar())
    return points.select(*keys, "iou_threshold", (F.col("tp") / F.col("_r")).alias("precision"), F.try_divide("tp", "gt").alias("recall"))


def average_precision(
    matches: DataFrame, truths: DataFrame, keys: Sequence[str] = (), iou_thresholds: Sequence[float] | None = None
) -> DataFrame:
    """101-point interpolated AP per IoU threshold and key; 0 without ground truth or predictions.

    A curve point counts for every recall level up to its own. The best precision is first
    taken per highest level reached, at most 101 rows, and those rows are then folded down.
    Where several thresholds are given, a prediction is ranked once for all of them.
    """
    keys = [*keys, "iou_threshold"]
    several = iou_thresholds is not None and 1 < len(set(iou_thresholds)) <= 60
    curve = _hits_of_all(matches, truths, keys[:-1], sorted({float(t) for t in iou_thresholds})) if several else None
    if curve is None:
        curve = pr_curve(matches, truths, keys[:-1])
    # Recall levels are i * 0.01 as doubles; the number reached is corrected at rounding edges.
    guess = F.floor(F.col("recall") * 100).cast("int")
    level = F.when(F.col("recall") >= (guess + 1) * F.lit(0.01), guess + 1).when(
        F.col("recall") < guess * F.lit(0.01), guess - 1).otherwise(guess)
    best = curve.groupBy(*keys, F.least(level, F.lit(100)).alias("_level")).agg(F.max("precision").alias("_p"))
    points = F.array_agg(F.struct("_level", "_p"))
    height = lambda i: F.coalesce(
        F.array_max(F.transform(F.filter("_points", lambda p: p["_level"] >= i), lambda p: p["_p"])), F.lit(0.0)
    )
    total = F.aggregate(F.sequence(F.lit(0), F.lit(100)), F.lit(0.0), lambda acc, i: acc + height(i))
    found = best.groupBy(*keys).agg(points.alias("_points")).select(*keys, (total / 101.0).alias("ap"))
    return _reported(matches, truths, keys[:-1], iou_thresholds).join(found, keys, "left").fillna(0.0, ["ap"])


def coco_map(matches: DataFrame, truths: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean AP over .50:.95, with the .50 and .75 values."""
    ap = average_precision(matches, truths, keys, COCO_IOUS)
    at = lambda t: F.coalesce(F.max(F.when(F.col("iou_threshold") == t, F.col("ap"))), F.lit(0.0))
    return ap.groupBy(*keys).agg(
        F.round(F.sum("ap") / F.lit(len(COCO_IOUS)), 4).alias("map_50_95"),
        F.round(at(0.5), 4).alias("map_50"), F.round(at(0.75), 4).alias("map_75"),
    )


def macro_average(per_class: DataFrame, metrics: Sequence[str] = ("precision", "recall", "f1", "ap")) -> DataFrame:
    return per_class.agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics])


def image_confusion(scores: DataFrame, conf: float = 0.25, keys: Sequence[str] = ()) -> DataFrame:
    """Damage present against damage reported, per image: tp, fp, tn, fn, accuracy, P/R/F1."""
    fires = F.coalesce(F.col("top_score") >= conf, F.lit(False))
    damaged = F.col("damaged")
    cells = scores.groupBy(*keys).agg(
        F.count_if(damaged & fires).alias("tp"), F.count_if(~damaged & fires).alias("fp"),
        F.count_if(~damaged & ~fires).alias("tn"), F.count_if(damaged & ~fires).alias("fn"),
    )
    total = F.greatest(F.lit(1), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return cells.withColumns({
        "accuracy": (F.col("tp") + F.col("tn")) / total, **prf(F.col("tp"), F.col("fp"), F.col("fn")),
    })


def false_alarms_by_set(counts: DataFrame, set_name: str = "set") -> DataFrame:
    """Frames, detections, mean per frame and alarming share per clean set, and pooled (set NULL)."""
    return counts.rollup(set_name).agg(
        F.count(F.lit(1)).alias("frames"), F.sum("ndet").alias("detections"),
        F.round(F.avg("ndet"), 3).alias("mean_per_frame"),
        F.count_if(F.col("ndet") > 0).alias("alarming"),
        F.round(F.avg(F.when(F.col("ndet") > 0, 1.0).otherwise(0.0)), 3).alias("fp_frame_rate"),
    )


def detection_counts(images: DataFrame, predictions: DataFrame, image: str = "image") -> DataFrame:
    """Images ⟕ detections: ``ndet``, ``score`` (0 when silent) and ``fp`` for every image."""
    per = predictions.groupBy(image).agg(F.count(F.lit(1)).alias("ndet"), F.max("score").alias("score"))
    return images.join(per, image, "left").withColumns({
        "ndet": F.coalesce("ndet", F.lit(0)), "score": F.coalesce("score", F.lit(0.0)),
        "fp": (F.coalesce("ndet", F.lit(0)) > 0).cast("int"),
    })


def froc(sweep: DataFrame, clean_predictions: DataFrame, clean_images: int | Column, confs: Sequence[float] = FROC_CONFS) -> DataFrame:
    """False positives per clean frame against recall and precision, per confidence of ``sweep``."""
    levels = sorted(float(c) for c in confs)
    reached = F.size(F.filter(F.array(*[F.lit(t) for t in levels]), lambda t: t <= F.col("score")))
    counts = clean_predictions.groupBy(reached.alias("_level")).agg(F.count(F.lit(1)).alias("_n"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("no"), F.lit(t).alias("conf")) for i, t in enumerate(levels)])
    boxes = counts.withColumn("_s", F.explode(steps)).groupBy(F.col("_s")["conf"].alias("conf")).agg(
        F.coalesce(F.sum(F.when(F.col("_level") >= F.col("_s")["no"], F.col("_n"))), F.lit(0)).alias("_boxes")
    )
    frames = F.lit(clean_images) if isinstance(clean_images, int) else clean_images
    return sweep.join(boxes, "conf", "left").select(
        "conf", F.round(F.coalesce("_boxes", F.lit(0)) / F.greatest(F.lit(1), frames), 3).alias("fp_per_clean_frame"),
        F.round("recall", 3).alias("recall"), F.round("precision", 3).alias("precision"),
    )


def ensemble(
    det: DataFrame, seg: DataFrame, mode: str, keys: Sequence[str] = ("image",), *,
    det_conf: float = 0.25, seg_conf: float = 0.25, agree_iou: float = 0.30,
) -> DataFrame:
    """Boxes of two models combined: ``det``, ``seg``, ``union`` (copies kept) or ``agree``."""
    a, b = det.where(F.col("score") >= det_conf), seg.where(F.col("score") >= seg_conf)
    if mode == "det":
        return a
    if mode == "seg":
        return b
    if mode == "union":
        return a.unionByName(b)
    if mode == "agree":
        return agreeing(a, b, keys, agree_iou)
    raise ValueError(f"unknown mode {mode!r}, choose from det, seg, union, agree")


def auroc(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve as the Mann-Whitney statistic, ties counted half.

    Rows are first counted per distinct score, so a score shared by many rows is one row.
    """
    keys = list(keys)
    pos = F.count_if(F.col(label) == 1)
    tally = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(
        *keys, F.col(score).alias("_s")).agg(pos.alias("_pos"), (F.count(F.lit(1)) - pos).alias("_neg"))
    ranked = ordered_columns(tally, keys, ["_s"], sums={"_below": F.col("_neg")})
    wins = F.sum(F.col("_pos").cast("double") * (F.col("_below") - F.col("_neg") + F.col("_neg") / 2.0))
    return ranked.groupBy(*keys).agg(
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"),
        F.try_divide(wins, F.sum("_pos").cast("double") * F.sum("_neg").cast("double")).alias("auroc"),
    )


def box_stat_summary(stats: DataFrame, group: str, measures: Sequence[str], contrast: str = "contrast") -> DataFrame:
    """n, mean, median, p10 and p90 of every measure per group, in long form, with the share of
    boxes darker than their surround and whether that share passes 60 %."""
    darker = stats.groupBy(group).agg(
        F.avg(F.when(F.col(contrast) > 0, 1.0).otherwise(0.0)).alias("share_darker")
    )
    tall = stats.unpivot([group], list(measures), "measure", "v")
    means = tall.groupBy(group, "measure").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    cuts = group_quantiles(tall, [group, "measure"], "v", [0.1, 0.5, 0.9])
    return means.join(cuts, [group, "measure"]).join(darker, group).select(
        group, "measure", "n", "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("p10"), F.col("q")[2].alias("p90"),
        "share_darker", F.when(F.col("share_darker") > 0.6, "consistent with dark damage").otherwise("refuted").alias("reading"),
    )


def ood_threshold(scores: DataFrame, score: str = "score", percentile: float = 95.0) -> DataFrame:
    """One-row table with the calibrated cut-off; calibrating on nothing is an error when read."""
    cut = group_quantiles(scores, [], score, [percentile / 100.0], "_q").scalar()[0]
    one = scores.agg(F.count(score).alias("_n")).withColumn("threshold", cut)
    return one.select(
        F.when(F.col("_n") == 0, F.raise_error(F.lit("calibration needs in-distribution scores")))
        .otherwise(F.col("threshold")).alias("threshold")
    )


def ood_flags(scores: DataFrame, threshold: DataFrame, score: str = "score") -> DataFrame:
    """Adds ``ood``: frames at or above the threshold go to a person."""
    return scores.withColumn("ood", F.col(score) >= threshold.scalar())


def polarity_filter(boxes: DataFrame, min_contrast: float = 10.0, contrast: str = "contrast") -> DataFrame:
    """Boxes darker than their surround by the minimum; what cannot be measured is kept."""
    return boxes.where(F.col(contrast).isNull() | (F.col(contrast) >= min_contrast))


def polarity_sweep(
    boxes: DataFrame, images: DataFrame, thresholds: Sequence[float], *, conf: float = 0.25, contrast: str = "contrast"
) -> DataFrame:
    """Alarm rate per clean set and pooled (set NULL), and recall, per contrast threshold.

    ``images`` has ``image, set, damaged``. An image stays alarming at a threshold when its
    largest contrast reaches it, an unmeasurable box counting as unbounded.
    """
    strong = F.coalesce(F.col(contrast).cast("double"), F.lit(float("inf")))
    top = boxes.groupBy("image").agg(
        F.max(strong).alias("_any"), F.max(F.when(F.col("score") >= conf, strong)).alias("_sure")
    )
    rows = images.join(top, "image", "left")
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    level = lambda c: F.greatest(F.size(F.filter(cuts, lambda t: t <= F.col(c))), F.lit(0))
    counts = rows.groupBy("set", "damaged", level("_any").alias("_a"), level("_sure").alias("_s")).agg(
        F.count(F.lit(1)).alias("_n"))
    steps = F.array(*[F.struct(F.lit(i + 1).alias("no"), F.lit(float(t)).alias("min_contrast")) for i, t in enumerate(sorted(thresholds))])
    spread = counts.withColumn("_t", F.explode(steps))
    no = F.col("_t")["no"]
    n = F.col("_n")
    clean = spread.where(~F.col("damaged")).withColumn("min_contrast", F.col("_t")["min_contrast"])
    rates = clean.cube("min_contrast", "set").agg(
        F.sum(n).alias("frames"), F.coalesce(F.sum(F.when(F.col("_a") >= no, n)), F.lit(0)).alias("alarming"),
    ).where(F.col("min_contrast").isNotNull())
    recall = spread.where("damaged").groupBy(F.col("_t")["min_contrast"].alias("min_contrast")).agg(
        F.try_divide(F.coalesce(F.sum(F.when(F.col("_s") >= no, n)), F.lit(0)), F.sum(n)).alias("recall")
    )
    return rates.join(recall, "min_contrast", "left").withColumn("rate", F.try_divide("alarming", "frames"))


def best_polarity(sweep: DataFrame) -> DataFrame:
    """Lowest pooled alarm rate among thresholds whose recall is not below that of the lowest one."""
    pooled = sweep.where(F.col("set").isNull())
    base = pooled.agg(F.min_by("recall", "min_contrast")).scalar()
    return pooled.where(F.col("recall") >= base).agg(
        F.min_by(F.struct("min_contrast", "rate", "recall"), F.struct("rate", "min_contrast")).alias("_b")
    ).select("_b.*")


def seed_comparison(runs: DataFrame, baseline: str, treatment: str) -> DataFrame:
    """Mean and range of each arm per set over seeds, delta, and whether the ranges overlap.

    ``runs`` has ``arm, set, value``; runs without a value do not count.
    """
    per = runs.where(F.col("value").isNotNull()).groupBy("set", "arm").agg(
        F.avg("value").alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    side = lambda arm, tag: per.where(F.col("arm") == arm).select(
        "set", *[F.col(c).alias(f"{c}_{tag}") for c in ("mean", "lo", "hi")])
    both = side(baseline, "a").join(side(treatment, "b"), "set")
    meets = ~((F.col("hi_b") < F.col("lo_a")) | (F.col("hi_a") < F.col("lo_b")))
    return both.withColumns({
        "delta": F.col("mean_b") - F.col("mean_a"),
        "verdict": F.when(meets, "inconclusive").when(F.col("mean_b") < F.col("mean_a"), "reduced").otherwise("increased"),
    })


def variant_ablation(variants: DataFrame, base: str = "raw") -> DataFrame:
    """Alarm rate, boxes and recall per variant, and the change against the base variant.

    ``variants`` has one row per variant and image: ``variant, damaged, ndet``.
    """
    hit = F.col("ndet") > 0
    per = variants.groupBy("variant").agg(
        F.count_if(~F.col("damaged")).alias("clean_frames"),
        F.avg(F.when(~F.col("damaged"), hit.cast("double"))).alias("alarm_rate"),
        F.coalesce(F.sum(F.when(~F.col("damaged"), F.col("ndet"))), F.lit(0)).alias("boxes"),
        F.avg(F.when(F.col("damaged"), hit.cast("double"))).alias("recall"),
    )
    raw = per.where(F.col("variant") == base).select("alarm_rate").scalar()
    return per.withColumn("delta", F.col("alarm_rate") - raw)


def temporal_reduction(frames: DataFrame, raw: str = "raw", confirmed: str = "confirmed") -> DataFrame:
    """What temporal confirmation removed; per-frame counts of raw and confirmed boxes in, one row out."""
    total_raw, total_ok = F.sum(raw), F.sum(confirmed)
    rate = lambda c: F.round(F.avg((F.col(c) > 0).cast("double")), 3)
    return frames.agg(
        F.count(F.lit(1)).alias("frames"), total_raw.alias("raw_detections"), total_ok.alias("confirmed_detections"),
        F.round(F.coalesce(1.0 - F.try_divide(total_ok, total_raw), F.lit(0.0)), 3).alias("detection_reduction"),
        rate(raw).alias("raw_fp_frame_rate"), rate(confirmed).alias("confirmed_fp_frame_rate"),
    )


def mask_iou(pixels: DataFrame, sizes: DataFrame | None = None, keys: Sequence[str] = ("image",)) -> DataFrame:
    """IoU of masks ``a`` and ``b`` per image from set pixels ``keys, mask, y, x``.

    One aggregate per pixel place tells which masks cover it. ``sizes`` (``keys, mask,
    height, width``), when given, lets masks of different shape raise an error.
    """
    keys = list(keys)
    cover = pixels.groupBy(*keys, "y", "x").agg(
        F.bool_or(F.col("mask") == "a").alias("_a"), F.bool_or(F.col("mask") == "b").alias("_b")
    )
    out = cover.groupBy(*keys).agg(
        F.count_if(F.col("_a") & F.col("_b")).alias("intersection"), F.count(F.lit(1)).alias("union")
    )
    if sizes is not None:
        shapes = sizes.groupBy(*keys).agg(F.count_distinct("height", "width").alias("_shapes"))
        out = shapes.join(out, keys, "left").fillna(0, ["intersection", "union"]).where(
            F.when(F.col("_shapes") > 1, F.raise_error(F.lit("mask shapes differ")).cast("boolean")).otherwise(True)
        ).drop("_shapes")
    return out.withColumn("mask_iou", F.coalesce(F.try_divide("intersection", "union"), F.lit(0.0)))
