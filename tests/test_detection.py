"""Matching and suppression against brute force, folds against rounds, and small fixed cases."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sweepframe.functions import boxes as box_fns
from sweepframe.operators import boxpairs, detections, matching

BOX = "image string, box_id int, x1 double, y1 double, x2 double, y2 double, class_name string, score double"


def table(spark, data):
    return spark.createDataFrame(data, BOX)


def iou(a, b):
    w = max(0.0, min(a[4], b[4]) - max(a[2], b[2]))
    h = max(0.0, min(a[5], b[5]) - max(a[3], b[3]))
    union = (a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h
    return w * h / union if union > 0 else 0.0


def made(seed, n, images=6):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rnd.randrange(0, 60), rnd.randrange(0, 60)
        out.append((f"i{rnd.randrange(images)}", i, float(x), float(y), float(x + rnd.randrange(8, 40)), float(y + rnd.randrange(8, 40)),
                    rnd.choice("ab"), rnd.randrange(1, 8) / 8))
    return out


def brute_match(preds, gts, thr, same_class=False):
    out = {}
    for image in {p[0] for p in preds}:
        used = set()
        for p in sorted((p for p in preds if p[0] == image), key=lambda p: (-p[7], p[1])):
            best = None
            for g in sorted((g for g in gts if g[0] == image), key=lambda g: g[1]):
                if g[1] in used or (same_class and g[6] != p[6]):
                    continue
                v = iou(p, g)
                if v > 0 and v >= thr and (best is None or v > best[0]):
                    best = (v, g[1])
            if best:
                used.add(best[1])
            out[p[1]] = best[1] if best else None
    return out


@pytest.mark.parametrize("seed,thr,same", [(1, 0.3, False), (2, 0.5, True), (3, 0.1, False)])
@pytest.mark.parametrize("boxes_per_row", ["2000", "3"])
def test_greedy_match(spark, seed, thr, same, boxes_per_row):
    preds, gts = made(seed, 60), made(seed + 50, 40)
    spark.conf.set("spark.sweepframe.boxesPerRow", boxes_per_row)
    try:
        got = matching.greedy_match(table(spark, preds), table(spark, gts), iou_threshold=thr, same_class=same)
        found = {r["box_id"]: r["gt_id"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sweepframe.boxesPerRow")
    assert found == brute_match(preds, gts, thr, same)


@pytest.mark.parametrize("boxes_per_row", ["2000", "3"])
def test_nms(spark, boxes_per_row):
    data = made(9, 80)
    spark.conf.set("spark.sweepframe.boxesPerRow", boxes_per_row)
    try:
        got = {r["box_id"] for r in matching.nms(table(spark, data), iou_threshold=0.3).collect()}
    finally:
        spark.conf.unset("spark.sweepframe.boxesPerRow")
    want = set()
    for image in {b[0] for b in data}:
        kept = []
        for b in sorted((b for b in data if b[0] == image), key=lambda b: (-b[7], b[1])):
            if all(iou(b, k) <= 0.3 for k in kept):
                kept.append(b)
        want |= {k[1] for k in kept}
    assert got == want


def test_pairs_and_agreement(spark):
    a, b = made(4, 50), made(5, 50)
    pairs = boxpairs.overlapping_pairs(table(spark, a), table(spark, b), ["image"], cell=16.0)
    got = {(r["a_box_id"], r["b_box_id"]) for r in pairs.collect()}
    assert pairs.count() == len(got)
    assert got == {(p[1], g[1]) for p in a for g in b if p[0] == g[0] and iou(p, g) > 0}
    kept = {r["box_id"] for r in boxpairs.agreeing(table(spark, a), table(spark, b), ["image"], 0.3).collect()}
    assert kept == {p[1] for p in a if any(p[0] == g[0] and iou(p, g) >= 0.3 for g in b)}


def test_one_truth_one_prediction(spark):
    g = table(spark, [("i", 0, 0.0, 0.0, 10.0, 10.0, "a", 1.0)])
    p = table(spark, [("i", 0, 0.0, 0.0, 10.0, 10.0, "a", 0.9), ("i", 1, 0.0, 0.0, 10.0, 10.0, "a", 0.8)])
    m = matching.greedy_match(p, g)
    t = detections.match_totals(m, g).first()
    assert (t["tp"], t["fp"], t["fn"], t["precision"], t["recall"]) == (1, 1, 0, 0.5, 1.0)
    assert abs(detections.average_precision(m, g).first()["ap"] - 1.0) < 1e-12


def test_no_truth_scores_zero(spark):
    g = table(spark, [])
    p = table(spark, [("i", 0, 0.0, 0.0, 10.0, 10.0, "a", 0.9)])
    m = matching.greedy_match(p, g)
    assert detections.average_precision(m, g).first()["ap"] == 0.0
    t = detections.match_totals(m, g).first()
    assert (t["tp"], t["fp"], t["fn"], t["recall"], t["f1"]) == (0, 1, 0, 0.0, 0.0)
    images = spark.createDataFrame([("i",)], "image string")
    assert detections.per_image(m, g, images).count() == 0, "nothing to judge by"


def test_average_precision_by_hand(spark):
    preds, gts = made(21, 60), made(22, 30)
    m = matching.greedy_match(table(spark, preds), table(spark, gts), iou_threshold=0.2)
    flags = brute_match(preds, gts, 0.2)
    ranked = sorted(preds, key=lambda p: (-p[7], p[0], p[1]))
    tp, points = 0, []
    for i, p in enumerate(ranked, 1):
        tp += flags[p[1]] is not None
        points.append((tp / i, tp / len(gts)))
    want = sum(max([q for q, r in points if r >= k * 0.01], default=0.0) for k in range(101)) / 101
    assert abs(detections.average_precision(m, table(spark, gts)).first()["ap"] - want) < 1e-9


def test_unknown_mode(spark):
    with pytest.raises(ValueError, match="choose from"):
        detections.ensemble(table(spark, []), table(spark, []), "vote")


def test_union_keeps_copies(spark):
    one = table(spark, [("i", 0, 0.0, 0.0, 10.0, 10.0, "a", 0.9)])
    assert detections.ensemble(one, one, "union").count() == 2
    assert detections.ensemble(one, one.where("score > 1"), "agree").count() == 0


def test_sql_functions(spark):
    box_fns.register_sql_functions(spark)
    r = spark.sql("SELECT iou(0,0,10,10, 0,0,10,5) AS a, iou(0,0,0,0, 0,0,0,0) AS z, wilson_lo(0, 20) AS lo, wilson_hi(0, 20) AS hi, wilson_hi(0, 0) AS none").first()
    assert (r["a"], r["z"], r["lo"], r["none"]) == (0.5, 0.0, 0.0, None) and 0.15 < r["hi"] < 0.17


def test_calibration_on_nothing_fails(spark):
    empty = spark.createDataFrame([], "score double")
    with pytest.raises(Exception, match="in-distribution"):
        detections.ood_threshold(empty).collect()


def test_unmeasurable_boxes_are_kept(spark):
    b = spark.createDataFrame([(1, None), (2, 5.0), (3, 12.0)], "id int, contrast double")
    assert {r["id"] for r in detections.polarity_filter(b).collect()} == {1, 3}


def test_mask_shapes_must_match(spark):
    px = spark.createDataFrame([("i", "a", 0, 0), ("i", "b", 0, 0), ("i", "b", 0, 1)], "image string, mask string, y int, x int")
    assert detections.mask_iou(px).first()["mask_iou"] == 0.5
    sizes = spark.createDataFrame([("i", "a", 2, 2), ("i", "b", 2, 3)], "image string, mask string, height int, width int")
    with pytest.raises(Exception, match="shapes differ"):
        detections.mask_iou(px, sizes).collect()
    same = spark.createDataFrame([("e", "a", 2, 2), ("e", "b", 2, 2)], "image string, mask string, height int, width int")
    assert detections.mask_iou(px, same).first()["mask_iou"] == 0.0


def test_unscored(spark):
    p = table(spark, [("x", 0, 0.0, 0.0, 1.0, 1.0, "a", 0.9), ("y", 0, 0.0, 0.0, 1.0, 1.0, "a", 0.9)])
    images = spark.createDataFrame([("x",)], "image string")
    assert rows(detections.unscored_images(p, images)) == [("y",)]
    assert detections.scored(p, images).select(F.col("image")).first()[0] == "x"


def test_reports_without_predictions_or_truths(spark):
    """Zeros, not missing rows, for whatever one side lacks."""
    shape = "image string, class_name string, box_id bigint, x1 double, y1 double, x2 double, y2 double, score double"
    box = lambda image, cls, no: (image, cls, no, 0.0, 0.0, 10.0, 10.0, 0.9)
    truths = spark.createDataFrame([box("i", "a", 1), box("i", "b", 2), box("j", "b", 3)], shape)
    preds = spark.createDataFrame([box("i", "a", 7), box("j", "c", 8)], shape)
    none = preds.limit(0)

    m = matching.greedy_match(preds, truths, ["image", "class_name"])
    got = {r["class_name"]: (r["tp"], r["fp"], r["fn"]) for r in detections.match_totals(m, truths, ["class_name"]).collect()}
    assert got == {"a": (1, 0, 0), "b": (0, 0, 2), "c": (0, 1, 0)}
    ap = {r["class_name"]: r["ap"] for r in detections.average_precision(m, truths, ["class_name"]).collect()}
    assert ap["b"] == ap["c"] == 0.0 and abs(ap["a"] - 1.0) < 1e-9
    sweep = detections.confidence_sweep(m, truths, [0.5, 0.95], ["class_name"]).collect()
    assert len(sweep) == 6 and {(r["tp"], r["fn"]) for r in sweep if r["class_name"] == "b"} == {(0, 2)}

    silent = matching.greedy_match(none, truths)
    assert [(r["tp"], r["fp"], r["fn"], r["recall"]) for r in detections.match_totals(silent, truths).collect()] == [(0, 0, 3, 0.0)]
    assert len(detections.confidence_sweep(silent, truths, [0.3, 0.6]).collect()) == 2
    assert tuple(detections.coco_map(silent, truths).first()) == (0.0, 0.0, 0.0)

    clean = matching.greedy_match(preds, truths.limit(0))
    assert [(r["tp"], r["fp"], r["fn"]) for r in detections.match_totals(clean, truths.limit(0)).collect()] == [(0, 2, 0)]
    assert [r["ap"] for r in detections.average_precision(clean, truths.limit(0)).collect()] == [0.0]


def test_auroc_of_large_counts(spark):
    """Products of counts beyond 64 bits stay numbers."""
    from pyspark.sql import types as T

    df = spark.createDataFrame([(0.5, 1), (0.5, 0)], T.StructType([T.StructField("s", T.DoubleType()), T.StructField("y", T.IntegerType())]))
    assert detections.auroc(df, "s", "y").first()["auroc"] == 0.5


@pytest.mark.parametrize("odd", ["none", "twice", "lacking"])
def test_one_ranking_serves_all_thresholds(spark, odd):
    """The same values as a ranking per threshold, also where a prediction comes twice or lacks a threshold."""
    levels = [0.5, 0.75, 0.95]
    rows = [(c, i % 7, 100 * len(c) + i, float(i * 37 % 11), t, i if (i * 13 + j * 5 + len(c)) % 4 > j else None) for c in ("a", "bb") for i in range(60) for j, t in enumerate(levels)]
    rows += {"none": [], "twice": rows[:9], "lacking": [("a", 8, 99, 3.0, 0.5, None)]}[odd]
    m = spark.createDataFrame(rows, "class_name string, image int, box_id int, score double, iou_threshold double, gt_id int")
    truths = spark.createDataFrame([(c,) for c in ["a"] * 80 + ["bb"] * 50], "class_name string")
    for keys in ([], ["class_name"]):
        one = detections.average_precision(m, truths, keys, levels)
        each = [r for t in levels for r in detections.average_precision(m.where(F.col("iou_threshold") == t), truths, keys, [t]).select(one.columns).collect()]
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, each))
        found = detections._hits_of_all(m, truths, keys, levels)
        assert (found is None) == (odd != "none")


def test_variants_share_truths_and_images_span_batches(spark):
    """Variants are matched with the same truths as if each had its own; images go on over batch ends; ids may repeat."""
    rnd = random.Random(8)
    box = lambda: (x := rnd.uniform(0, 30), y := rnd.uniform(0, 30), x + rnd.uniform(10, 25), y + rnd.uniform(10, 25))
    shape = "image string, box_id int, x1 double, y1 double, x2 double, y2 double"
    truths = spark.createDataFrame([(f"i{i}", b, *box()) for i in range(6) for b in range(5)], shape).cache()
    preds = spark.createDataFrame(
        [(f"i{i}", b % 5, *box(), round(rnd.random(), 1), v) for i in range(7) for b in range(8) for v in ("a", "b")] + [(None, 1, *box(), 0.5, "a")],
        shape + ", score double, variant string").cache()
    keys = ["image", "variant"]
    each = truths.withColumn("variant", F.explode(F.array(F.lit("a"), F.lit("b"))))
    shown = ["image", "variant", "box_id", "score", "iou_threshold", "gt_id", "match_iou"]
    want = rows(matching.greedy_match(preds, each, keys, iou_threshold=[0.2, 0.5]).select(shown))
    assert len(want) == 2 * (7 * 16 + 1) and any(r[5] is not None for r in want)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = matching.greedy_match(preds, truths, keys, iou_threshold=[0.2, 0.5], variants=["variant"], among=preds.unionByName(truths, True))
        assert rows(got.select(shown)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_images_are_matched_once_for_a_report(spark):
    """Truths are not copied for every variant, and the report on classes reads stored matches."""
    from conftest import SF
    from sweepframe.catalog import QUERIES, detection

    made = []
    keep = matching._served
    matching._served = lambda *a: made.append(keep(*a)) or made[-1]
    try:
        detection.ensemble_prf(spark, SF)
        assert made[-1]._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0
        report = QUERIES["macro_average"](spark, SF)
    finally:
        matching._served = keep
    assert "MapInArrow" not in report._jdf.queryExecution().optimizedPlan().toString()
