"""Greedy matching and suppression: sequential per image, run in an image's task or as rounds of joins.

Pairs of an ordinary image that overlap enough are joined in order of service, and a task serves
many images at a time; for suppression such an image is one row holding its boxes, folded on the JVM.
An image with more boxes than one row should hold is resolved by rounds over its edge table;
both ways give the same answer and an image takes exactly one of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import BOX, fields, iou, iou_eps, named
from ..plans import large_groups, pin
from .boxpairs import overlapping_pairs

BOXES_PER_ROW = 2_000
BOXES_CONF = "spark.sweepframe.boxesPerRow"


def _row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(BOXES_CONF, str(BOXES_PER_ROW)))


def greedy_match(
    predictions: DataFrame, truths: DataFrame, keys: Sequence[str] = ("image",), *,
    iou_threshold: float | Sequence[float] = 0.5, same_class: bool = False, carry: Sequence[str] = (),
    variants: Sequence[str] = (), among: DataFrame | None = None,
) -> DataFrame:
    """One row per prediction: ``keys, box_id, score, iou_threshold, gt_id, match_iou, carry…``.

    Predictions are served by descending score, then ``box_id``; each takes the free ground
    truth of highest IoU, the smallest ``box_id`` among equals, when that IoU reaches the
    threshold. ``gt_id`` is NULL for a false positive. Several thresholds are matched
    independently from the same rows. Because service is by score, dropping predictions
    below some confidence later leaves the other matches as they are, so one result serves
    every confidence sweep.

    ``variants`` are keys that only the predictions have: each variant is matched with the same truths.
    ``among`` may name a table whose rows with a key are at least a variant's predictions and truths,
    to count crowded images in where the predictions are costly.
    """
    keys = list(keys)
    shared = [k for k in keys if k not in variants]
    thresholds = list(iou_threshold) if isinstance(iou_threshold, (list, tuple)) else [iou_threshold]
    limit = _row_limit(predictions)
    sizes = among if among is not None else predictions.select(*shared).unionByName(truths.select(*shared))
    crowded = large_groups(sizes.select(*shared), shared, limit).select(*shared)
    cls = ["class_name"] if same_class else []
    p = predictions.select(*keys, "box_id", *BOX, "score", *cls, *[c for c in carry if c not in cls])
    g = truths.select(*shared, "box_id", *BOX, *cls)
    if crowded.isEmpty():
        return _served(p, g, keys, shared, thresholds, same_class, carry)
    crowded = pin(crowded)
    ordinary = _served(
        p.join(crowded, shared, "left_anti"), g.join(crowded, shared, "left_anti"), keys, shared, thresholds, same_class, carry
    )
    p, g = (t.join(crowded, shared, "left_semi") for t in (p, g))
    if variants:
        g = g.join(p.select(*keys).distinct(), shared)
    for t in thresholds:
        ordinary = ordinary.unionByName(_in_rounds(p, g, keys, t, same_class, carry))
    return ordinary


def _served(p, g, keys, shared, thresholds, same_class, carry) -> DataFrame:
    """Ordinary images: a row per prediction and truth it may take, best first, in order of service.

    The rows of an image lie together in a task, which serves all images of a batch at once, the first
    prediction of each, then the second, and so on.
    """
    pair = F.coalesce(iou(named("_p_"), named("_g_")), F.lit(0.0))
    may = (pair >= float(min(thresholds))) & (pair > 0)
    for k in shared:
        may &= F.col(k) == F.col(f"_g_{k}")
    if same_class:
        may &= F.col("class_name") == F.col("_g_class_name")
    # Rows are numbered, as identifiers may repeat.
    asks = p.select(*keys, "box_id", "score", *[c for c in dict.fromkeys([*carry, *(["class_name"] if same_class else [])])],
                    *[F.col(c).alias(f"_p_{c}") for c in BOX], F.monotonically_increasing_id().alias("_p"))
    pool = g.select(*[F.col(c).alias(f"_g_{c}") for c in g.columns], F.monotonically_increasing_id().alias("_g"))
    rows = asks.join(pool, may, "left").select(
        *keys, "box_id", "score", *[c for c in carry if c not in (*keys, "box_id", "score")], "_p", "_g", F.col("_g_box_id").alias("gt_id"), F.when(F.col("_g").isNotNull(), pair).alias("match_iou"))
    # The window asks Spark for the rows of an image in one task and in this order; its first row marks where they start.
    order = Window.partitionBy(*keys).orderBy((-F.col("score")).asc(), "box_id", "_p", F.col("match_iou").desc(), "gt_id", "_g")
    lined_up = rows.withColumn("_head", F.row_number().over(order) == 1)
    kinds = dict(rows.dtypes)
    names = [*keys, "box_id", "score", "iou_threshold", "gt_id", "match_iou", *carry]
    shape = ", ".join(f"`{c}` {'double' if c == 'iou_threshold' else kinds[c]}" for c in names)

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the last image, which may go on
        for batch in batches:
            part = pa.Table.from_batches([batch])
            heads = np.flatnonzero(part.column("_head").to_numpy())
            if held and len(heads):
                yield from answers(pa.concat_tables([*held, part.slice(0, heads[0])]))
                held, part = [], part.slice(heads[0])
                heads = heads - heads[0]
            if len(heads) > 1:
                yield from answers(part.slice(0, heads[-1]))
                part = part.slice(heads[-1])
            held.append(part)
        if held:
            yield from answers(pa.concat_tables(held))

    def answers(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        head = table.column("_head").to_numpy()
        service = np.cumsum(head)
        asked = table.column("_p").to_numpy()
        first = np.flatnonzero(np.r_[True, (asked[1:] != asked[:-1]) | head[1:]])
        who = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(asked)]))
        turn = who - who[np.searchsorted(service, service)]
        truth = table.column("_g").fill_null(-1).to_numpy()
        value = table.column("match_iou").fill_null(0.0).to_numpy()
        given = table.select([c for c in names if c not in ("iou_threshold", "gt_id", "match_iou")]).take(pa.array(first))
        for t in thresholds:
            edges = np.flatnonzero((truth >= 0) & ~(value < t))  # NaN is above all, as in Spark
            taken = np.full(len(first), -1)
            if len(edges):
                edges = edges[np.argsort(turn[edges], kind="stable")]
                known, no = np.unique(truth[edges], return_inverse=True)
                slot = np.unique(service[edges] * len(known) + no, return_inverse=True)[1]
                used = np.zeros(slot.max() + 1, bool)
                ends = np.flatnonzero(np.diff(turn[edges])) + 1
                for lo, hi in zip(np.r_[0, ends], np.r_[ends, len(edges)]):
                    free = lo + np.flatnonzero(~used[slot[lo:hi]])
                    asker, best = np.unique(who[edges[free]], return_index=True)
                    taken[asker] = edges[free[best]]
                    used[slot[free[best]]] = True
            of = pa.array(taken, mask=taken < 0)
            columns = {c: given.column(c) for c in given.column_names}
            columns |= {c: table.column(c).take(of) for c in ("gt_id", "match_iou")}
            columns["iou_threshold"] = pa.array(np.full(len(first), float(t)))
            yield from pa.table({c: columns[c] for c in names}).to_batches()

    return lined_up.mapInArrow(serve, shape)


def _in_rounds(p, g, keys, threshold, same_class, carry) -> DataFrame:
    """Every prediction asks its best remaining truth, a truth keeps its best asker, and the
    edges it turned down disappear; when nobody is turned down the pairing is the greedy one,
    since all truths rank predictions by the same order.
    """
    edges = overlapping_pairs(p, g, keys).where((F.col("iou") >= threshold) & (F.col("iou") > 0))
    if same_class:
        edges = edges.where(F.col("a_class_name") == F.col("b_class_name"))
    alive = pin(edges.select(
        *keys, F.col("a_box_id").alias("p"), (-F.col("a_score")).alias("rank"), F.col("b_box_id").alias("g"), "iou"
    ))
    while True:
        asks = alive.groupBy(*keys, "p").agg(
            F.min_by(F.struct("g", "rank", "iou"), F.struct(-F.col("iou"), "g")).alias("ask")
        ).select(*keys, "p", "ask.*")
        winners = asks.groupBy(*keys, "g").agg(F.min(F.struct("rank", "p")).alias("best"))
        judged = alive.join(winners, [*keys, "g"], "left").withColumn(
            "_out", F.coalesce(F.struct("rank", "p") > F.col("best"), F.lit(False))
        )
        judged = pin(judged)
        if judged.where("_out").isEmpty():
            break
        alive = judged.where(~F.col("_out")).select(*keys, "p", "rank", "g", "iou")
    return p.join(
        asks.select(*keys, F.col("p").alias("box_id"), F.col("g").alias("gt_id"), F.col("iou").alias("match_iou")),
        [*keys, "box_id"], "left",
    ).select(
        *keys, "box_id", "score", F.lit(float(threshold)).alias("iou_threshold"), "gt_id", "match_iou", *carry
    )


def nms(boxes: DataFrame, keys: Sequence[str] = ("image",), iou_threshold: float = 0.45) -> DataFrame:
    """Boxes that survive greedy suppression: by descending score, then ``box_id``, a box falls
    when a kept one overlaps it by more than the threshold."""
    keys = list(keys)
    crowded = large_groups(boxes, keys, _row_limit(boxes)).select(*keys)
    if crowded.isEmpty():
        return _nms_folded(boxes, keys, iou_threshold)
    crowded = pin(crowded)
    return _nms_folded(boxes.join(crowded, keys, "left_anti"), keys, iou_threshold).unionByName(
        _nms_rounds(boxes.join(crowded, keys, "left_semi"), keys, iou_threshold)
    )


def _nms_folded(boxes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    rest = [c for c in boxes.columns if c not in keys and c != "box_id"]
    lined_up = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "box_id", *rest)))
    rows = boxes.groupBy(*keys).agg(lined_up.alias("_b"))

    def consider(kept: Column, box: Column) -> Column:
        hit = F.exists(kept, lambda k: iou_eps(fields(k), fields(box)) > threshold)
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(box)))

    kept = F.aggregate("_b", F.slice("_b", 1, 0), consider)
    return rows.select(*keys, F.explode(kept).alias("_k")).select(
        *keys, *[F.col(f"_k.{c}").alias(c) for c in boxes.columns if c not in keys]
    ).select(*boxes.columns)


def _nms_rounds(boxes: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """A box without an undecided stronger rival is kept and takes its weaker rivals out."""
    slim = boxes.select(*keys, "box_id", *BOX, "score")
    pairs = overlapping_pairs(slim, slim, keys)
    rivals = pairs.where(iou_eps(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")) > threshold).where(
        F.struct(-F.col("a_score"), F.col("a_box_id")) < F.struct(-F.col("b_score"), F.col("b_box_id"))
    )
    edges = pin(rivals.select(*keys, F.col("a_box_id").alias("strong"), F.col("b_box_id").alias("weak")))
    open_boxes = pin(slim.select(*keys, F.col("box_id").alias("node")))
    kept = None
    while not open_boxes.isEmpty():
        beaten = edges.select(*keys, F.col("weak").alias("node")).distinct()
        won = pin(open_boxes.join(beaten, [*keys, "node"], "left_anti"))
        kept = won if kept is None else pin(kept.unionByName(won))
        lost = edges.join(won.withColumnRenamed("node", "strong"), [*keys, "strong"], "left_semi").select(
            *keys, F.col("weak").alias("node")).distinct()
        decided = pin(won.unionByName(lost))
        open_boxes = pin(open_boxes.join(decided, [*keys, "node"], "left_anti"))
        for end in ("strong", "weak"):
            edges = edges.join(decided.withColumnRenamed("node", end), [*keys, end], "left_anti")
        edges = pin(edges)
    if kept is None:
        return boxes.limit(0)
    return boxes.join(kept.withColumnRenamed("node", "box_id"), [*keys, "box_id"], "left_semi").select(*boxes.columns)
