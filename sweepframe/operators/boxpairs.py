"""Pairs of overlapping boxes within an image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import BOX, iou, named
from ..plans import large_groups, pin

#: Boxes of both sides that a cell holds before it is cut, and how often it may be cut.
CROWD = 2_000
CUTS = 5


def _cells(df: DataFrame, keys: Sequence[str], cell: float) -> DataFrame:
    spans = [
        F.sequence(F.floor(F.col(lo) / cell).cast("bigint"), F.floor(F.col(hi) / cell).cast("bigint"))
        for lo, hi in (("x1", "x2"), ("y1", "y2"))
    ]
    return df.withColumn("_cx", F.explode(spans[0])).withColumn("_cy", F.explode(spans[1]))


def overlapping_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], cell: float = 64.0, drop_disjoint: bool = True, crowd: int = CROWD
) -> DataFrame:
    """``keys, a_<col>, b_<col>, iou`` for the pairs of boxes of one image that share area.

    Boxes meet through the grid cells they touch, so far-apart boxes of a crowded image are
    never compared. A pair found in several cells is kept in the cell that holds the top-left
    corner of the intersection, which needs no ``distinct``. A cell with more than ``crowd`` boxes is cut
    in four, up to ``CUTS`` times, and boxes meet in the part that is calm: a quadtree as deep as the crowd
    is small. Boxes that all overlap stay together, as all their pairs are the result.
    """
    keys = list(keys)

    def side(df: DataFrame, tag: str) -> DataFrame:
        cells = _cells(df, keys, cell)
        return cells.select(*keys, "_cx", "_cy", *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in keys])

    on, out, size = [*keys, "_cx", "_cy"], None, cell
    a, b = side(left, "a"), side(right, "b")
    for cut in range(CUTS + 1):
        crowded = None
        if cut < CUTS:
            counts = a.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).unionByName(b.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")))
            crowded = counts.groupBy(*on).agg(F.sum("_n").alias("_n")).where(F.col("_n") > crowd).drop("_n")
            crowded = None if crowded.isEmpty() else pin(crowded)
        calm = [t if crowded is None else t.join(crowded, on, "left_anti") for t in (a, b)]
        corner = [F.floor(F.greatest(f"a_{c}", f"b_{c}") / size) == F.col(f"_c{c[0]}") for c in ("x1", "y1")]
        pairs = calm[0].join(calm[1], on).where(corner[0] & corner[1]).withColumn("iou", iou(named("a_"), named("b_"))).drop("_cx", "_cy")
        out = pairs if out is None else out.unionByName(pairs)
        if crowded is None:
            break
        size /= 2.0
        a, b = (_quartered(t.join(crowded, on, "left_semi"), tag, size) for t, tag in ((a, "a"), (b, "b")))
    return out.where(F.col("iou") > 0) if drop_disjoint else out


def _quartered(rows: DataFrame, tag: str, size: float) -> DataFrame:
    """Boxes of crowded cells in the quarters of their cell that they touch; ``size`` is a quarter's side."""
    for c in "xy":
        lo, hi = (F.floor(F.col(f"{tag}_{c}{i}") / size).cast("bigint") for i in (1, 2))
        first = F.greatest(lo, F.col(f"_c{c}") * 2)
        last = F.least(hi, F.col(f"_c{c}") * 2 + 1)
        rows = rows.withColumn(f"_c{c}", F.explode(F.sequence(first, last)))
    return rows


def pair_iou(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IoU of every overlapping pair of two box tables."""
    cols = [*keys, "box_id", *BOX]
    return overlapping_pairs(left.select(*cols), right.select(*cols), keys).select(
        *keys, F.col("a_box_id").alias("left_id"), F.col("b_box_id").alias("right_id"), "iou"
    )


def agreeing(det: DataFrame, seg: DataFrame, keys: Sequence[str], min_iou: float = 0.30) -> DataFrame:
    """Boxes of ``det`` confirmed by some box of ``seg`` in the same image: a semi join on IoU.

    Boxes of ordinary images are compared where they lie. Where an image is crowded, they meet through cells;
    copies of one ``seg`` geometry are compared once.
    """
    if large_groups(seg, keys, CROWD).isEmpty():
        same = [F.col(f"_s_{k}") == F.col(k) for k in keys]
        there = seg.select(*[F.col(c).alias(f"_s_{c}") for c in [*keys, *BOX]])
        for condition in (iou(named(), named("_s_")) >= min_iou, iou(named(), named("_s_")) > 0):
            same.append(condition)
        return det.join(there, same, "left_semi")
    other = seg.select(*keys, *BOX).distinct()
    marked = det.select(*keys, "box_id", *BOX)
    hits = overlapping_pairs(marked, other, keys).where(F.col("iou") >= min_iou)
    return det.join(hits.select(*keys, F.col("a_box_id").alias("box_id")).distinct(), [*keys, "box_id"], "left_semi")
