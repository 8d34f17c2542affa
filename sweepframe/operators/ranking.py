"""Sorts, limits and first-per-group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ordered_columns


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of every group.

    Spark keeps only ``k`` rows per group in every task before the shuffle, so the size of a
    group does not matter.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per group, the first in ``order``: a partial aggregate, no group is collected."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, cap: int | None = None) -> DataFrame:
    """Every ``n``-th row per key from the first on, at most ``cap`` of them when one is asked for."""
    numbered = ordered_columns(df, keys, order, sums={"_rank": F.lit(1)})
    kept = numbered.where(F.pmod(F.col("_rank") - 1, F.lit(n)) == 0)
    if cap is not None:
        kept = kept.where((F.col("_rank") - 1) / F.lit(n) < cap)
    return kept.drop("_rank")


def carry_forward(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Last known value of a column that is only filled on some rows."""
    return ordered_columns(df, keys, order, carries={out: F.col(value)})


def temporal_split(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], train_fraction: float, gap: int
) -> DataFrame:
    """``part``: train, then ``gap`` discarded rows, then held_out, by position in the ordered clip."""
    numbered = ordered_columns(df, keys, order, sums={"_rank": F.lit(1)})
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    cut = F.floor(F.col("_n") * F.lit(float(train_fraction)))
    part = (
        F.when(F.col("_rank") <= cut, "train")
        .when(F.col("_rank") <= cut + gap, "discarded").otherwise("held_out")
    )
    return numbered.join(sizes, list(keys)).withColumn("part", part).drop("_rank", "_n")


def sorted_train_val(df: DataFrame, name: str, val_rows: int) -> DataFrame:
    """The first ``val_rows`` names in order go to validation, the rest to training."""
    numbered = ordered_columns(df, [], [name], sums={"_rank": F.lit(1)})
    return numbered.withColumn("part", F.when(F.col("_rank") <= val_rows, "val").otherwise("train")).drop("_rank")
