"""Exact interpolated quantiles per group, whatever the size of the largest group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import pin
from .ordered import ordered_columns
from .sizing import group_limit, group_sizes


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], name: str = "q"
) -> DataFrame:
    """``keys, name ARRAY<DOUBLE>``: linear-interpolated quantiles of non-null ``value``.

    Groups of ordinary size use the built-in ``percentile``. For larger ones equal values are
    counted first; a group that still has more distinct values than one task should hold is
    ranked through :func:`ordered_columns` and the two neighbours of each position are picked.
    """
    keys = list(keys)
    limit = group_limit(df.sparkSession)
    values = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    at = "array(" + ", ".join(repr(float(p)) + "D" for p in probs) + ")"
    if group_sizes(values, keys)[0] <= limit:
        return values.groupBy(*keys).agg(F.expr(f"percentile(_v, {at})").alias(name))

    counts = pin(values.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    sizes = group_sizes(counts, keys)
    if sizes[0] <= limit:
        return counts.groupBy(*keys).agg(F.expr(f"percentile(_v, {at}, _c)").alias(name))

    ranked = ordered_columns(counts, keys, ["_v"], sums={"_upto": F.col("_c")}, sizes=sizes)
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    if keys:
        ranked = ranked.join(totals, keys)
    else:
        ranked = ranked.withColumn("_n", totals.scalar())
    picks = []
    for i, p in enumerate(probs):
        spot = (F.col("_n") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            here = (rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col("_v"))).alias(f"_{side}{i}"))
    found = ranked.groupBy(*keys).agg(*picks, F.max("_n").alias("_n"))
    values = []
    for i, p in enumerate(probs):
        spot = (F.col("_n") - 1) * F.lit(float(p))
        values.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (spot - F.floor(spot)))
    return found.select(*keys, F.array(*values).alias(name))
