"""How large the groups of a table are, so that a plan can be chosen by size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP_LIMIT_CONF = "spark.sweepframe.groupRows"
DEFAULT_GROUP_ROWS = 1_000_000


def group_limit(spark: SparkSession) -> int:
    """Most rows of one group that a single task is asked to hold in order."""
    return int(spark.conf.get(GROUP_LIMIT_CONF, str(DEFAULT_GROUP_ROWS)))


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """``(rows of the largest group, rows in all)``, two numbers from one partial aggregate."""
    per_group = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest, total = per_group.agg(F.max("n"), F.sum("n")).first()
    return int(largest or 0), int(total or 0)


def large_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """Keys of the groups above ``limit`` rows; at most ``rows / limit`` of them exist."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows")).where(F.col("group_rows") > limit)
