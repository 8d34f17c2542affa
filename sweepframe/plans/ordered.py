"""Ordered columns (running sums, carries, neighbours) that hold when one key is very large.

A window over ``partitionBy(key)`` puts a whole key into one task. That is the right plan
while every key is small. When one is not, the rows are range-partitioned on
``(keys, order)``, so a large key is cut into consecutive chunks; each chunk is windowed on
its own, one summary row per chunk is windowed per key, and the summary is joined back.
Both plans give the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import pin
from .sizing import group_limit, group_sizes

CHUNK = "_chunk"
BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, Window.currentRow)


def ordered_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    carries: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Add ordered columns to ``df`` per ``keys``, ascending by ``order`` (unique per key).

    ``sums``     running total up to and including the row
    ``carries``  latest non-null value up to and including the row
    ``nexts``    earliest non-null value from the row on
    ``lags``     value of the previous row, NULL on the first
    ``leads``    value of the following row, NULL on the last

    ``sizes`` are the largest group and the number of rows, where the caller knows them (or
    an upper bound); otherwise they are counted.
    """
    wanted = {
        "sums": dict(sums or {}), "carries": dict(carries or {}), "nexts": dict(nexts or {}),
        "lags": dict(lags or {}), "leads": dict(leads or {}),
    }
    largest, total = sizes or group_sizes(df, keys)
    limit = group_limit(df.sparkSession)
    if largest <= limit:
        return _within(df, list(keys), list(order), wanted)
    return _across_chunks(df, list(keys), list(order), wanted, math.ceil(total / limit))


def _within(df: DataFrame, keys: list[str], order: list[str], wanted: dict) -> DataFrame:
    part = Window.partitionBy(*keys)
    up = part.orderBy(*order)
    down = part.orderBy(*[F.col(c).desc() for c in order])
    columns = {n: F.sum(c).over(up.rowsBetween(*UP_TO)) for n, c in wanted["sums"].items()}
    columns |= {n: F.last(c, True).over(up.rowsBetween(*UP_TO)) for n, c in wanted["carries"].items()}
    columns |= {n: F.last(c, True).over(down.rowsBetween(*UP_TO)) for n, c in wanted["nexts"].items()}
    columns |= {n: F.lag(c).over(up) for n, c in wanted["lags"].items()}
    columns |= {n: F.lead(c).over(up) for n, c in wanted["leads"].items()}
    return df.withColumns(columns)


def _across_chunks(
    df: DataFrame, keys: list[str], order: list[str], wanted: dict, chunks: int
) -> DataFrame:
    parts = max(chunks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The chunk number is a property of where a row landed, so it is stored before use.
    rows = pin(df.repartitionByRange(parts, *keys, *order).withColumn(CHUNK, F.spark_partition_id()))

    boxed = {kind: {n: F.struct(c.alias("v")) for n, c in wanted[kind].items()} for kind in ("lags", "leads")}
    local = _within(rows, [*keys, CHUNK], order, {**wanted, **boxed})

    place = F.struct(*order)
    edge = {f"{n}_edge": F.sum(c) for n, c in wanted["sums"].items()}
    edge |= {f"{n}_edge": F.max_by(c, F.when(c.isNotNull(), place)) for n, c in wanted["carries"].items()}
    edge |= {f"{n}_edge": F.min_by(c, F.when(c.isNotNull(), place)) for n, c in wanted["nexts"].items()}
    edge |= {f"{n}_edge": F.max_by(c, place) for n, c in boxed["lags"].items()}
    edge |= {f"{n}_edge": F.min_by(c, place) for n, c in boxed["leads"].items()}
    per_chunk = rows.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in edge.items()])

    up = Window.partitionBy(*keys).orderBy(CHUNK)
    down = Window.partitionBy(*keys).orderBy(F.col(CHUNK).desc())
    heads = {f"{n}_head": F.sum(f"{n}_edge").over(up.rowsBetween(*BEFORE)) for n in wanted["sums"]}
    heads |= {f"{n}_head": F.last(f"{n}_edge", True).over(up.rowsBetween(*BEFORE)) for n in wanted["carries"]}
    heads |= {f"{n}_head": F.last(f"{n}_edge", True).over(down.rowsBetween(*BEFORE)) for n in wanted["nexts"]}
    heads |= {f"{n}_head": F.lag(f"{n}_edge").over(up) for n in wanted["lags"]}
    heads |= {f"{n}_head": F.lead(f"{n}_edge").over(up) for n in wanted["leads"]}
    offsets = per_chunk.select(*keys, CHUNK, *[c.alias(n) for n, c in heads.items()])

    joined = local.join(offsets, [*keys, CHUNK], "left")
    final = {
        n: F.when(F.col(n).isNull(), F.col(f"{n}_head")).otherwise(
            F.col(n) + F.coalesce(F.col(f"{n}_head"), F.lit(0))
        )
        for n in wanted["sums"]
    }
    final |= {n: F.coalesce(n, f"{n}_head") for kind in ("carries", "nexts") for n in wanted[kind]}
    final |= {n: F.coalesce(n, f"{n}_head")["v"] for kind in ("lags", "leads") for n in wanted[kind]}
    return joined.withColumns(final).select(*df.columns, *[n for kind in wanted.values() for n in kind if n not in df.columns])
