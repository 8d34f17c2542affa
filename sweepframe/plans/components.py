"""Connected components of an edge table by alternating large-star and small-star rounds.

Published scheme for MapReduce-style engines (Kiveris et al., 2014). Each round is two
equi joins and two partial aggregates; the edge table is stored after every round, so the
plan does not grow and a lost executor costs one round at most.

Before the rounds every task contracts its own edges, a bounded number at a time, to stars. Edges
that lie together, as those of one frame or of one stretch of a map do if they are dealt so, are
finished there, and the rounds only see what crosses tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import pin

#: Edges that a task contracts at a time.
CHUNK = 500_000


def roots(a: np.ndarray, b: np.ndarray, nodes: int) -> np.ndarray:
    """For nodes ``0 … nodes - 1`` the smallest node that the edges ``a, b`` reach: hooking and pointer jumping."""
    root = np.arange(nodes)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[open_], np.minimum(x, y)[open_])
        while (root[root] != root).any():
            root = root[root]


def contracted(edges: DataFrame) -> DataFrame:
    """``u, v``: edges (longs) with the same components, each task's as stars around its smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
            names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = roots(place[:len(u)], place[len(u):], len(names))
            far = root != np.arange(len(names))
            return pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(names[root[far]])], names=["u", "v"])

        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= CHUNK:
                yield stars(held)
                held, count = [], 0
        if count:
            yield stars(held)

    return edges.mapInArrow(run, "u bigint, v bigint")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node that has an edge; the component is one of its nodes.

    Nodes that are not longs already are numbered once, so the rounds move pairs of longs.
    """
    if dict(edges.dtypes)[a] == "bigint":
        given = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
        return _resolve(pin(contracted(given).distinct()))
    given = pin(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b")))
    ends = given.select(F.col("a").alias("node")).unionByName(given.select(F.col("b").alias("node"))).distinct()
    # Stored before use: the numbers depend on where a row was computed.
    numbered = pin(ends.withColumn("no", F.monotonically_increasing_id()))
    at = lambda end, out: numbered.select(F.col("node").alias(end), F.col("no").alias(out))
    now = pin(contracted(given.join(at("a", "u"), "a").join(at("b", "v"), "b").select("u", "v")).distinct())
    roots = _resolve(now).select(F.col("node").alias("no"), F.col("component").alias("root"))
    named = numbered.join(roots, "no").join(at("component", "root"), "root")
    return named.select("node", "component")


def _resolve(now: DataFrame) -> DataFrame:
    """Rounds on pairs of longs; the component is the smallest of its nodes."""
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
        now = pin(_small_star(_large_star(now)))
    tips = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return tips.unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    moved = both.join(low, "u").where(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.least("m", F.col("u")).alias("v")
    )
    return moved.distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
