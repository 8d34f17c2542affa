"""Helpers below the operators, and guards on physical plans."""

import random

import numpy as np
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from sweepframe.plans import components, group_quantiles, ordered_columns, pin
from sweepframe.plans.components import connected_components
from sweepframe.sources import artifacts


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; values have NULLs and the order has equal leading values."""
    return pin(spark.range(600).select(
        F.when(F.col("id") % 3 < 2, 0).otherwise(F.col("id") % 7 + 1).alias("k"), (F.col("id") / 4).cast("int").alias("t"), F.col("id"),
        F.when(F.col("id") % 5 == 0, F.col("id") * 2).alias("v")))


def spread(df):
    return ordered_columns(
        df, ["k"], ["t", "id"], sums={"s": F.col("v"), "n": F.lit(1)}, carries={"c": F.col("v")}, nexts={"x": F.col("v")},
        lags={"p": F.col("v")}, leads={"f": F.col("id")})


def test_ordered_columns_same_rows_however_cut(spark, skewed):
    plain = rows(spread(skewed))
    spark.conf.set("spark.sweepframe.groupRows", "40")
    try:
        cut = rows(spread(skewed))
    finally:
        spark.conf.unset("spark.sweepframe.groupRows")
    assert plain == cut and len(plain) == 600


def test_ordered_columns_without_key(spark, skewed):
    whole = lambda: rows(ordered_columns(skewed, [], ["t", "id"], sums={"n": F.lit(1)}).select("id", "n"))
    plain = whole()
    spark.conf.set("spark.sweepframe.groupRows", "40")
    try:
        assert plain == whole()
    finally:
        spark.conf.unset("spark.sweepframe.groupRows")


@pytest.mark.parametrize("limit", ["1000000", "20"])
def test_quantiles_match_numpy(spark, skewed, limit):
    spark.conf.set("spark.sweepframe.groupRows", limit)
    try:
        got = {r["k"]: r["q"] for r in group_quantiles(skewed, ["k"], "v", [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    finally:
        spark.conf.unset("spark.sweepframe.groupRows")
    data = skewed.where("v IS NOT NULL").toPandas()
    for k, g in data.groupby("k"):
        assert np.allclose(got[k], np.quantile(g["v"], [0.0, 0.1, 0.5, 0.99, 1.0]))


def test_components_chain_with_shuffled_ids(spark):
    n = 60
    name = lambda c: ((c * 37) % 61).cast("bigint")
    edges = spark.range(n - 1).select(name(F.col("id")).alias("a"), name(F.col("id") + 1).alias("b"))
    pair = spark.range(1).select(F.lit(100).cast("bigint").alias("a"), F.lit(101).cast("bigint").alias("b"))
    out = connected_components(edges.unionByName(pair)).collect()
    assert len(out) == n + 2
    chain = {r["component"] for r in out if r["node"] < 100}
    other = {r["component"] for r in out if r["node"] >= 100}
    assert len(chain) == 1 and min(chain) < 100 and other <= {100, 101} and len(other) == 1


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_asof_is_one_shuffle_on_the_key(spark):
    from sweepframe.catalog import QUERIES

    text = plan(QUERIES["asof_nearest_streams"](spark, SF))
    assert text.count("Exchange hashpartitioning(user_id") == 1
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_contraction_keeps_components(spark, monkeypatch):
    """Edges dealt anyhow and contracted a few at a time give the components of the whole graph."""
    monkeypatch.setattr(components, "CHUNK", 50)
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(400) if i % 37] + [(rng.randrange(1000, 1300), rng.randrange(1000, 1300)) for _ in range(140)]
    rng.shuffle(edges)
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    table = spark.createDataFrame(edges, "a bigint, b bigint").repartition(5)
    got = {r["node"]: r["component"] for r in connected_components(table).collect()}
    assert got == {v: find(v) for v in root if any(v in e and e[0] != e[1] for e in edges)}


@pytest.mark.parametrize("name", ["dhash_near_duplicates", "cluster_sites", "iou_pairs", "greedy_match_rows", "threshold_sweep", "ensemble_modes", "polarity_sweep"])
def test_no_pairwise_joins(spark, name):
    from sweepframe.catalog import QUERIES

    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_places_of_small_passes_are_dealt_by_pass(spark):
    """One shuffle by pass and one by place; it was more than ten, and two stored tables."""
    from sweepframe.catalog import QUERIES

    text = plan(QUERIES["cluster_sites"](spark, SF))
    assert text.count("Exchange hashpartitioning") <= 2 and "pinned-" not in text


def test_filters_and_columns_reach_the_scan(spark):
    from sweepframe.catalog import QUERIES

    text = plan(QUERIES["carry_forward"](spark, SF))
    assert "props" not in text.split("ReadSchema")[1].split("\n")[0]
    text = plan(QUERIES["hard_negative_pick"](spark, SF))
    assert "EqualTo(o_orderstatus,P)" in text


def test_lake_reads_prune_folders(spark, tmp_path):
    lake = str(tmp_path / "lake")
    samples = spark.range(6).select(
        F.when(F.col("id") % 2 == 0, "dvl").otherwise("ins").alias("stream"), F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("clip"),
        F.col("id").cast("double").alias("t"))
    artifacts.write_stream(samples, lake)
    one = artifacts.read_stream(spark, lake, "dvl", "c0")
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(clip" in plan(one)
    assert artifacts.telemetry_streams(spark, lake) == ["dvl", "ins"]
