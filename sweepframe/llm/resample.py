"""Operator 7: quality by importance resampling.

A document's weight is the likelihood ratio of two hashed n-gram models, one of trusted text and one
of the whole corpus. Keys ``log weight + Gumbel noise`` are drawn from a seeded hash, and the
``k`` largest keys are a sample without replacement in proportion to the weights.

The ratio is taken per n-gram and counted as that of a passage of ``PASSAGE`` n-grams, or long
documents would have weights that nothing else can reach. The k-th largest key is found from the
sizes of range partitions; only the partition that holds it is ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ngrams
from .common import AT, located, on_files, store

PASSAGE = 200
SHARE = 0.5
SEED = 29


def gumbel(seed: int, *keys: Column | str) -> Column:
    """Standard Gumbel noise from a hash of ``keys``: the same on every run."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def importance(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None) -> DataFrame:
    """``__at, doc_id, n_grams, log_ratio, log_weight`` for every row.

    The target is made of labelled rows of quality 1 that aren't toxic; ``held_out``, a condition on
    the labels' ``doc_id``, leaves rows out of it. A null or empty text has no n-grams and ratio 0,
    as everything has if no row is trusted. Rows are named by place, so repeated rows are weighed
    each; an empty table gives no rows, other columns are ignored.
    """
    trusted = (F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    if held_out is not None:
        trusted &= ~held_out
    docs = on_files(docs)
    sums = ngrams.word_sums(docs, labels, trusted, doc_id, text)
    rows = located(docs, F.col(doc_id).alias("doc_id")).withColumn("place", ngrams.place()).join(sums, "place", "left")
    ratio = F.coalesce(F.col("log_sum") / F.col("n_grams"), F.lit(0.0))
    return rows.select(AT, "doc_id", F.coalesce("n_grams", F.lit(0)).alias("n_grams"), ratio.alias("log_ratio"), (ratio * PASSAGE).alias("log_weight"))


def top_k(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """``rows`` with ``picked``: whether the row is among the first ``k`` in ``order`` (a total order)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunked = store(rows.repartitionByRange(parts, *order).withColumn("__chunk", F.spark_partition_id()), "ranges")
    sizes = {r["__chunk"]: r["n"] for r in chunked.groupBy("__chunk").agg(F.count(F.lit(1)).alias("n")).collect()}
    edge, left = None, k
    for chunk in sorted(sizes):
        edge = chunk
        if left < sizes[chunk]:
            break
        left -= sizes[chunk]
    else:
        return chunked.drop("__chunk").withColumn("picked", F.lit(True))
    whole = chunked.where(F.col("__chunk") != edge).withColumn("picked", F.col("__chunk") < edge)
    rank = F.row_number().over(Window.partitionBy("__chunk").orderBy(*order))
    split = chunked.where(F.col("__chunk") == edge).withColumn("picked", rank <= left)
    return whole.unionByName(split).drop("__chunk")


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, seed: int = SEED,
             held_out: Column | None = None) -> DataFrame:
    """``importance`` with ``gumbel_key`` and ``picked``: ``round(share * rows)`` rows are picked.

    Noise is drawn from the identifier and the row's number in its file, so rows of a file that share
    an identifier draw each their own, and a table that moves draws the same. Of equal keys the smaller
    identifier wins, then the first place. An empty table gives no rows.
    """
    scored = importance(docs, labels, doc_id, text, held_out)
    keyed = store(scored.withColumn("gumbel_key", F.col("log_weight") + gumbel(seed, "doc_id", f"{AT}.row")), "keyed")
    k = round(share * keyed.count())
    return top_k(keyed, k, [F.col("gumbel_key").desc(), F.col("doc_id"), F.col(AT)])


def op7_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return resample(docs, labels).drop(AT)
