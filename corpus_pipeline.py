"""Five stages from documents to packed sequences; each is written as Parquet and read by the next.

All stages but the last return the columns of ``documents``. A stage's decisions take effect: rows it
rejects, or that others stand for, are gone from what the next stage sees.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sweepframe.llm import exact, langid, mixing, packing, similar
from sweepframe.llm.common import store

#: Lowest mean probability of a language that counts as identified.
MIN_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified: those without a letter, or like no language learned, go.

    So null, empty and wordless texts go. Each row is judged by its text alone: repeated rows stay or go
    together, whatever their identifiers. Nothing is learned from rows with a null ``lang``.
    """
    judged = langid.language(docs, langid.train(docs), lang_pred="__lang", score="__score")
    return judged.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= MIN_SCORE)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space.

    The longest text stays, then the smallest ``doc_id`` (null last), then the first row; null counts as
    an empty text, and all texts of white space are one group.
    """
    return exact.keep_first(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

    The smallest ``doc_id`` stays (null last), then the first row. Null, empty and wordless texts are one
    component; repeated rows are one text.
    """
    return similar.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; stretches taken once more are rows of their own.

    A null source is a source of its own, the last. Texts without words have size 0 and aren't taken.
    Rows are taken by their place, so repeated or null identifiers do no harm.
    """
    return mixing.mix(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; a null or empty text is the end id alone, repeated rows are packed each."""
    return packing.pack(docs).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages hash, learn and tokenize by means that SQL lacks; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
