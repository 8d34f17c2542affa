"""Operator 3: quality rules, and a log-likelihood ratio between trusted and raw text.

The rules are DataFrame expressions over one row: words, lines and windows are arrays of that row, so
a row costs what its own text costs. The ratio comes from ``ngrams``, whose counts are numpy in tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ngrams
from .common import SPACE, located, on_files, text_of, words_of

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Lowest mean weight per n-gram of a document that stays.
THRESHOLD = -0.5


def _windows(hashes: Column) -> Column:
    """A hash of each five neighbouring words."""
    at = lambda i, k: F.get(hashes, i + k)
    last = F.size(hashes) - WINDOW
    return F.when(last >= 0, F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)])
    )).otherwise(F.array().cast("array<bigint>"))


def _covered() -> tuple[Column, Column]:
    """``(ranked, words inside windows that recur)``, from the columns ``windows`` and ``ranked``.

    Windows are sorted by (hash, place); those equal to a neighbour recur, and the stretches they
    cover are added up from left to right without counting a word twice.
    """
    ranked = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, j: F.coalesce(F.get("ranked", j)["h"] == x["h"], F.lit(False))
    again = F.sort_array(F.transform(F.filter("ranked", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    total = F.aggregate(
        again, start,
        lambda s, i: F.struct((s["n"] + WINDOW - F.greatest(s["end"] - i, F.lit(0))).alias("n"), (i + WINDOW).alias("end")),
        lambda s: s["n"],
    )
    return ranked, total


def rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, words, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    whole = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(SPACE.replace("[", "[^")))
    cut = whole.select(
        "doc_id", words_of(F.col("text")).alias("words"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"), lines.alias("lines"),
    )
    hashed = cut.select(
        "doc_id", "words", F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    seen = hashed.select("doc_id", "words", "word_chars", "n_symbols", "n_dup_lines", _windows(F.col("hashes")).alias("windows"))
    ranked, total = _covered()
    recurs = F.size(F.array_distinct("windows")) < F.size("windows")
    counted = seen.withColumn("ranked", F.when(recurs, ranked)).select(
        "doc_id", "words", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("ranked").isNull(), F.lit(0).cast("long")).otherwise(total).alias("n_repeat_words"),
    )
    return counted.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def quality_rules(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``rules`` but the words, with ``log_ratio`` (mean weight per n-gram) and ``kept``.

    The target is made of labelled rows of quality 1, the raw side of every row of ``docs``, by
    ``ngrams.word_sums``. A null or empty text has no words, ratio 0 and fails the base rules; without
    trusted rows all ratios are 0. Rows are named by place: those that repeat one another or share an
    identifier are judged each. An empty table gives no rows; other columns are ignored.
    """
    docs = on_files(docs)
    named = located(docs, F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select(
        F.struct("doc_id", ngrams.place().alias("place")).alias("key"), "text")
    base = rules(named, "key").drop("words").withColumnRenamed("doc_id", "key").withColumn("place", F.col("key.place"))
    sums = ngrams.word_sums(docs, labels, F.col("quality") == 1, doc_id, text)
    ratio = F.coalesce(F.col("log_sum") / F.col("n_grams"), F.lit(0.0))
    kept = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    scored = base.join(sums, "place", "left").select("key.doc_id", *kept, ratio.alias("log_ratio"))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("log_ratio") >= threshold))


def quality_by_words(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, log_ratio`` of every row, as in ``quality_rules``, whose rules are left out."""
    docs = on_files(docs)
    sums = ngrams.word_sums(docs, labels, F.col("quality") == 1, doc_id, text)
    rows = located(docs, F.col(doc_id).alias("doc_id")).withColumn("place", ngrams.place()).join(sums, "place", "left")
    return rows.select("doc_id", F.coalesce(F.col("log_sum") / F.col("n_grams"), F.lit(0.0)).alias("log_ratio"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(docs, labels)
