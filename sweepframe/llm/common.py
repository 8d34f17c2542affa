"""What several operators on document tables share: words, row locators, stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..plans.durable import shared_folder

#: The white space of every contract, as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"
#: The same set for bytes.split(), which cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Name of the locator column that operators add; dropped before rows are returned.
AT = "__at"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def store(df: DataFrame, kind: str = "llm") -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends, lost executors cost nothing.

    What the write shuffled is removed with its end, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = new_folder(spark, kind)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def on_files(docs: DataFrame) -> DataFrame:
    """``docs`` if it is a plain read of files, else a stored copy: its rows have lasting places."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return store(docs, "rows")


def located(docs: DataFrame, *columns: Column | str) -> DataFrame:
    """``columns`` of ``docs`` with ``__at``, the place (file, row) of each row.

    A place names a row for good, so null or repeated identifiers do no harm.
    """
    docs = on_files(docs)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(AT)
    return docs.select(*(columns or [F.col(c) for c in docs.columns]), at)


def text_of(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text, SPACE + "+", "")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; an array, empty for an empty text."""
    return F.array_remove(F.split(text, SPACE + "+"), "")
