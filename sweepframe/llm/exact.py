"""Operator 6: exact duplicates by stateful streaming, with state on disk and no expiry.

An index of the table (digest, identifier, length, place) is streamed through a keyed aggregation
whose state lives in RocksDB. The state of a digest holds how many rows it has, the identifier of
the row that stays and the place of its content; it never expires, so a later run over new files
may go on from the same folder. Afterwards the state is read as a table. Rows whose digest was hit
more than once are compared by their full bytes with the row that stays; a digest shared by
different texts is regrouped by the texts themselves.

Only DataFrame operations and Structured Streaming are used. Partial sums are made before rows
move, so a text that a third of all rows share is one row per task. The text itself moves once, to
the rows that are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AT, located, new_folder, on_files, squeezed, store, text_of

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: An executor may hold hundreds of stores: no megabytes set aside for the log of each, and one bound
#: on the memory of all of them together.
ROCKS_CONF = "spark.sql.streaming.stateStore.rocksdb."
SETTINGS = {
    PROVIDER: ROCKS, ROCKS_CONF + "allowFAllocate": "false", ROCKS_CONF + "boundedMemoryUsage": "true", ROCKS_CONF + "maxMemoryUsageMB": "256",
    ROCKS_CONF + "writeBufferSizeMB": "2",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rank(size: Column, doc_id: Column, at: Column) -> Column:
    """Smallest first: most code points, then smallest identifier (null last), then place."""
    return F.struct((-size).alias("less"), doc_id.isNull().alias("unnamed"), doc_id.alias("doc_id"), at.alias("at"))


def absorb(spark: SparkSession, index_path: str, schema, state_path: str) -> DataFrame:
    """Stream the index files that weren't seen yet into the state; the whole state as a table."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).parquet(index_path)
        keyed = stream.groupBy("digest").agg(
            F.count(F.lit(1)).alias("n"), F.min(_rank(F.col("size"), F.col("doc_id"), F.col("at"))).alias("best")
        )
        run = (
            keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_path)
            .trigger(availableNow=True).start()
        )
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(state_path)
    held = [f.name for f in state.schema["value"].dataType.fields]
    return state.select(
        F.col("key.digest").alias("digest"), F.col("value")[held[0]].alias("n"), F.col("value")[held[1]].alias("best")
    )


def exact_dedup(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256,
    state_path: str | None = None,
) -> DataFrame:
    """``__at, doc_id, keep_id, keep_at, group_size, kept, text_sha256`` for every row.

    Texts are equal if they are identical without white space; null counts as empty, so all null,
    empty and blank texts form one group. The row with the most code points stays, then the smallest
    ``doc_id`` (null last), then the first place: exactly one row of a group has ``kept``, also among
    rows that repeat one another. An empty table gives no rows; other columns are ignored.
    ``digest`` may be any function of the squeezed text, since hits are compared by content.
    """
    spark = docs.sparkSession
    rows = located(docs, F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    squeeze = squeezed(F.col("text"))
    index = store(rows.select(
        "doc_id", F.col(AT).alias("at"), F.length("text").cast("long").alias("size"), digest(squeeze).alias("digest"),
        F.sha2(squeeze, 256).alias("text_sha256"),
    ), "index")
    if index.isEmpty():
        state = spark.createDataFrame([], "digest binary, n bigint, best struct<less:bigint,unnamed:boolean,doc_id:bigint,at:struct<file:string,row:bigint>>")
        state = state.withColumn("digest", F.col("digest").cast(index.schema["digest"].dataType))
    else:
        source = index.inputFiles()[0].rsplit("/", 1)[0]
        state = absorb(spark, source, index.schema, state_path or new_folder(spark, "state"))
    groups = store(state, "groups")

    hits = index.join(groups.where("n > 1"), "digest").select("at", "digest", F.col("best.at").alias("first"))
    texts = rows.select(F.col(AT).alias("at"), squeeze.alias("content")).join(hits, "at")
    texts = store(texts, "hits")
    kept = texts.where(F.col("at") == F.col("first")).select("digest", F.col("content").alias("wanted"))
    clashing = texts.join(kept, "digest").where(F.col("content") != F.col("wanted")).select("digest").distinct()
    clashing = store(clashing, "clashes")

    named = index.join(groups, "digest").join(clashing, "digest", "left_anti").select(
        "at", "doc_id", "text_sha256", "best", F.col("n").alias("group_size"))
    if not clashing.isEmpty():
        # One digest, several texts: group these rows by what they hold.
        members = index.join(clashing, "digest", "left_semi").join(texts.select("at", "content"), "at")
        exact = members.groupBy("content").agg(
            F.count(F.lit(1)).alias("group_size"), F.min(_rank(F.col("size"), F.col("doc_id"), F.col("at"))).alias("best"))
        named = named.unionByName(members.join(exact, "content").select("at", "doc_id", "text_sha256", "best", "group_size"))
    return named.select(
        F.col("at").alias(AT), "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("best.at").alias("keep_at"), "group_size",
        (F.col("at") == F.col("best.at")).alias("kept"), "text_sha256",
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    docs = on_files(docs)
    stay = exact_dedup(docs, doc_id, text).where("kept").select(AT)
    return located(docs).join(stay, AT, "left_semi").drop(AT)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), r AS (
  SELECT doc_id, bare, count(*) OVER (PARTITION BY bare) AS group_size,
    first_value(doc_id) OVER (PARTITION BY bare ORDER BY size DESC, doc_id) AS keep_id
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM r
"""
