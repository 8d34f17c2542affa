"""Operator 10: mixing sources to target weights by Sainte-Lague apportionment.

1. Every source gets a target in words: the sources' weights share the size of the mix, and no
   target exceeds ``most`` times its source (a water level over the sources' own totals).
2. Blocks of ``block_words`` words are allocated to sources by highest quotients
   ``target / (2 * blocks + 1)``; within a source the same rule splits its blocks among shards, in
   proportion to the shards' words, so each shard has an integer quota of its own.
3. A shard lays its documents on a line in seeded order and cuts it into blocks. A quota of ``q``
   blocks over ``n`` takes every block ``q div n`` times and the ``q mod n`` first blocks of a
   seeded order once more.

Shards have a bounded number of words, so a source with a third of all rows is many shards, and no
window holds more than one shard. Sources are rows of a table throughout, never lists on the driver.
All expressions are native.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import AT, SPACE, WORD, located, on_files, store, text_of

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK_WORDS = 64
SHARD_WORDS = 1 << 20
SEED = 41


def _seeded(seed: int, *keys: Column | str) -> Column:
    """A hash that SQL engines share: the md5 of the keys as text."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("")) for k in keys]))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Weights repeat over the sources in code-point order, null last. The excess of sources that reach
    their limit is shared among the others by weight until none is above: the level at which the
    limits and the shares add up to the mix.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    # In order of limit / weight, the first k sources stand at their limit and the others share the rest.
    tight = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "source", "source_size", "weight", "limit",
        ((F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
         / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("level"),
    )
    # The level of the first source whose limit is above it holds for all sources from there on.
    free = F.min(F.when(F.col("level") * F.col("weight") < F.col("limit"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(every)
    return rows.select(
        "source", "source_size",
        F.when(free.isNull(), F.col("limit")).otherwise(F.least("limit", free["level"] * F.col("weight"))).alias("target"),
    )


def apportion(parts: DataFrame, group: list[str], name: list[str], wanted: str, seats: str) -> DataFrame:
    """Sainte-Lague: ``parts`` with ``quota``, integers that add up to ``seats`` in each group.

    ``wanted`` are the claims, ``seats`` a column equal within a group. Rounding every claim at the
    divisor ``sum(wanted) / seats`` is an apportionment of nearly that many seats; the missing ones go
    to the highest next quotients, surplus ones are taken from the lowest last quotients. Fewer than
    one quotient per part is needed on either side, so no seat is enumerated. Ties go by ``name``.
    """
    g = Window.partitionBy(*group)
    claim = F.col(wanted)
    share = F.when(F.sum(wanted).over(g) > 0, claim * F.col(seats) / F.sum(wanted).over(g)).otherwise(F.lit(0.0))
    rows = parts.withColumn("__first", F.ceil(share - 0.5).cast("long"))
    rows = rows.withColumn("__gap", F.when(F.sum(wanted).over(g) > 0, F.col(seats) - F.sum("__first").over(g)).otherwise(F.lit(0)).cast("long"))
    step = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.abs("__gap"), F.lit(1).cast("long"))))
    tried = rows.withColumn("__step", step)
    up = tried.where((F.col("__gap") > 0) & (claim > 0)).withColumn("__q", claim / (2 * (F.col("__first") + F.col("__step") - 1) + 1))
    down = tried.where((F.col("__gap") < 0) & (F.col("__first") >= F.col("__step"))).withColumn("__q", -claim / (2 * (F.col("__first") - F.col("__step")) + 1))
    ranked = up.unionByName(down).withColumn("__rank", F.row_number().over(g.orderBy(F.col("__q").desc(), *[F.col(n).asc_nulls_last() for n in name], "__step")))
    moved = ranked.where(F.col("__rank") <= F.abs("__gap")).groupBy(*group, *[n for n in name if n not in group]).agg(
        F.sum(F.signum("__gap")).cast("long").alias("__moved"))
    keys = list(dict.fromkeys([*group, *name]))
    left, right = rows.alias("l"), moved.alias("r")
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = left.join(right, on=same, how="left")
    return joined.select(*[F.col(f"l.{c}") for c in parts.columns], (F.col("l.__first") + F.coalesce("r.__moved", F.lit(0))).alias("quota"))


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS,
         share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """``__at, doc_id, source, size, source_size, target, whole, spans, taken`` for every row.

    ``whole`` is how many times the whole document is taken, ``spans`` lists the stretches
    ``(start, length)`` in words taken once more, ``taken`` the words in all; no document exceeds
    ``ceil(most)`` times its size. A null text has size 0 and is never taken; a null source is a
    source. Rows that repeat one another are laid out one after the other, by place. An empty table
    gives no rows; other columns are ignored.
    """
    rows = located(docs, F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"))
    rows = store(rows.withColumn("fate", _seeded(seed, "doc_id")), "sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(per_source, weights, share, most).withColumn("shards", F.ceil(F.greatest("source_size", F.lit(1)) / F.lit(shard_words)).cast("long"))
    seats = F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / F.lit(block_words)).cast("long")
    goals = store(apportion(goals.withColumn("__all", F.lit(1)).withColumn("__seats", seats), ["__all"], ["source"], "target", "__seats")
                  .select("source", "source_size", "target", "shards", F.col("quota").alias("blocks")), "goals")

    g = goals.select(F.col("source").alias("__s"), "source_size", "target", "shards", "blocks")
    dealt = rows.join(g, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn(
        "shard", F.pmod(F.conv(F.substring("fate", 1, 8), 16, 10).cast("long"), F.col("shards")))
    dealt = store(dealt, "dealt")
    per_shard = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    quotas = store(apportion(per_shard, ["source"], ["shard"], "shard_size", "blocks").select(
        "source", "shard", "shard_size", "quota", F.ceil(F.col("shard_size") / F.lit(block_words)).cast("long").alias("n_blocks")), "quotas")

    # The seeded order of a shard's blocks; as many rows as the corpus has blocks.
    cut = quotas.where("n_blocks > 0").select("source", "shard", "quota", "n_blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    turn = F.row_number().over(Window.partitionBy("source", "shard").orderBy(_seeded(seed + 1, "source", "shard", "block"), "block"))
    chosen = cut.withColumn("__turn", turn).where(F.col("__turn") <= F.pmod("quota", "n_blocks")).select("source", "shard", "block")

    line = Window.partitionBy("source", "shard").orderBy("fate", F.col("doc_id").asc_nulls_last(), AT)
    end = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    q = quotas.select(F.col("source").alias("__s"), F.col("shard").alias("__d"), "quota", "n_blocks")
    laid = dealt.withColumn("__end", end).join(q, F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__d"))).drop("__s", "__d")
    laid = store(laid.withColumn("__begin", F.col("__end") - F.col("size")).withColumn(
        "whole", F.when(F.col("n_blocks") > 0, F.expr("quota div n_blocks")).otherwise(F.lit(0)).cast("long")), "laid")
    b = F.lit(block_words).cast("long")
    touched = laid.where("size > 0 and quota % n_blocks > 0").select(
        AT, "source", "shard", "size", "__begin", "__end",
        F.explode(F.sequence(F.expr(f"__begin div {block_words}"), F.expr(f"(__end - 1) div {block_words}"))).alias("block"))
    c = chosen.select(F.col("source").alias("__s"), F.col("shard").alias("__d"), F.col("block").alias("__b"))
    # The blocks come out of an explode, whose size Spark can't foresee: never broadcast them.
    met = touched.join(c.hint("merge"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__d")) & (F.col("block") == F.col("__b")))
    begin = F.greatest("__begin", F.col("block") * b)
    span = F.struct((begin - F.col("__begin")).alias("start"), (F.least("__end", (F.col("block") + 1) * b) - begin).alias("length"))
    spans = met.groupBy(AT).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    found = laid.join(spans, AT, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,length:bigint>>")))
    extra = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return found.select(AT, "doc_id", "source", "size", "source_size", "target", "whole", "spans", (F.col("whole") * F.col("size") + extra).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """The mix itself: ``docs`` with every document repeated as often as it is taken whole, and the
    stretches taken once more as one row of their words (joined by one space)."""
    docs = on_files(docs)
    rows = located(docs)
    chosen = plan(docs, doc_id, text, source, **settings).where("taken > 0").select(F.col(AT).alias("__place"), "whole", "spans")
    met = rows.join(chosen, F.col(AT) == F.col("__place"))
    whole = met.where("whole > 0").withColumn("__n", F.explode(F.expr("sequence(1L, whole)"))).select(*docs.columns)
    words = F.filter(F.split(text_of(text), SPACE + "+"), lambda w: w != "")
    piece = F.concat_ws(" ", F.flatten(F.transform("spans", lambda s: F.slice(F.col("__words"), (s["start"] + 1).cast("int"), s["length"].cast("int")))))
    # Named twice, the words are split once a document; else Spark would put the split into the lambda.
    part = met.where(F.size("spans") > 0).withColumn("__words", words).withColumn("__piece", F.when(F.size("__words") > 0, piece))
    part = part.select(*[F.col("__piece").alias(text) if c == text else F.col(c) for c in docs.columns])
    return whole.unionByName(part)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


#: The same mix from whole lists of quotients, which the operator never writes out.
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws('|', '{SEED}', CAST(doc_id AS VARCHAR))) AS fate
  FROM documents
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, [{", ".join(str(w) for w in WEIGHTS)}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight, {MOST} * source_size AS top FROM s0
), s2 AS (
  SELECT *, ({SHARE} * sum(source_size) OVER () - coalesce(sum(top) OVER low, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER low, 0)) AS level
  FROM s1 WINDOW low AS (ORDER BY top / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), s AS (
  SELECT source, source_size, least(top, weight * coalesce(min_by(level, top / weight) FILTER (level * weight < top) OVER (), 1e300)) AS target,
    CAST(ceil(greatest(source_size, 1) / {SHARD_WORDS}) AS BIGINT) AS shards
  FROM s2
), quotient AS (
  SELECT source, target / (2 * j + 1) AS q, j FROM (SELECT *, unnest(range(0, CAST(target / {BLOCK_WORDS} + 2 AS BIGINT))) AS j FROM s)
), seat AS (
  SELECT source, row_number() OVER (ORDER BY q DESC, source NULLS LAST, j) AS nth FROM quotient
), blocks AS (
  SELECT source, count(*) AS blocks FROM seat WHERE nth <= (SELECT round(sum(target) / {BLOCK_WORDS}) FROM s) GROUP BY source
), dealt AS (
  SELECT d.*, source_size, target, CAST('0x' || substr(fate, 1, 8) AS BIGINT) % shards AS shard FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), shard AS (
  SELECT source, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM dealt GROUP BY source, shard
), shard_seat AS (
  SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY shard_size / (2 * j + 1) DESC, shard, j) AS nth
  FROM (SELECT *, unnest(range(0, CAST({MOST} * shard_size / {BLOCK_WORDS} + 3 AS BIGINT))) AS j FROM shard WHERE shard_size > 0)
), quota AS (
  SELECT h.source, h.shard, CAST(ceil(any_value(h.shard_size) / {BLOCK_WORDS}) AS BIGINT) AS n_blocks, count(b.blocks) AS quota
  FROM shard h LEFT JOIN shard_seat t ON t.source IS NOT DISTINCT FROM h.source AND t.shard = h.shard
  LEFT JOIN blocks b ON b.source IS NOT DISTINCT FROM h.source AND t.nth <= b.blocks
  GROUP BY h.source, h.shard
), chosen AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY source, shard ORDER BY md5(concat_ws('|', '{SEED + 1}', coalesce(source, ''), CAST(shard AS VARCHAR), CAST(block AS VARCHAR))), block) AS turn
    FROM (SELECT *, unnest(range(0, n_blocks)) AS block FROM quota)
  ) WHERE turn <= quota % n_blocks
), line AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source, shard ORDER BY fate, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM dealt
), extra AS (
  SELECT doc_id, sum(least(e, (block + 1) * {BLOCK_WORDS}) - greatest(e - size, block * {BLOCK_WORDS})) AS n
  FROM line l JOIN chosen c ON c.source IS NOT DISTINCT FROM l.source AND c.shard = l.shard
    AND c.block * {BLOCK_WORDS} < e AND (c.block + 1) * {BLOCK_WORDS} > e - size
  GROUP BY doc_id
)
SELECT l.doc_id, size, source_size, round(target, 6) AS target,
  CAST(CASE WHEN n_blocks > 0 THEN quota // n_blocks * size ELSE 0 END + coalesce(n, 0) AS BIGINT) AS taken
FROM line l JOIN quota q ON q.source IS NOT DISTINCT FROM l.source AND q.shard = l.shard LEFT JOIN extra USING (doc_id)
"""
