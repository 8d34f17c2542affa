"""Operator 8: repeated phrases by sharded Aho-Corasick automata.

Candidate passages are found by anchors (see ``regions``): all regions that share an anchor go to one
shard. A shard confirms which windows of thirteen words recur in texts with different identifiers,
compiles them into an automaton whose values are the smallest identifiers, and streams its regions
through it to locate every occurrence. Every region of every document is streamed through the one
shard that can hold its passages, so documents and shards both grow without meeting all pairs.

An automaton works on characters. A shard numbers its words and writes each as one character.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import regions
from .common import store
from .regions import WordUnits
from .suffixes import runs_of

LENGTH = 13
#: Words of a shard's block: one automaton is compiled from it.
BLOCK_WORDS = 1 << 17


def _letter(number: int) -> str:
    """A character for a word; surrogates are left out."""
    return chr(number + 1 if number + 1 < 0xD800 else number + 0x801)


def locate(parts: list[tuple[bytes, int, int]], length: int) -> list[np.ndarray]:
    """For ``(text, windows, identifier)`` of each region, which windows occur under a smaller identifier."""
    numbers: dict[bytes, int] = {}
    lines = ["".join([_letter(numbers.setdefault(w, len(numbers))) for w in text.split(b" ")]) for text, _, _ in parts]
    least: dict[str, int] = {}
    most: dict[str, int] = {}
    for line, (_, windows, doc_id) in zip(lines, parts):
        for i in range(windows):
            w = line[i:i + length]
            known = least.get(w)
            if known is None:
                least[w] = most[w] = doc_id
            elif doc_id < known:
                least[w] = doc_id
            elif doc_id > most[w]:
                most[w] = doc_id
    automaton = ahocorasick.Automaton()
    for w, first in least.items():
        if first != most[w]:
            automaton.add_word(w, first)
    out = [np.zeros(windows, bool) for _, windows, _ in parts]
    if not len(automaton):
        return out
    automaton.make_automaton()
    for line, (_, windows, doc_id), flags in zip(lines, parts, out):
        for end, first in automaton.iter(line):
            start = end - length + 1
            if start < windows and first < doc_id:
                flags[start] = True
    return out


def scan(batches, length: int):
    """Rows ``anchor, content, windows, data, least`` sorted by anchor to runs of located windows."""
    group: list[tuple] = []
    block: list[tuple] = []
    size = 0

    def flush():
        out = [[] for _ in range(4)]
        for r, flags in zip(block, locate([(r[3], r[2], r[4]) for r in block], length)):
            for start, n in runs_of(flags):
                for c, v in zip(out, (r[0], r[1], start, n)):
                    c.append(v)
        block.clear()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())],
                                          names=["anchor", "content", "first", "n"])

    def close():
        nonlocal size
        if len(group) > 1:
            block.extend(group)
            size += sum(r[2] + length for r in group)
        group.clear()

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if group and row[0] != group[0][0]:
                close()
                if size >= BLOCK_WORDS:
                    yield flush()
                    size = 0
            group.append(row)
    close()
    if block:
        yield flush()


def phrases(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``file, row, doc_id, packed, runs`` for every row, ``packed`` the compressed text; runs are ``(start, windows)`` of word windows that also
    start in a row with a smaller identifier, null for none. A null identifier counts as the largest."""
    units = WordUnits(length)
    rows = regions.numbered(docs, doc_id, text)
    texts = regions.packed(rows)
    ranked = rows.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    found = regions.repeated(ranked, units, keep=False).where("later")

    whole = found.where("doc_id > least").select("file", "row", F.explode("starts").alias("start"), "windows")
    heads = found.where("head and not alone")
    few = regions.cut_out(texts, heads.where(F.col("size") <= regions.LARGE), units, F.lit(False))
    least = heads.select("anchor", "content", "least")
    met = few.join(least, ["anchor", "content"]).select("anchor", "content", "windows", "data", "least")
    met = met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        lambda batches: scan(batches, length), "anchor bigint, content bigint, first int, n int")
    large = heads.where(F.col("size") > regions.LARGE)
    if not large.isEmpty():
        single = regions.cut_out(texts, large, units, F.lit(True)).drop("windows", "data")
        single = store(single.join(least, ["anchor", "content"]), "windows")
        first = single.groupBy("key", "check").agg(F.min("least").alias("owner"))
        hits = single.join(first, ["key", "check"]).where("owner < least")
        met = met.unionByName(hits.select("anchor", "content", F.col("part").alias("first"), F.lit(1).alias("n")))
    firsts = found.where("doc_id = least and not alone").select("anchor", "content", "file", "row", F.explode("starts").alias("start"))
    located = met.join(firsts, ["anchor", "content"]).select("file", "row", (F.col("start") + F.col("first")).alias("start"), F.col("n").alias("windows"))
    out = whole.unionByName(located)
    per_text = out.groupBy("file", "row").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    return texts.join(per_text, ["file", "row"], "left")


def phrase_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept`` for every row.

    ``spans`` are the stretches ``(start, end)`` of words covered by windows of ``length`` words that also
    start in a row with a smaller identifier; ``kept`` are the other words, joined by one space. A null
    text has no words. Rows that share an identifier don't remove one another's words; null counts as
    the largest identifier. An empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept string"

    def remove(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                few = batch.slice(lo, 64)
                sizes, removed, spans, kept = [], [], [], []
                for value, runs in zip(few.column(1), few.column(2)):
                    words = regions.unpacked(value.as_py()).split()
                    cut = regions.covered([(r["start"], r["windows"]) for r in runs.as_py() or ()], length)
                    left, at = [], 0
                    for a, b in cut:
                        left += words[at:a]
                        at = b
                    left += words[at:]
                    sizes.append(len(words))
                    removed.append(sum(b - a for a, b in cut))
                    spans.append([{"start": a, "end": b} for a, b in cut])
                    kept.append(b" ".join(left).decode())
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "spans", "kept"])

    return phrases(docs, doc_id, text, length).select("doc_id", "packed", "runs").mapInArrow(remove, schema)


def op8_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM x) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(13) AS r(j)),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM t),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
