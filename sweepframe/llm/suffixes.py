"""Operator 4: repeated byte strings by suffix arrays with two-stage sorting.

Regions (see ``regions``) that share an anchor are put into one block of text. Its suffix array is
built in two stages: suffixes smaller than their successors are sorted directly, all others are
induced from them by scans of the buckets of their first character. Common prefixes of neighbours in
the array then show which windows occur more than once.

Orders are exact to ``depth`` characters, which is all that is asked of them: suffixes that agree in
as many stay next to one another.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import regions
from .common import store
from .regions import ByteUnits

LENGTH = 400
#: Characters of a block; it holds whole groups of regions, at least one.
BLOCK_CHARS = 1 << 19


def suffix_array(text: str, depth: int, wanted: np.ndarray | None = None) -> list[int]:
    """Places of the suffixes of ``text`` (characters below 256) in the order of their first ``depth`` characters.

    ``wanted`` marks the places asked for; the result holds them and those needed to induce them:
    from each wanted place on, up to the next suffix that is sorted directly. A run of one character
    is as its end; the last suffix counts as larger than what would follow.
    """
    n = len(text)
    if not n:
        return []
    of = text.encode("latin-1")
    codes = np.frombuffer(of, np.uint8)
    # smaller[i]: suffix i is smaller than suffix i + 1.
    step = np.sign(np.diff(codes.astype(np.int16), append=np.int16(-1)))
    unequal = np.flatnonzero(step)
    smaller = step[unequal[np.searchsorted(unequal, np.arange(n))]] > 0
    if wanted is None:
        kept = np.ones(n, bool)
    else:
        # Stretches of larger suffixes end at a smaller one (or at the end of the text): keep the
        # part of each stretch that starts at a wanted place.
        stretch = np.concatenate(([0], np.cumsum(smaller)[:-1]))
        first = np.full(stretch[-1] + 1, n, np.int64)
        np.minimum.at(first, stretch[wanted], np.flatnonzero(wanted))
        kept = np.arange(n) >= first[stretch]
    places = np.flatnonzero(kept)

    # Stage one: direct sort.
    direct = sorted(places[smaller[places]].tolist(), key=lambda i: text[i:i + depth])
    # Buckets by first character: induced suffixes come first, those sorted directly last.
    sizes = np.bincount(codes[places], minlength=256)
    ends = np.cumsum(sizes)
    heads = (ends - sizes).tolist()
    array = [-1] * len(places)
    tails = (ends - np.bincount(codes[places[smaller[places]]], minlength=256)).tolist()
    for i in direct:
        b = of[i]
        array[tails[b]] = i
        tails[b] += 1
    # Stage two: scan from the left. The suffix before a placed one, if larger than it, is the next of its bucket.
    induced = (kept & ~smaller).tolist()
    if induced[n - 1]:
        last = of[n - 1]
        array[heads[last]] = n - 1
        heads[last] += 1
    for at in range(len(array)):
        i = array[at] - 1
        if i >= 0 and induced[i]:
            b = of[i]
            array[heads[b]] = i
            heads[b] += 1
    return array


def repeated_starts(parts: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For ``(data, windows)`` of each region, which of its first ``windows`` windows occur elsewhere among them."""
    chars, owner, base = [], [], []
    at = 0
    for data, windows in parts:
        base.append(at)
        # Nothing stands between regions: a wanted window ends within its own.
        chars.append(data.decode("latin-1"))
        owner.append(np.arange(len(data)) < windows)
        at += len(data)
    text, owned = "".join(chars), np.concatenate(owner)
    array = np.array(suffix_array(text, length, owned), np.int64)
    array = array[owned[array]]
    hits = np.zeros(len(text), bool)
    places = array.tolist()
    # Neighbours whose common prefix has the whole length.
    same = np.fromiter((text[a:a + length] == text[b:b + length] for a, b in zip(places, places[1:])), bool, max(len(places) - 1, 0))
    hits[array[:-1][same]] = True
    hits[array[1:][same]] = True
    return [hits[b:b + windows] for b, (_, windows) in zip(base, parts)]


def runs_of(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b - a)) for a, b in edges.reshape(-1, 2)]


def compare(batches, length: int):
    """Rows ``anchor, content, windows, data`` sorted by anchor to runs of repeated windows."""
    group: list[tuple] = []
    block: list[tuple] = []
    size = 0

    def flush():
        out = [[] for _ in range(4)]
        flags = repeated_starts([(r[3], r[2]) for r in block], length)
        for r, f in zip(block, flags):
            for start, n in runs_of(f):
                for c, v in zip(out, (r[0], r[1], start, n)):
                    c.append(v)
        block.clear()
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())],
                                          names=["anchor", "content", "first", "n"])

    def close():
        nonlocal size
        if len(group) > 1:  # a text alone has nothing to meet
            block.extend(group)
            size += sum(len(r[3]) for r in group)
        group.clear()

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if group and row[0] != group[0][0]:
                close()
                if size >= BLOCK_CHARS:
                    yield flush()
                    size = 0
            group.append(row)
    close()
    if block:
        yield flush()


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``file, row, doc_id, packed, runs`` for every row, ``packed`` the compressed text; runs are ``(start, windows)`` of strings of ``length``
    bytes that also start elsewhere, null for none."""
    units = ByteUnits(length)
    rows = regions.numbered(docs, doc_id, text)
    texts = regions.packed(rows)
    found = regions.repeated(rows, units, keep=False)
    at = lambda df, *more: df.select("file", "row", F.explode("starts").alias("start"), *more)

    whole = at(found.where("copies > 1"), "windows")
    # Contents that share an anchor with others are compared; of equal ones, one stands for all.
    heads = found.where("head and not alone")
    once = heads.where("copies = 1")
    cuts = store(regions.cut_out(texts, heads, units, F.col("size") > regions.LARGE), "cuts")
    met = cuts.where(F.col("data").isNotNull()).select("anchor", "content", "windows", "data")
    met = met.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        lambda batches: compare(batches, length), "anchor bigint, content bigint, first int, n int")
    single = cuts.where(F.col("key").isNotNull())
    twice = single.groupBy("key", "check").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = met.unionByName(single.join(twice, ["key", "check"]).select("anchor", "content", F.col("part").alias("first"), F.lit(1).alias("n")))
    runs = met.join(once, ["anchor", "content"]).select("file", "row", (F.get("starts", F.lit(0)) + F.col("first")).alias("start"), F.col("n").alias("windows"))
    out = whole.unionByName(runs)
    per_text = out.groupBy("file", "row").agg(F.collect_list(F.struct("start", "windows")).alias("runs"))
    return texts.join(per_text, ["file", "row"], "left")


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, kept`` for every row.

    ``spans`` are the maximal stretches ``(start, end)`` of bytes covered by strings of ``length`` bytes
    that start more than once in the table, the same row included; ``kept`` are the other bytes. A
    null text is empty. Repeated rows repeat each other. An empty table gives no rows; other columns
    are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"

    def remove(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                few = batch.slice(lo, 64)
                sizes, removed, spans, kept = [], [], [], []
                for value, runs in zip(few.column(1), few.column(2)):
                    data = regions.unpacked(value.as_py())
                    cut = regions.covered([(r["start"], r["windows"]) for r in runs.as_py() or ()], length)
                    left, at = [], 0
                    for a, b in cut:
                        left.append(data[at:a])
                        at = b
                    left.append(data[at:])
                    sizes.append(len(data))
                    removed.append(sum(b - a for a, b in cut))
                    spans.append([{"start": a, "end": b} for a, b in cut])
                    kept.append(b"".join(left))
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return repeats(docs, doc_id, text, length).select("doc_id", "packed", "runs").mapInArrow(remove, schema)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: SHA-256 of what is left of 800 hexadecimal digits (400 bytes) at every byte of every text.
ORACLE = """
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS k
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM t WHERE length(h) >= 800)
), hit AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM w) WHERE n > 1
), s AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 400 THEN 0 ELSE 1 END AS fresh FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY doc_id, g.g),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS h FROM gaps JOIN t USING (doc_id) GROUP BY doc_id
), n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, CAST(length(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
