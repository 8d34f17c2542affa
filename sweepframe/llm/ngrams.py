"""Hashed n-gram multinomials of a trusted target and of the whole corpus, and the ratio of each text.

N-grams are whole words and pairs of neighbouring words, as 64-bit hashes; their table grows with
the corpus. What moves is never a row per n-gram, and not all at once: the hashes are cut into
``PASSES`` ranges, each range is counted and scored by itself, and its shuffles are removed before the
next. So the disk that is taken at a time is a share of what a corpus moves, and texts are read once a pass.

1. Texts become chunks of about ``CHUNK_WORDS`` words: the pass's different grams, sorted, and for each
   the texts that have it. They are named by their first place, and made again alike if they are lost.
2. Each chunk asks for its grams, cut into ranges of the hash ("parts"), one compressed array per part.
   A part adds up what all chunks have of its grams.
3. The answers go back in the order asked, so they needn't name the grams again, and meet the chunk.
4. A text's sum is that of its passes, added in their order.

A gram is one entry per chunk however common it is, so no word makes a hot part. The number of parts
follows the number of n-grams, so a part's arrays stay near ``PART_GRAMS`` entries at every size.
Where there are far more parts than a chunk has grams, arrays get short, at worst a row per gram.
A gram is the upper ``GRAM_BITS`` bits of its hash, which cuts an eighth off what is sent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import AT, located, store, text_of, words_of

ALPHA = 1.0
#: Words of a chunk; a longer text is a chunk of its own.
CHUNK_WORDS = 1 << 21
#: N-grams, repeats included, that one part stands for.
PART_GRAMS = 1 << 21
GRAM_BITS = 56
#: Ranges of the hash that are counted one after the other, if there are as many parts.
PASSES = 4
#: Trusted rows whose identifiers (8 bytes each) may be broadcast; beyond, the texts' words are joined and stored.
TARGET_ROWS = 1_000_000

CHUNK = ["chunk", "file", "row", "trusted", "lengths", "grams", "met", "texts", "n"]
ASKING = ["chunk", "trusted", "grams", "met", "texts", "n"]
_U = np.uint64


def place() -> Column:
    """``__at`` in 16 bytes."""
    return F.struct(F.xxhash64(f"{AT}.file").alias("file"), F.col(f"{AT}.row").alias("row"))


def squash(values: np.ndarray) -> bytes:
    """Compressed bytes of an array; equal bytes of neighbours lie together."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).reshape(-1)


def steps(values: np.ndarray) -> np.ndarray:
    """Differences of an ascending array, the first from zero; ``cumsum`` undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))


def grams_of(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(gram, text)`` of every word and every pair of neighbouring words within a text."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    within = text[1:] == text[:-1]
    a, b = words[:-1][within], words[1:][within]
    pair = (a * _U(0x9E3779B97F4A7C15)) ^ (b + _U(0xD1B54A32D192ED03))
    pair = (pair ^ (pair >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    pair = (pair ^ (pair >> _U(27))) * _U(0x94D049BB133111EB)
    grams = np.concatenate([words, pair ^ (pair >> _U(31))]) >> _U(64 - GRAM_BITS)
    return grams, np.concatenate([text, text[1:][within]])


def _edge(part: int, parts: int) -> int:
    """The first gram of a part."""
    return -(-(part << 32) // parts) << GRAM_BITS - 32


def _chunks(chunk_words: int, lowest: int, end: int) -> Callable:
    """Rows ``place, trusted, words`` packed into chunks named by their first place, with their grams from ``lowest`` on, below ``end``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            file, row, trusted, lengths, words = (np.concatenate(x) for x in zip(*held))
            grams, text = grams_of(words, lengths)
            wanted = (grams >= _U(lowest)) & (grams < _U(end))
            grams, which = np.unique(grams[wanted], return_inverse=True)
            pairs, n = np.unique(which * len(lengths) + text[wanted], return_counts=True)
            which, text = np.divmod(pairs, len(lengths))
            met = np.bincount(which, minlength=len(grams))
            arrays = [file, row, trusted, lengths, steps(grams), met.astype(np.int64), text.astype(np.uint32), n.astype(np.int64)]
            values = [f"{file[0]}:{row[0]}".encode(), *map(squash, arrays)]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=CHUNK)

        for batch in batches:
            at, words = batch.column("place"), batch.column("words")
            file, row = (v.to_numpy(zero_copy_only=False) for v in at.flatten())
            trusted = batch.column("trusted").to_numpy(zero_copy_only=False).astype(np.uint8)
            offsets = words.offsets.to_numpy().astype(np.int64)
            flat = words.values.to_numpy(zero_copy_only=False).view(np.uint64)
            lo = 0
            while lo < batch.num_rows:
                # As many rows as the chunk has room for, at least one.
                room = offsets[lo] + max(chunk_words - size, 0)
                hi = max(int(np.searchsorted(offsets, room, side="right")) - 1, lo + 1)
                hi = min(hi, batch.num_rows)
                lengths = np.diff(offsets[lo:hi + 1])
                if lengths.any():
                    some = lengths > 0
                    held.append((file[lo:hi][some], row[lo:hi][some], trusted[lo:hi][some], lengths[some], flat[offsets[lo]:offsets[hi]].copy()))
                size += int(lengths.sum())
                lo = hi
                if size >= chunk_words:
                    yield chunk()
                    held, size = [], 0
        if held:
            yield chunk()

    return pack


def _ask(parts: range, of: int) -> Callable:
    """The different grams of each chunk with their occurrences, in all rows and in trusted ones, by part."""

    edges = np.array([_edge(p, of) for p in parts[1:]], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, trusted, grams, met, texts, n in zip(*[batch.column(c).to_pylist() for c in ASKING]):
                grams, met, n = np.cumsum(expand(grams, np.uint64), dtype=np.uint64), expand(met, np.int64), expand(n, np.int64)
                which = np.repeat(np.arange(len(grams)), met)
                known = n * expand(trusted, np.uint8)[expand(texts, np.uint32)]
                n, t = (np.bincount(which, x, len(grams)).astype(np.int64) for x in (n, known))
                bounds = [0, *np.searchsorted(grams, edges).tolist(), len(grams)]
                some = [(p, slice(lo, hi)) for p, lo, hi in zip(parts, bounds, bounds[1:]) if hi > lo]
                yield pa.RecordBatch.from_arrays([
                    pa.array([chunk] * len(some), pa.binary()), pa.array([p for p, _ in some], pa.int32()),
                    pa.array([squash(steps(grams[s])) for _, s in some], pa.binary()),
                    pa.array([squash(n[s]) for _, s in some], pa.binary()),
                    pa.array([squash(t[s]) for _, s in some], pa.binary()),
                ], names=["chunk", "part", "grams", "n", "t"])

    return ask


def _answer(asked: pa.Table) -> pa.Table:
    """For each asking chunk, the occurrences of its grams in all chunks, in the order asked."""
    grams = [np.cumsum(expand(g.as_py(), np.uint64), dtype=np.uint64) for g in asked.column("grams")]
    different, which = np.unique(np.concatenate(grams), return_inverse=True)
    ends = np.cumsum([len(g) for g in grams])[:-1]
    totals = []
    for c in ("n", "t"):
        total = np.bincount(which, np.concatenate([expand(v.as_py(), np.int64) for v in asked.column(c)])).astype(np.int64)
        totals.append(pa.array([squash(v) for v in np.split(total[which], ends)], pa.binary()))
    return pa.table([asked.column("chunk"), asked.column("part"), *totals], names=["chunk", "part", "r", "t"])


def _score(share: float) -> Callable:
    """``place, n_grams, log_sum`` of the texts of a chunk, from the answers to it; the sum is over the chunk's grams."""

    def score(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        lengths, trusted = expand(row["lengths"], np.int64), expand(row["trusted"], np.uint8)
        answers = sorted(answers.select(["part", "r", "t"]).to_pylist(), key=lambda a: a["part"])
        if share and answers:
            r, t = (np.concatenate([expand(a[c], np.int64) for a in answers]) for c in ("r", "t"))
            which = np.repeat(np.arange(len(r)), expand(row["met"], np.int64))
            text, n = expand(row["texts"], np.uint32), expand(row["n"], np.int64)
            known = n * trusted[text]
            weight = n * np.log((t[which] - known + ALPHA * share) / (share * (r[which] - n + ALPHA)))
            total = np.bincount(text, weight, len(lengths))
        else:
            total = np.zeros(len(lengths))
        at = pa.StructArray.from_arrays([pa.array(expand(row[c], np.int64)) for c in ("file", "row")], ["file", "row"])
        return pa.table([at, pa.array(2 * lengths - 1), pa.array(total)], names=["place", "n_grams", "log_sum"])

    return score


def word_sums(docs: DataFrame, labels: DataFrame, wanted: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``place, n_grams, log_sum`` of the rows of ``docs`` (a read of files) that have words.

    Whole words and pairs of them count by 64-bit hash. A gram's weight in a row is
    ``ln((t + ALPHA * s) / (s * (r + ALPHA)))``, with ``t`` and ``r`` its occurrences in trusted rows
    and in all rows, both without those of the row itself, and ``s`` the trusted share of all grams.
    So what only this row has weighs nothing, and trusted rows are judged as held-out ones. All
    labels count at every size; without trusted rows all sums are 0. Rows that repeat one another
    count each, and rows that share an identifier are all trusted or none.
    """
    trusted = labels.where(wanted & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("target_id")).distinct()
    few = trusted.count() <= TARGET_ROWS
    rows = located(docs, F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    rows = rows.join(F.broadcast(trusted) if few else trusted, F.col("doc_id") == F.col("target_id"), "left")
    rows = rows.select(place().alias("place"), F.col("target_id").isNotNull().alias("trusted"), words_of(F.col("text")).alias("words"))
    n = F.greatest(2 * F.size("words").cast("long") - 1, F.lit(0))
    hashed = rows.withColumn("words", F.transform("words", lambda w: F.xxhash64(w)))
    if not few:  # a join by shuffle leaves rows in any order; stored ones make the same chunks again
        hashed = rows = store(hashed, "words")
    nr, nt = (v or 0 for v in rows.agg(F.sum(n), F.sum(F.when(F.col("trusted"), n))).first())
    parts = -(-nr // PART_GRAMS) or 1
    passes = min(PASSES, parts)
    bounds = [p * parts // passes for p in range(passes + 1)]
    done = []
    for lo, hi in zip(bounds, bounds[1:]):
        # One shuffle of the chunks serves both those who ask and those who take the answers.
        pack = _chunks(CHUNK_WORDS, _edge(lo, parts), _edge(hi, parts))
        chunks = hashed.mapInArrow(pack, ", ".join(f"{c} binary" for c in CHUNK)).repartition("chunk")
        asked = chunks.mapInArrow(_ask(range(lo, hi), parts), "chunk binary, part int, grams binary, n binary, t binary")
        answers = asked.groupBy("part").applyInArrow(_answer, "chunk binary, part int, r binary, t binary")
        sums = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
            _score(nt / max(nr, 1)), "place struct<file: bigint, row: bigint>, n_grams long, log_sum double")
        if passes == 1:
            return sums
        done.append(store(sums, "sums").withColumn("pass", F.lit(len(done))))
    of = [F.coalesce(F.max(F.when(F.col("pass") == p, F.col("log_sum"))), F.lit(0.0)) for p in range(passes)]
    return reduce(DataFrame.unionByName, done).groupBy("place").agg(F.max("n_grams").alias("n_grams"), reduce(Column.__add__, of).alias("log_sum"))
