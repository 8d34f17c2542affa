"""Operator 13: alignment of two tokenizers' tokens by merging their byte ends along equal-work pieces.

A batch of texts gives two ascending lists, the byte offsets where tokens of A and of B end, counted
through the whole batch. Merging them is cut by the merge path: diagonal ``d`` crosses the path where
``d`` ends of both lists together lie behind it, found by a binary search on that diagonal alone. So
every piece between two diagonals has ``work`` ends, however the lengths of texts are spread, and needs
nothing of the others. A piece emits its overlaps, the ends that both lists have; an overlap whose two
ends fall on different sides of a diagonal, and the groups that reach across, are stitched afterwards.

Both tokenizers cut before a space that follows another character, so the ids of a chunk between such
places are looked up in a cache of the worker; texts where a chunk's bytes don't come back are encoded whole.

Pairs of linked ids are counted corpus-wide with partial sums. A text looks its pairs up in two tiers:
those frequent enough that at most ``FREQUENT`` of them exist are sent to every worker, the rest meet
the table of counts in a join. Nothing sent to the workers grows with the corpus.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import store

MODEL_A = "byte_bpe_50k.json"
MODEL_B = "piece_bpe_32k.model"
#: Ends of a piece.
WORK = 1 << 14
#: Most id pairs that are sent to the workers.
FREQUENT = 1 << 18
CACHE_WORDS = 600_000
#: Longer chunks are encoded each time, so the cache has a bound in bytes.
CACHE_LENGTH = 64
MARK = "▁"
_BATCH = 256
_workers: dict[tuple[str, str], Aligner] = {}


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable bytes are themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def piece_bytes(piece: str, is_byte: bool) -> bytes:
    return bytes([int(piece[3:5], 16)]) if is_byte else piece.replace(MARK, " ").encode()


def diagonals(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of ascending ``a`` and ``b`` (equal ends: ``a`` first) crosses every ``work``-th diagonal."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        mid = (low + high) // 2
        # Is the path at or left of column mid? It is if the next end of a comes behind the last one taken of b.
        open_ = low < high
        at = np.minimum(mid, max(0, len(a) - 1))
        behind = a[at] > b[np.clip(d - mid - 1, 0, max(0, len(b) - 1))] if len(b) and len(a) else np.ones(len(d), bool)
        high = np.where(open_ & behind, mid, high)
        low = np.where(open_ & ~behind, mid + 1, low)
    return low, d - low


def piece_overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that ascending ``a`` and ``b`` share."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(b, a)
    same = b[np.minimum(at, len(b) - 1)] == a
    return np.flatnonzero(same), at[same]


def overlaps(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, j)`` with ``a[i] == b[j]``, in order, merged piece by piece."""
    i, j = diagonals(a, b, work)
    left, right = [], []
    for k in range(len(i) - 1):
        x, y = piece_overlaps(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]])
        left.append(x + i[k])
        right.append(y + j[k])
        # Stitch: a diagonal may part two equal ends.
        if 0 < i[k + 1] and j[k + 1] < len(b) and a[i[k + 1] - 1] == b[j[k + 1]]:
            left.append(i[k + 1:k + 2] - 1)
            right.append(j[k + 1:k + 2])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


class Aligner:
    """Ids of both tokenizers for texts of one worker, and their groups."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True  # their strings inside a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters, size_b = byte_letters(), self.b.get_piece_size()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.bytes_a = [bytes(letters[c] for c in names[i]) if i in names and all(c in letters for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        self.bytes_b = [piece_bytes(p, self.b.is_byte(i)) for i, p in enumerate(pieces)]
        if not all(self.bytes_a) or not all(self.bytes_b):
            raise ValueError("a token without bytes ends where another does")
        self.size_a, self.size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.bytes_a, self.bytes_b))
        self.cuts = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.known: dict[str, tuple[bytes, bytes] | bool] = {}
        top = max(len(self.bytes_a), len(self.bytes_b))
        self.texts = {s: np.array([b"%d%s" % (i, s) for i in range(top)], object) for s in (b",", b"|", b";")}

    def encode(self, chunks: list[str]) -> list[tuple[bytes, bytes] | bool]:
        """Ids of both kinds for chunks that begin with a space; False where the bytes don't come back."""
        out = []
        a = self.a.encode_batch_fast(chunks, add_special_tokens=False)
        for chunk, x, ib in zip(chunks, a, self.b.encode([c[1:] for c in chunks], num_threads=1)):
            ia, raw = x.ids, chunk.encode()
            good = b"".join([self.bytes_a[i] for i in ia]) == raw and b"".join([self.bytes_b[i] for i in ib]) == raw
            out.append((np.array(ia, "<u4").tobytes(), np.array(ib, "<u4").tobytes()) if good else False)
        return out

    def ids(self, text: str | None) -> tuple[bytes, bytes]:
        """Ids of both kinds as unsigned integers of 32 bits; none if the text's bytes don't come back."""
        if not text:
            return b"", b""
        words = text.split(" ") if self.cuts else [text]
        parts = list(map(self.known.get, words))
        if None in parts:
            parts = self._missing(words, parts)
        if False in parts:
            words = chunks(text) if self.cuts else [text]
            parts = list(map(self.known.get, words))
            if None in parts or False in parts:
                parts = self.encode([" " + w for w in words])
            if False in parts:
                whole = self.encode([" " + text])[0]
                return whole or (b"", b"")
        return b"".join([p[0] for p in parts]), b"".join([p[1] for p in parts])

    def _missing(self, words: list[str], parts: list) -> list:
        missing = list({w for w, p in zip(words, parts) if p is None})
        whole = [w for w in missing if w and not w[-1].isspace()]
        found = dict.fromkeys(missing, False) | dict(zip(whole, self.encode([" " + w for w in whole])))
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        self.known.update((w, p) for w, p in found.items() if len(w) <= CACHE_LENGTH)
        return [found[w] if p is None else p for w, p in zip(words, parts)]

    def align(self, texts: list[str | None], work: int = WORK) -> dict[str, np.ndarray | list]:
        """For each text ``n_a, n_b, n_groups, groups``, and its distinct linked id pairs with their numbers."""
        both = [self.ids(t) for t in texts]
        a, b = (np.frombuffer(b"".join([p[k] for p in both]), "<u4").astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(p[k]) // 4 for p in both], np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        i, j = overlaps(ends_a, ends_b, work)
        # The end of every text is an overlap, so groups never cross texts.
        of_a, of_b = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
        written = np.empty(len(a) + len(b), object)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[i], last_b[j] = True, True
        written[np.arange(len(a)) + np.append(0, j + 1)[of_a]] = np.where(last_a, self.texts[b"|"][a], self.texts[b","][a])
        written[np.arange(len(b)) + (i + 1)[of_b] if len(b) else np.zeros(0, int)] = np.where(last_b, self.texts[b";"][b], self.texts[b","][b])
        at = np.append(0, np.cumsum(n_a + n_b)).tolist()
        groups = [b"".join(written[lo:hi].tolist())[:-1] for lo, hi in zip(at, at[1:])]
        bounds = np.searchsorted(i, np.append(0, np.cumsum(n_a)))
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        wide_b = len(self.bytes_b)
        wide = len(self.bytes_a) * wide_b
        distinct, times = np.unique(owner * wide + a[i] * wide_b + b[j], return_counts=True)
        code = distinct % wide
        return {"n_a": n_a, "n_b": n_b, "n_groups": np.diff(bounds), "groups": groups, "pairs": code // wide_b << 32 | code % wide_b, "times": times,
                "offsets": np.searchsorted(distinct, np.arange(len(texts) + 1) * wide)}


def chunks(text: str) -> list[str]:
    """``text`` cut before each space that follows a character other than white space; that space is left out."""
    out, now = [], None
    for word in text.split(" "):
        if now is None:
            now = word
        elif now and not now[-1].isspace():
            out.append(now)
            now = word
        else:
            now += " " + word
    return [*out, now]


def worker_aligner(path_a: str, path_b: str) -> Aligner:
    """The aligner of this Python worker, which lives on between tasks."""
    if (path_a, path_b) not in _workers:
        _workers[path_a, path_b] = Aligner(path_a, path_b)
    return _workers[path_a, path_b]


def alignments(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_a: str | None = None, model_b: str | None = None, groups: bool = False) -> DataFrame:
    """``row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` of every row, and its ``groups`` if asked for.

    ``row`` names a row within this result, so store it before reading it twice. ``pairs`` are the
    distinct linked id pairs, A's id in the upper half of a long, ``times`` how often the row links them.
    """
    path_a, path_b = model_a or model_path(MODEL_A), model_b or model_path(MODEL_B)
    kind = docs.schema[doc_id].dataType.simpleString()
    more = ", groups string" if groups else ""

    def run(batches):
        aligner, row = worker_aligner(path_a, path_b), TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, _BATCH):
                few = batch.slice(lo, _BATCH)
                got = aligner.align(few.column(1).to_pylist())
                listed = lambda v, t: pa.ListArray.from_arrays(pa.array(got["offsets"], pa.int32()), pa.array(v, t))
                digests = [hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]]
                cols = {"row": pa.array(np.arange(few.num_rows) + row), "doc_id": few.column(0),
                        **{c: pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups")}, "n_links": pa.array(got["n_groups"], pa.int64()),
                        "groups_sha256": pa.array(digests, pa.string()), "pairs": listed(got["pairs"], pa.int64()), "times": listed(got["times"], pa.int64())}
                if groups:
                    cols["groups"] = pa.array([g.decode() for g in got["groups"]], pa.string())
                row += few.num_rows
                yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>{more}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, count, best`` of every linked id pair; ``best`` if no other pair of its B id has a higher count."""
    linked = aligned.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    counts = linked.groupBy("pair").agg(F.sum("times").alias("count"))
    # A B id has at most one row for each A id.
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(b_id)))


def _floor(counts: DataFrame, most: int) -> int:
    """The smallest power of two that at most ``most`` pairs reach, or 1."""
    steps = counts.groupBy(F.floor(F.log2("count")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 64 rows
    total, k = 0, 0
    for r in sorted(steps, key=lambda r: -r["k"]):
        if (total := total + r["n"]) > most:
            return 1 << (r["k"] + 1)
    return 1 << k


def cross_alignment(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model_a: str | None = None, model_b: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    A null or empty text, and one whose bytes a tokenizer doesn't give back, has no tokens: zeros and
    an empty digest. Repeated rows count each; tied pairs are all best. An empty table gives no rows;
    other columns are ignored. A token always has bytes, so each group ends in exactly one link.
    """
    aligned = store(alignments(docs, doc_id, text, model_a, model_b), "aligned")
    counts = store(pair_counts(aligned), "pair-counts")
    floor = _floor(counts, frequent)
    top = counts.where(F.col("count") >= floor).orderBy("pair").toArrow()  # at most `frequent` rows
    table = docs.sparkSession.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("pair", "count", "best")))
    kind = docs.schema[doc_id].dataType.simpleString()
    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def look(batches):
        names, numbers, best = table.value
        for batch in batches:
            lists = batch.column("pairs")
            pairs, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("pairs", "times"))
            at = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            spot = np.minimum(np.searchsorted(names, pairs), max(0, len(names) - 1))
            known = names[spot] == pairs if len(names) else np.zeros(len(pairs), bool)
            sums = lambda v: np.diff(np.append(0, np.cumsum(v))[at])
            count = sums(np.where(known, times * numbers[spot], 0) if len(names) else np.zeros(len(pairs), np.int64))
            first = sums(np.where(known & best[spot], times, 0) if len(names) else np.zeros(len(pairs), np.int64))
            rest = pa.array(np.append(0, np.cumsum(~known))[at], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(first, pa.int64()), pa.array(count, pa.int64()),
                 pa.ListArray.from_arrays(rest, pa.array(pairs[~known], pa.int64())), pa.ListArray.from_arrays(rest, pa.array(times[~known], pa.int64()))],
                names=[*kept, "n_best", "count_sum", "pairs", "times"])

    looked = aligned.mapInArrow(look, f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, count_sum bigint, pairs array<bigint>, times array<bigint>")
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if floor == 1:
        return looked.select(*out)
    looked = store(looked, "looked")
    rare = looked.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    rare = rare.join(counts.where(F.col("count") < floor), "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_count"))
    both = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return looked.drop("pairs", "times").join(rare, "row", "left").select(*out[:5], both("n_best", "more_best"), both("count_sum", "more_count"), out[7])


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
