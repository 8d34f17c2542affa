"""Operator 5: packing tokens into sequences by non-negative least squares.

1. Tokenize once and store the ids. A document of ``n`` ids gives ``n div window`` full pieces, each a
   sequence of its own, and a tail of ``n mod window`` ids. A task numbers the tails of each length it
   meets, so ranks over the whole table need only one small row per task and length.
2. The histogram of tail lengths has less than ``window`` bins, whatever the corpus. On the driver,
   combinations of two and three lengths that fill a window are enumerated, and repeat counts that
   reproduce the histogram are solved by least squares with no negative counts, then rounded down.
3. Tails beyond the rounded counts are packed greedily: laid on one line by length and rank and cut at
   every window, so only the last sequence of all has padding.
4. A document's rank tells where its tail goes; the lookup table has one row for each use of a length.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import store
from .mergepath import byte_letters

MODEL = "byte_bpe_50k.json"
WINDOW = 1024
DEPTH = 3
CACHE_WORDS = 1_500_000
#: Longer words are encoded each time, so the cache has a bound in bytes.
CACHE_LENGTH = 64
END_ID = 0
_workers: dict[str, Encoder] = {}


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The pre-tokens of byte-level vocabularies (fixed value).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def by_ranks(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary as ranks, if the file is a plain byte-level one whose ids follow its merges; else none.

    Words of printable ASCII and line ends have the same ids then, several times faster.
    """
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, cut = whole["model"], whole["pre_tokenizer"] or {}
    plain = whole["normalizer"] is None and cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    if not plain or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    letters, vocab = byte_letters(), model["vocab"]
    added = {t["content"] for t in whole["added_tokens"]}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(merged) or len(merged) + 256 != len(vocab) - len(added & set(vocab)):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}
    return tiktoken.Encoding("ranks", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of texts as packed integers, with a cache of the words between spaces.

    This kind of tokenizer starts a pre-token at every space that follows another character, so a
    text may be cut there and its ids joined. Words that end in white space, or are empty, stay
    with the word behind them. Texts that hold an added token are encoded whole.
    """

    def __init__(self, path: str):
        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes | bool] = {}
        self.ranks = by_ranks(path)

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of words behind a space; those of printable ASCII, lines included, by ranks."""
        if self.ranks is None:
            return self.encode([" " + w for w in words])
        quick = [w.isascii() and w.replace("\n", "").isprintable() for w in words]
        others = iter(self.encode([" " + w for w, q in zip(words, quick) if not q]))
        one, code = self.ranks.encode_ordinary, "H" if self.kind.itemsize == 2 else "I"
        return [array(code, one(" " + w)).tobytes() if q else next(others) for w, q in zip(words, quick)]

    def encode(self, texts: list[str]) -> list[bytes]:
        pack = lambda e: np.array(e.ids, self.kind).tobytes()
        return [pack(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, text: str) -> bytes:
        if not text or any(a in text for a in self.added):
            return self.encode([text])[0]
        first, *words = text.split(" ")
        parts = list(map(self.known.get, words))
        if None in parts:
            if len(self.known) > CACHE_WORDS:
                self.known = {}
            missing = [w for w in {w for w, p in zip(words, parts) if p is None}]
            whole = [w for w in missing if w and not w[-1].isspace()]
            found = dict.fromkeys(missing, False) | dict(zip(whole, self.words(whole)))
            self.known.update((w, p) for w, p in found.items() if len(w) <= CACHE_LENGTH)
            parts = [found[w] if p is None else p for w, p in zip(words, parts)]
        if False in parts or first and first[-1].isspace():
            return b"".join(self.encode(_pieces(text)))
        return (self.encode([first])[0] if first else b"") + b"".join(parts)


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker, which lives on between tasks."""
    if path not in _workers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _workers[path] = Encoder(path)
    return _workers[path]


def _pieces(text: str) -> list[str]:
    """``text`` cut before each space that follows a character other than white space."""
    out, now = [], ""
    for i, word in enumerate(text.split(" ")):
        if i and now and not now[-1].isspace():
            out.append(now)
            now = ""
        now += (" " if i else "") + word
    return [*out, now] if now else out


def tokenize(docs: DataFrame, doc_id: str, text: str, path: str, window: int) -> DataFrame:
    """``doc_id, part, n, tail, tail_rank, full, full_rank, ids`` of every row; ranks count within a task."""
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, part int, n bigint, tail int, tail_rank bigint, full bigint, full_rank bigint, ids binary"

    def run(batches):
        encoder, part = worker_encoder(path), TaskContext.get().partitionId()
        seen, full_seen = np.zeros(window, np.int64), 0
        end = np.array([END_ID], encoder.kind).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                few = batch.slice(lo, 256)
                ids = [encoder.ids(v.as_py() or "") + end for v in few.column(1)]
                n = np.array([len(x) // encoder.kind.itemsize for x in ids])
                tail, full = n % window, n // window
                ranks = np.empty(len(n), np.int64)
                for i, t in enumerate(tail):
                    ranks[i] = seen[t]
                    seen[t] += 1
                before = full_seen + np.cumsum(full) - full
                full_seen += int(full.sum())
                yield pa.RecordBatch.from_arrays(
                    [few.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(n, pa.int64()), pa.array(tail.astype(np.int32)),
                     pa.array(ranks), pa.array(full, pa.int64()), pa.array(before, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "n", "tail", "tail_rank", "full", "full_rank", "ids"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def combinations(lengths: np.ndarray, window: int, depth: int = DEPTH) -> np.ndarray:
    """Rows of up to ``depth`` lengths (ascending, 0 for none) that add up to ``window``."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    out = [np.array([[0, a, window - a] for a in lengths if a <= window - a and have[window - a]], np.int64).reshape(-1, 3)]
    for a in lengths if depth > 2 else ():
        b = lengths[(lengths >= a) & (lengths <= (window - a) // 2)]
        c = window - a - b
        fits = have[c]
        out.append(np.column_stack([np.full(fits.sum(), a), b[fits], c[fits]]))
    return np.concatenate(out)


def solve(patterns: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts ``x >= 0`` with least ``|A x - histogram|``, by accelerated projected gradients."""
    if not len(patterns):
        return np.zeros(0)
    use = lambda x: sum(np.bincount(patterns[:, k], x, len(histogram)) for k in range(3)) * real
    real = np.ones(len(histogram))
    real[0] = 0
    v = np.ones(len(patterns))
    for _ in range(12):  # the largest eigenvalue bounds the step
        w = use(v)
        v = w[patterns].sum(axis=1)
        top = np.linalg.norm(v)
        v /= top
    step, x, y, t = 1 / (1.05 * top), np.zeros(len(patterns)), np.zeros(len(patterns)), 1.0
    for _ in range(rounds):
        gap = (use(y) - histogram) * real
        nxt = np.maximum(0, y - step * gap[patterns].sum(axis=1))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = nxt, nxt + (t - 1) / t2 * (nxt - x), t2
    return x


def allocate(histogram: np.ndarray, window: int, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)`` of the combinations in use; no length is used more often than it occurs."""
    patterns = combinations(np.flatnonzero(histogram[:window]), window, depth)
    x = solve(patterns, histogram[:window].astype(float))
    left, out = histogram[:window].copy(), []
    for p in np.argsort(-x, kind="stable"):
        lengths = tuple(int(v) for v in patterns[p] if v)
        need = {v: lengths.count(v) for v in lengths}
        n = min(int(x[p] + 1e-6), *(int(left[v]) // k for v, k in need.items()))
        if n > 0:
            for v, k in need.items():
                left[v] -= n * k
            out.append((lengths, n))
        elif x[p] < 1:
            break
    return out


class Places:
    """Where the tail of a length and rank goes; size: one row for each use of a length."""

    def __init__(self, histogram: np.ndarray, full: int, window: int, depth: int = DEPTH):
        self.window, uses, sequence = window, {}, full
        used = np.zeros(window, np.int64)
        for lengths, n in allocate(histogram, window, depth):
            offset = 0
            for v in lengths:
                uses.setdefault(v, []).append((int(used[v]), sequence, offset))
                used[v] += n
                offset += v
            sequence += n
        self.uses = {v: np.array(rows, np.int64) for v, rows in uses.items()}
        self.used, self.line = used, sequence
        rest = (histogram[:window] - used) * np.arange(window)
        self.start = np.cumsum(rest) - rest

    def of(self, length: int, rank: int) -> list[tuple[int, int, int]]:
        """``(sequence, offset, ids)`` of each piece of a tail."""
        if rank < self.used[length]:
            rows = self.uses[length]
            first, sequence, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1]
            return [(int(sequence + rank - first), int(offset), length)]
        at = int(self.start[length] + (rank - self.used[length]) * length)
        out = []
        while length:
            n = min(length, self.window - at % self.window)
            out.append((self.line + at // self.window, at % self.window, n))
            at, length = at + n, length - n
        return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are the piece's ids as little-endian unsigned integers of 32 bits. A null or empty text
    is the end id alone. Repeated rows are packed each; an empty table gives no rows; other columns
    are ignored. Only the last sequence has less than ``window`` ids.
    """
    path = model or model_path(MODEL)
    kind = docs.schema[doc_id].dataType.simpleString()
    tokens = store(tokenize(docs, doc_id, text, path, window), "ids")
    per_task = tokens.groupBy("part", "tail").agg(F.count(F.lit(1)).alias("rows"), F.sum("full").alias("fulls"))
    per_task = store(per_task, "lengths")
    counts = per_task.groupBy("tail").agg(F.sum("rows").alias("rows"), F.sum("fulls").alias("fulls")).collect()  # below `window` rows
    histogram = np.zeros(window, np.int64)
    for r in counts:
        histogram[r["tail"]] = r["rows"]
    histogram[0] = 0
    places = docs.sparkSession.sparkContext.broadcast(Places(histogram, sum(r["fulls"] for r in counts), window, depth))

    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    full = per_task.groupBy("part").agg(F.sum("fulls").alias("fulls"))  # a row per task
    full = full.select("part", F.coalesce(F.sum("fulls").over(before(Window.orderBy("part"))), F.lit(0)).alias("full_base"))
    base = per_task.select("part", "tail", F.coalesce(F.sum("rows").over(before(Window.partitionBy("tail").orderBy("part"))), F.lit(0)).alias("tail_base"))
    ranked = tokens.join(base.join(full, "part"), ["part", "tail"]).select(
        "doc_id", "n", "tail", (F.col("tail_rank") + F.col("tail_base")).alias("tail_rank"), "full", (F.col("full_rank") + F.col("full_base")).alias("full_rank"), "ids")

    def cut(batches):
        at = places.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                few = batch.slice(lo, 256)
                took, cols = [], [[] for _ in range(7)]
                for i, (n, tail, rank, fulls, first, ids) in enumerate(zip(*[few.column(c).to_pylist() for c in range(1, 7)])):
                    values = np.frombuffer(ids, np.dtype(f"<u{len(ids) // n}")).astype("<u4")
                    spots = [(first + k, 0, window) for k in range(fulls)] + (at.of(tail, rank) if tail else [])
                    start = 0
                    for sequence, offset, length in spots:
                        piece = values[start:start + length].tobytes()
                        took.append(i)
                        for c, v in zip(cols, (start, length, zlib.crc32(piece), n, sequence, offset, piece)):
                            c.append(v)
                        start += length
                yield pa.RecordBatch.from_arrays(
                    [few.column(0).take(pa.array(took, pa.int64())), *[pa.array(c, pa.int64()) for c in cols[:6]], pa.array(cols[6], pa.binary())],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return ranked.mapInArrow(cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids")
