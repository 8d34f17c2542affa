"""Operator 2: language identification by a convolutional network over bytes.

The network sees fixed windows of ``WINDOW`` bytes. Filters of widths 2, 3 and 4 slide over the bytes;
ReLU and max pooling give one number per filter, a softmax layer the languages. It is trained in
numpy on windows of a bounded, seeded share of the labelled rows. A whole text is cut into windows
and the probabilities of its windows are averaged; no byte is left out.

A filter over one-hot bytes is a sum of table rows. Rows of two neighbouring bytes are added up once
per worker, so a position costs five lookups. Texts are read a few kilobytes at a time, in windows of
many texts together, which bounds memory whatever a text's length.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AT, located

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled rows to learn from: a seeded share of them, about this many at most.
TRAIN_ROWS = 6_000
#: Windows taken from each of them.
TRAIN_WINDOWS = 4
EPOCHS = 12
SEED = 7
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BATCH = 64
_workers: dict[str, Tables] = {}


def remainder(doc_id: Column) -> Column:
    """crc32 of the identifier as text, modulo 4 (null: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def windows_of(data: bytes, window: int = WINDOW) -> np.ndarray:
    """All bytes in rows of ``window``, the last one filled with zeros."""
    n = -(-len(data) // window)
    out = np.zeros(n * window, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, window)


class Network:
    """Weights: ``taps[w][t]`` is a table byte -> filters for tap ``t`` of width ``w``."""

    def __init__(self, classes: list[str], filters: int = FILTERS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.taps = {w: rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(filters, np.float32) for w in WIDTHS}
        self.dense = rng.normal(0, 0.1, (len(WIDTHS) * filters, len(classes))).astype(np.float32)
        self.offset = np.zeros(len(classes), np.float32)

    def params(self) -> list[np.ndarray]:
        return [*self.taps.values(), *self.bias.values(), self.dense, self.offset]

    def pool(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled activations and, for each width, the position each came from."""
        pooled, places = [], []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            z = sum(self.taps[w][t][x[:, t:t + n]] for t in range(w))
            at = z.argmax(axis=1)
            pooled.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0] + self.bias[w])
            places.append(at)
        return np.concatenate(pooled, axis=1), places

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = SEED) -> Network:
        """Adam on the cross entropy; the gradient of a max runs through one position only."""
        rng = np.random.default_rng(seed)
        params = self.params()
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        share = np.bincount(y, minlength=len(self.classes)) / max(len(y), 1)
        weight = (1 / np.maximum(share, 1e-9) / (share > 0).sum()).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), _BATCH):
                rows = order[lo:lo + _BATCH]
                xb, yb = x[rows], y[rows]
                pooled, places = self.pool(xb)
                hidden = np.maximum(pooled, 0)
                gap = _softmax(hidden @ self.dense + self.offset)
                gap[np.arange(len(rows)), yb] -= 1
                gap *= weight[yb][:, None] / len(rows)
                back = (gap @ self.dense.T) * (pooled > 0)
                grads = [np.zeros_like(p) for p in params]
                for k, w in enumerate(WIDTHS):
                    f = self.bias[w].size
                    part = back[:, k * f:(k + 1) * f]
                    for t in range(w):
                        seen = np.take_along_axis(xb, places[k] + t, axis=1)
                        np.add.at(grads[k][t], (seen, np.arange(f)[None, :]), part)
                    grads[len(WIDTHS) + k] = part.sum(axis=0)
                grads[-2], grads[-1] = hidden.T @ gap, gap.sum(axis=0)
                step += 1
                for p, g, a, b in zip(params, grads, m, v):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Tables:
    """A trained network laid out for prediction: rows for pairs of bytes."""

    def __init__(self, net: Network):
        self.net = net
        pair = lambda w, t: (net.taps[w][t][:, None, :] + net.taps[w][t + 1][None, :, :]).reshape(1 << 16, -1)
        self.pairs = {2: [pair(2, 0)], 3: [pair(3, 0)], 4: [pair(4, 0), pair(4, 2)]}
        self.last = net.taps[3][2]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities of each window (row of bytes)."""
        out = []
        for lo in range(0, len(x), _BATCH):
            b = x[lo:lo + _BATCH]
            two = b[:, :-1].astype(np.intp)
            two *= 256
            two += b[:, 1:]
            three = self.pairs[3][0].take(two[:, :-1], axis=0)
            three += self.last.take(b[:, 2:], axis=0)
            four = self.pairs[4][0].take(two[:, :-2], axis=0)
            four += self.pairs[4][1].take(two[:, 2:], axis=0)
            hidden = [_largest(z) + self.net.bias[w] for w, z in ((2, self.pairs[2][0].take(two, axis=0)), (3, three), (4, four))]
            out.append(_softmax(np.maximum(np.concatenate(hidden, axis=1), 0) @ self.net.dense + self.net.offset))
        return np.concatenate(out) if out else np.zeros((0, len(self.net.classes)), np.float32)


def _largest(z: np.ndarray) -> np.ndarray:
    """Maximum over axis 1, by halves: whole blocks are compared at once."""
    while z.shape[1] > 1:
        half = z.shape[1] // 2
        odd = z[:, -1:] if z.shape[1] % 2 else None
        z = np.maximum(z[:, :half], z[:, half:2 * half])
        if odd is not None:
            z[:, :1] = np.maximum(z[:, :1], odd)
    return z[:, 0]


def shares(counts: dict[str, int], rows: int) -> dict[str, float]:
    """The share of each language's rows to draw: equal numbers of rows, and all rows of rarer languages."""
    out, left = {}, float(rows)
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        drawn = min(n, left / (len(counts) - i))
        out[lang] = drawn / n
        left -= drawn
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = TRAIN_ROWS, seed: int = SEED) -> Network | None:
    """Learn from windows of labelled rows outside the held-out quarter; None if there are none.

    ``rows`` bounds the sample: about that many rows, seeded, shared evenly among the languages, and
    what rare ones leave over among the others. Chance is drawn from identifier and row number, so
    rows that share an identifier are drawn each. A row gives up to ``TRAIN_WINDOWS`` windows from
    seeded places anywhere in its text.
    """
    named = located(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    labelled = named.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id")) != 2))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # the network's classes
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for pair in shares(counts, rows).items() for x in pair])
    key = [F.col("doc_id"), F.col(f"{AT}.row")]
    fate = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 30)) / float(1 << 30)
    some = labelled.where(fate < share[F.col("lang")]).select("lang", "text", F.xxhash64(F.lit(seed + 1), *key).alias("fate"))
    taken = some.mapInArrow(sample_windows, "lang string, data binary").toPandas()
    if taken.empty:
        return None
    taken = taken.sort_values(["lang", "data"], ignore_index=True)  # the same order however tasks end
    classes = sorted(taken["lang"].unique())
    x = np.frombuffer(b"".join(taken["data"]), np.uint8).reshape(-1, WINDOW)
    return Network(classes, seed=seed).fit(x, np.searchsorted(classes, taken["lang"]).astype(np.int64), seed=seed)


def sample_windows(batches):
    for batch in batches:
        langs, data = [], []
        for lang, text, fate in zip(*[batch.column(c) for c in range(3)]):
            raw = text.as_py().encode()
            if not raw:
                continue
            n = -(-len(raw) // WINDOW)
            rng = np.random.default_rng(fate.as_py() & (1 << 63) - 1)
            for k in sorted(rng.choice(n, min(n, TRAIN_WINDOWS), replace=False)):
                langs.append(lang.as_py())
                data.append(windows_of(raw[k * WINDOW:(k + 1) * WINDOW])[0].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(data, pa.binary())], names=["lang", "data"])


def worker_tables(key: str, model) -> Tables:
    if key not in _workers:
        _workers.clear()
        _workers[key] = Tables(model.value)
    return _workers[key]


def judge(texts: pa.Array, tables: Tables) -> tuple[list[str], list[float]]:
    """Language and score of each text; windows of many texts are judged together."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    held: list[tuple[int, np.ndarray]] = []
    sums: dict[int, np.ndarray] = {}

    def flush():
        if held:
            p = tables.probabilities(np.concatenate([x for _, x in held]))
            lo = 0
            for i, x in held:
                sums[i] = sums.get(i, 0) + p[lo:lo + len(x)].sum(axis=0, dtype=np.float64)
                lo += len(x)
            held.clear()

    counts: dict[int, int] = {}
    size = 0
    for i, value in enumerate(texts):
        text = value.as_py()
        if text is None or not _LETTER.search(text):
            continue
        raw = text.encode()
        counts[i] = -(-len(raw) // WINDOW)
        for lo in range(0, len(raw), 1 << 20):
            x = windows_of(raw[lo:lo + (1 << 20)])
            held.append((i, x))
            size += len(x)
            if size >= 1024:
                flush()
                size = 0
    flush()
    for i, total in sums.items():
        best = int(total.argmax())
        langs[i], scores[i] = tables.net.classes[best], min(1.0, float(total[best] / counts[i]))
    return langs, scores


def language(docs: DataFrame, net: Network | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its mean probability over the text's windows.

    ``und`` with score 0 if the text is null or has no letter, or nothing could be learned.
    """
    if net is None:
        return docs.withColumns({lang_pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    model = docs.sparkSession.sparkContext.broadcast(net)
    key = uuid.uuid4().hex

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(texts: pa.Array) -> pa.Array:
        langs, scores = judge(texts, worker_tables(key, model))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    found = docs.withColumn("__found", predict(F.col(text).cast("string")))
    return found.withColumns({lang_pred: F.col("__found.lang_pred"), score: F.col("__found.score")}).drop("__found")


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row.

    The label, source and identifier are used to choose what to learn from, never to predict.
    Rows that repeat one another are judged each; an empty table gives no rows.
    """
    net = train(docs, doc_id, text, lang, train_rows)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return language(rows, net).select("doc_id", (remainder(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
