"""Operator 9: token counts from a two-tier table of pre-token lengths, without any shuffle.

A pre-token is a run of spaces with the run of other characters behind it. No piece of the model
has a space after another character (checked when the model is loaded), so merges never cross
pre-tokens and a text's count is the sum over its pre-tokens.

Tier one is a hash table of the words the model knows whole, the frequent pre-tokens of the text it
was made from. It is broadcast; its size is bounded by the vocabulary. Tier two is a cache of each
worker for the words it meets beyond those; it starts anew when ``CACHE_WORDS`` are in it.
"""

from __future__ import annotations

import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
CACHE_WORDS = 1_000_000
#: Longer words are encoded each time, so the cache has a bound in bytes.
CACHE_LENGTH = 64
MARK = "▁"
_PIECES = re.compile(" *[^ ]+| +$")
_workers: dict[str, Counter] = {}


def model_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def frequent_lengths(path: str) -> dict[str, int]:
    """Tokens of each word of the vocabulary, written without its leading mark."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    words = [p[1:] for p in pieces if len(p) > 1 and p[0] == MARK and MARK not in p[1:]]
    return dict(zip(words, map(len, model.encode(words, num_threads=1))))


class Counter:
    """Counts the tokens of texts in one worker."""

    def __init__(self, path: str, frequent: dict[str, int]):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.additive = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.frequent = frequent
        # A space at the very end of a text is a pre-token without other characters.
        self.known = {**frequent, "": 1}

    def count(self, text: str) -> int:
        if not self.additive or MARK in text:
            return len(self.model.encode(text))
        if not text:
            return 0
        words = text.split(" ")
        if "" in words:  # several spaces in a row, or some at an end
            words = [p[1:] for p in _PIECES.findall(" " + text)]
        lengths = list(map(self.known.get, words))
        if None in lengths:
            missing = list({w for w, n in zip(words, lengths) if n is None})
            found = dict(zip(missing, map(len, self.model.encode(missing, num_threads=1))))
            if len(self.known) > CACHE_WORDS:
                self.known = {**self.frequent, "": 1}
            self.known.update((w, n) for w, n in found.items() if len(w) <= CACHE_LENGTH)
            return sum(found[w] if n is None else n for w, n in zip(words, lengths))
        return sum(lengths)


def worker_counter(path: str, frequent) -> Counter:
    """The counter of this Python worker, which lives on between tasks."""
    if path not in _workers:
        _workers[path] = Counter(path, frequent.value)
    return _workers[path]


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, in one pass over the table.

    A null or empty text has no bytes and no tokens. Strings of special tokens inside a text are
    ordinary text. Repeated rows are counted each; other columns are ignored.
    """
    path = model or model_path(MODEL)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(path))
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches):
        counter = worker_counter(path, frequent)
        for batch in batches:
            texts = batch.column(1)
            sizes, tokens = [], []
            for value in texts:
                one = value.as_py() or ""
                sizes.append(len(one.encode()))
                tokens.append(counter.count(one))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(count, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
