"""Operators 5 and 9 against the tokenizers themselves."""

import collections
import random
import zlib

import edge
import numpy as np
import pytest
import sentencepiece
from conftest import SF

from sweepframe.llm import packing, tokencount


def odd_texts(n=4000):
    rng = random.Random(1)
    pool = [*" ab\n\t\r.é中 　 \x1f\x85᠎1's▁😀́<>", "<|endoftext|>", "<s>", "'ll ", "  ", " \n ", "the"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_counts_of_odd_texts():
    path = tokencount.model_path(tokencount.MODEL)
    counter, model = tokencount.Counter(path, tokencount.frequent_lengths(path)), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in odd_texts():
        assert counter.count(text) == len(model.encode(text)), repr(text)


def test_ids_of_odd_texts():
    encoder = packing.Encoder(packing.model_path(packing.MODEL))
    for text in odd_texts():
        assert encoder.ids(text) == np.array(encoder.model.encode(text, add_special_tokens=False).ids, "<u2").tobytes(), repr(text)


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(tokencount, "CACHE_WORDS", 5)
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    path = tokencount.model_path(tokencount.MODEL)
    counter, model = tokencount.Counter(path, {}), sentencepiece.SentencePieceProcessor(model_file=path)
    encoder = packing.Encoder(packing.model_path(packing.MODEL))
    for i in range(20):
        text = f"word{i} again word{i} other{i + 1} x"
        assert counter.count(text) == len(model.encode(text))
        assert encoder.ids(text) == np.array(encoder.model.encode(text).ids, "<u2").tobytes()


@pytest.mark.parametrize("made", ["edge", "table"])
def test_token_counts(spark, made):
    docs = edge.frame(spark) if made == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    model = sentencepiece.SentencePieceProcessor(model_file=tokencount.model_path(tokencount.MODEL))
    want = [(r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect()]
    found = tokencount.token_counts(docs).collect()
    assert sorted(((*r[:3], r.over_limit) for r in found), key=repr) == sorted(((*w, w[2] > 4096) for w in want), key=repr)
    assert tokencount.token_counts(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("made", ["edge", "table"])
def test_packing_is_an_exact_round_trip(spark, made):
    docs = edge.frame(spark) if made == "edge" else spark.read.parquet(f"{SF}/documents.parquet")
    model = packing.Encoder(packing.model_path(packing.MODEL)).model
    want = collections.Counter()
    for r in docs.collect():
        want[(r.doc_id, np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes())] += 1
    found = packing.pack(docs).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in found:
        assert p.length == len(p.ids) // 4 > 0 and p.ids_crc32 == zlib.crc32(p.ids)
        pieces[(p.doc_id, p.doc_tokens)].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for (doc_id, n), parts in pieces.items():
        ids = {x: k for (i, x), k in want.items() if i == doc_id and len(x) == 4 * n}
        copies = sum(ids.values())
        at = collections.Counter()
        for p in parts:
            assert any(x[4 * p.start:4 * (p.start + p.length)] == p.ids for x in ids)
            at.update(range(p.start, p.start + p.length))
        assert at == {k: copies for k in range(n)}
    short = 0
    for spots in sequences.values():
        end = 0
        for offset, length in sorted(spots):
            assert offset == end
            end += length
        assert end <= 1024
        short += end < 1024
    assert short <= 1 and sorted(sequences) == list(range(len(sequences)))


def test_packing_of_nothing(spark):
    assert packing.pack(edge.empty(spark)).count() == 0


def test_least_squares_reproduce_a_histogram_that_combinations_fill():
    histogram = np.zeros(1025, np.int64)
    for lengths, n in (((500, 524), 300), ((100, 200, 724), 700), ((512, 512), 40), ((3, 21, 1000), 90)):
        for v in lengths:
            histogram[v] += n
    used = np.zeros(1025, np.int64)
    for lengths, n in packing.allocate(histogram, 1024):
        assert sum(lengths) == 1024 and n > 0
        for v in lengths:
            used[v] += n
    assert (used <= histogram).all() and used.sum() > 0.95 * histogram.sum()


def test_ranks_give_the_ids_of_the_vocabulary(spark):
    """Words of a table, every ASCII word of the vocabulary, and random printable text."""
    path = packing.model_path(packing.MODEL)
    encoder = packing.Encoder(path)
    assert encoder.ranks is not None
    rng = random.Random(4)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    words = {w for t in texts for w in t.split(" ")} | {t.lstrip("\u0120") for t in encoder.model.get_vocab() if t.isascii() or t[1:].isascii()}
    words |= {"".join(chr(rng.randrange(33, 127)) for _ in range(rng.randrange(1, 30))) for _ in range(30_000)}
    words |= {"".join(rng.choice("aAzZ019'' st") for _ in range(rng.randrange(1, 12))) for _ in range(20_000)}
    words |= {"".join(rng.choice("aB1.'\n") for _ in range(rng.randrange(1, 9))) for _ in range(20_000)}
    words = sorted(w for w in words if w and w.isascii() and not w[-1].isspace() and "<|endoftext|>" not in w)
    assert len(words) > 60_000
    assert encoder.words(words) == encoder.encode([" " + w for w in words])
