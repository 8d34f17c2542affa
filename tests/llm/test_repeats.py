"""Operators 4 and 8 against plain Python on texts that repeat much."""

import collections
import glob
import os
import random
import tempfile
import time

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.llm import phrases, regions, suffixes
from sweepframe.llm.common import CLEANUP, store


def texts(kind, n=60, seed=5):
    rng = random.Random(seed)
    unit = (lambda: rng.choice("ab")) if kind == "bytes" else (lambda: rng.choice(["ab", "c", "é"]) + " ")
    pool = ["".join(unit() for _ in range(rng.randint(20, 60))) for _ in range(8)]
    out = []
    for i in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.6 else "".join(unit() for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 4))]
        out.append((rng.choice([None, i, i]) if kind == "words" else i, "".join(parts)))
    return [*out, (500, None), (501, ""), (502, "a" * 90), *out[:3]]


def covered(n, starts, length):
    return {k for s in starts for k in range(s, s + length)}


def bytes_by_hand(rows, length):
    seen = collections.Counter(d[i:i + length] for _, t in rows for d in [(t or "").encode()] for i in range(len(d) - length + 1))
    out = []
    for doc_id, t in rows:
        d = (t or "").encode()
        gone = covered(len(d), [i for i in range(len(d) - length + 1) if seen[d[i:i + length]] > 1], length)
        spans = sum(k in gone and k - 1 not in gone for k in range(len(d)))
        out.append((doc_id, len(d), len(gone), spans, bytes(b for k, b in enumerate(d) if k not in gone)))
    return sorted(out, key=repr)


def words_by_hand(rows, length):
    big = 1 << 70
    first = {}
    for doc_id, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - length + 1):
            k = tuple(w[i:i + length])
            first[k] = min(first.get(k, big), big if doc_id is None else doc_id)
    out = []
    for doc_id, t in rows:
        w = (t or "").encode().split()
        gone = covered(len(w), [i for i in range(len(w) - length + 1) if first[tuple(w[i:i + length])] < (big if doc_id is None else doc_id)], length)
        out.append((doc_id, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


@pytest.fixture(params=["plain", "large", "hot"])
def path(request, monkeypatch):
    """All anchors count as usual, as those with too many texts for a task, or as common ones."""
    if request.param != "plain":
        monkeypatch.setattr(regions, "LARGE", 1)
    monkeypatch.setattr(regions, "HOT_SHARE", 10**12 if request.param == "hot" else 0)
    return request.param


def test_bytes(spark, path):
    rows = texts("bytes")
    found = suffixes.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=24).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=repr) == bytes_by_hand(rows, 24)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in found)


def test_words(spark, path):
    rows = texts("words")
    found = phrases.phrase_dedup(spark.createDataFrame(rows, "doc_id long, text string"), length=7).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=repr) == words_by_hand(rows, 7)


def test_edge_rows(spark):
    rows = [(t[0], t[1]) for t in edge.TEXTS]
    found = suffixes.substring_dedup(edge.frame(spark)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=repr) == bytes_by_hand(rows, 400)
    found = phrases.phrase_dedup(edge.frame(spark)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in found), key=repr) == words_by_hand(rows, 13)
    assert suffixes.substring_dedup(edge.empty(spark)).count() == 0
    assert phrases.phrase_dedup(edge.empty(spark)).count() == 0


def test_suffix_array():
    rng = random.Random(2)
    for k in range(1500):
        text = "".join(rng.choice("ab" if k % 2 else "abcd") for _ in range(rng.randint(1, 40)))
        depth = rng.randint(1, 50)
        array = suffixes.suffix_array(text, depth)
        assert sorted(array) == list(range(len(text)))
        keys = [text[i:i + depth] for i in array]
        assert keys == sorted(keys)
        wanted = [rng.random() < 0.3 for _ in text]
        some = suffixes.suffix_array(text, depth, np.array(wanted))
        keys = [text[i:i + depth] for i in some]
        assert keys == sorted(keys) and len(set(some)) == len(some) and {i for i, w in enumerate(wanted) if w} <= set(some)


@pytest.mark.parametrize("block", [40, 1 << 19])
def test_regions_own_every_window(monkeypatch, block):
    monkeypatch.setattr(regions, "BLOCK", block)
    rng = random.Random(4)
    for units, unit in ((regions.ByteUnits(24), lambda: rng.choice("ab")), (regions.WordUnits(7), lambda: rng.choice(["a ", "b "]))):
        texts = ["".join(unit() for _ in range(rng.randint(0, 120))) for _ in range(80)]
        owned, anchors = collections.defaultdict(list), {}
        read = [units.read(t) for t in texts]
        for doc, anchor, first, n in regions.find(units, [codes for codes, _ in read]):
            for d, a, s, m in zip(doc.tolist(), anchor.tolist(), first.tolist(), n.tolist()):
                owned[d] += range(s, s + m)
                for k in range(m):  # equal windows have equal anchors
                    assert anchors.setdefault(read[d][1](s + k, 1), a) == a
        for d, (codes, _) in enumerate(read):
            assert owned[d] == list(range(max(0, len(codes) - units.length + 1)))


def test_common_phrases_are_no_repeats(spark):
    """Texts that share phrases of 40 bytes, but no window, have no region to store, move or sort; planted windows are found all the same."""
    rng = random.Random(8)
    fill = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrases_ = [fill(40) for _ in range(4)]
    rows = [(i, "".join(fill(rng.randint(5, 60)) + rng.choice(phrases_) for _ in range(30))) for i in range(60)]
    frame = lambda some: spark.createDataFrame(some, "doc_id long, text string")
    assert regions.repeated(regions.numbered(frame(rows), "doc_id", "text"), regions.ByteUnits(400), keep=True).count() == 0
    rows += [(100 + i, fill(300) + rows[i][1][50:50 + 400 + i] + fill(200)) for i in range(3)]
    found = suffixes.substring_dedup(frame(rows)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found), key=repr) == bytes_by_hand(rows, 400)
    assert sorted(r.doc_id for r in found if r.n_removed) == [0, 1, 2, 100, 101, 102]


def test_long_anchors_are_hashes_of_their_bytes():
    units = regions.ByteUnits(400)
    text = bytes(random.Random(9).choices(b"ab", k=500)) * 2
    hashes = units.grams(np.frombuffer(text, np.uint8)).tolist()
    grams = [text[i:i + units.k] for i in range(len(text) - units.k + 1)]
    assert units.k == 64 and len(hashes) == len(grams) and len(set(zip(hashes, grams))) == len(set(hashes)) == len(set(grams))


def test_regions_and_windows_are_cut_in_one_join(spark):
    rows = regions.numbered(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string"), "doc_id", "text")
    wanted = rows.select("file", "row").crossJoin(spark.createDataFrame([(5, 1, [0], 3, 9), (6, 2, [2], 1, 1)], "anchor long, content long, starts array<long>, windows int, size long"))
    found = regions.cut_out(regions.packed(rows), wanted, regions.ByteUnits(6), F.col("size") > 4).collect()
    assert [(r.anchor, r.content, r.windows, bytes(r.data)) for r in found if r.data is not None] == [(6, 2, 1, b"cdefgh")]
    assert sorted((r.anchor, r.content, r.part) for r in found if r.key is not None) == [(5, 1, 0), (5, 1, 1), (5, 1, 2)]
    assert len({(r.key, r.check) for r in found}) == 4


def test_stored_tables_leave_no_shuffle_behind(spark):
    files = lambda: set(glob.glob(f"{tempfile.gettempdir()}/blockmgr-*/*/shuffle_*.data"))
    before = files()
    assert store(spark.range(400_000).repartition(3, "id")).count() == 400_000
    end = time.time() + 20
    while (left := {f for f in files() - before if os.path.getsize(f) > 10_000}) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP) == "false"
