import math
import re
from collections import Counter

import edge
import numpy as np
import pytest
from conftest import SF

from sweepframe.llm import ngrams, quality, resample

#: Whole words tell little on the smallest table, which has six bad rows.
LARGER = SF.replace("sf0.001", "sf0.01")


def rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return Counter([(w,) for w in words] + list(zip(words, words[1:])))


def sums(rows, trusted):
    """``(n-grams, sum of weights)`` of each row, in plain Python over the words themselves."""
    counted = [grams(text) for _, text in rows]
    r, t = Counter(), Counter()
    for (doc_id, _), c in zip(rows, counted):
        r.update(c)
        if doc_id in trusted:
            t.update(c)
    share = sum(t.values()) / max(sum(r.values()), 1)
    out = []
    for (doc_id, _), c in zip(rows, counted):
        own = lambda n: n if doc_id in trusted else 0  # noqa: B023, E731
        weigh = lambda g, n: n * math.log((t[g] - own(n) + ngrams.ALPHA * share) / (share * (r[g] - n + ngrams.ALPHA))) if share else 0.0  # noqa: B023, E731
        out.append((sum(c.values()), math.fsum(weigh(g, n) for g, n in c.items())))
    return out


def tables(spark, made):
    if made == "table":
        return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    labels = [(6, 1, 0), (6, 1, 0), (14, 1, 0), (None, 1, 0), (7, 0, 0), (99, 1, 0)]
    return edge.frame(spark), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.fixture(params=["whole", "cut"])
def sizes(request, monkeypatch):
    """Chunks and parts as in production, and so small that every table has many of them."""
    if request.param == "cut":
        monkeypatch.setattr(ngrams, "CHUNK_WORDS", 700)
        monkeypatch.setattr(ngrams, "PART_GRAMS", 5000)


@pytest.mark.parametrize("made", ["edge", "table"])
def test_rules_and_ratio(spark, made, sizes):
    docs, labels = tables(spark, made)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    want = []
    for (doc_id, text), (n_grams, total) in zip(rows, sums(rows, trusted)):
        n, chars, symbols, lines, repeats = rules(text)
        failed = n < 10 or 100 * repeats > 20 * n
        ratio = total / max(n_grams, 1)
        want.append((doc_id, n, chars, symbols, lines, repeats, failed, round(ratio, 9), not failed and ratio >= quality.THRESHOLD))
    found = quality.quality_rules(docs, labels).collect()
    assert sorted(((*r[:7], round(r.log_ratio, 9), r.kept) for r in found), key=repr) == sorted(want, key=repr)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(edge.empty(spark), labels).count() == 0
    found = quality.quality_rules(edge.frame(spark), labels).collect()
    assert all(r.log_ratio == 0 for r in found)
    assert resample.resample(edge.empty(spark), labels).count() == 0


def test_good_documents_stay_and_bad_ones_go(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = [r for r in quality.quality_rules(docs, labels).collect() if r.doc_id in truth and not r.base_failed]
    good, bad = ([r.kept for r in found if truth[r.doc_id] == q] for q in (1, 0))
    assert sum(good) > 0.9 * len(good) and sum(bad) < 0.1 * len(bad)


@pytest.mark.parametrize("made", ["edge", "table"])
def test_importance(spark, made, sizes):
    docs, labels = tables(spark, made)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic != 1 and r.doc_id is not None}
    want = [(i, n, round(total / max(n, 1), 9)) for (i, _), (n, total) in zip(rows, sums(rows, trusted))]
    found = resample.importance(docs, labels).collect()
    assert sorted(((r.doc_id, r.n_grams, round(r.log_ratio, 9)) for r in found), key=repr) == sorted(want, key=repr)
    assert all(r.log_weight == r.log_ratio * resample.PASSAGE for r in found)


def test_arrays_come_back():
    for kind, values in [(np.uint64, [0, 5, 5, (1 << 64) - 1]), (np.int64, [-7, 1 << 40]), (np.uint8, [3]), (np.int64, [])]:
        values = np.array(values, kind)
        assert (ngrams.expand(ngrams.squash(values), kind) == values).all()
        assert (np.cumsum(ngrams.steps(values), dtype=kind) == values).all()


def test_rows_of_one_identifier_draw_each(spark):
    docs = edge.frame(spark, [r for r in edge.ROWS if r[0] == 6] * 40).coalesce(1)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    found = resample.resample(docs, labels, share=0.5).collect()
    assert len({r.gumbel_key for r in found}) > 20 and sum(r.picked for r in found) == 20


@pytest.mark.parametrize("share", [0.0, 0.3, 1.0])
def test_top_k_is_exact(spark, share):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = resample.resample(docs, labels, share=share).collect()
    first = sorted(found, key=lambda r: (-r.gumbel_key, r.doc_id))[: round(share * len(found))]
    assert {r.doc_id for r in first} == {r.doc_id for r in found if r.picked}
    again = {(r.doc_id, r.picked) for r in resample.resample(docs, labels, share=share).collect()}
    assert again == {(r.doc_id, r.picked) for r in found}


def test_resampling_prefers_trusted_text(spark):
    """Held-out labels: the weight ranks good documents above bad ones."""
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.col("doc_id"), F.lit(3)) == 0
    truth = {r.doc_id: r.quality for r in labels.where(held).collect()}
    found = {r.doc_id: r.log_ratio for r in resample.importance(docs, labels, held_out=held).collect()}
    good, bad = ([found[i] for i, q in truth.items() if q == want] for want in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)


def test_edge_rows_of_resampling(spark):
    labels = spark.createDataFrame([(6, 1, 0), (14, 1, None)], "doc_id long, quality int, toxic int")
    found = resample.resample(edge.frame(spark), labels, share=0.5).collect()
    assert len(found) == len(edge.ROWS) and sum(r.picked for r in found) == round(len(edge.ROWS) / 2)
