import zlib

import edge
import numpy as np
from conftest import SF

from sweepframe.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = langid.identify(docs).collect()
    assert {r.doc_id for r in found} == set(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    held = [r for r in found if r.held_out]
    assert len(held) > 20 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_edge_rows(spark):
    docs = edge.frame(spark)
    found = langid.identify(docs).collect()
    assert len(found) == len(edge.ROWS)
    unknown = [r for r in found if r.lang_pred == "und"]
    assert {r.doc_id for r in unknown} == {1, 2, 3, 13} and all(r.score == 0 for r in unknown)
    assert {r.lang_pred for r in found} <= {"und", "en", "de", "fr"}
    assert langid.identify(edge.empty(spark)).count() == 0
    unlabelled = edge.frame(spark, [(1, "words", None, None, 5, *["c"] * len(edge.CLASHES))])
    assert [(r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]


def test_sample_is_bounded_and_every_language_is_in_it(spark):
    assert langid.shares({"a": 10, "b": 1000, "c": 5000}, 210) == {"a": 1.0, "b": 0.1, "c": 0.02}
    assert set(langid.shares({"a": 3, "b": 4}, 100).values()) == {1.0}
    # One identifier for all rows: still a sample, neither all rows nor none.
    made = spark.range(20_000).selectExpr("73L AS doc_id", "concat('some words ', id) AS text", "IF(id % 1000 = 0, 'rare', 'common') AS lang")
    drawn = []
    fit = langid.Network.fit
    langid.Network.fit = lambda net, x, y, seed: drawn.append((net.classes, np.bincount(y))) or net
    try:
        langid.train(made, rows=300)
    finally:
        langid.Network.fit = fit
    (classes, n), = drawn
    assert classes == ["common", "rare"] and n[1] == 20 and 200 < n[0] < 360


def test_windows_hold_every_byte_and_tables_agree_with_the_network():
    rng = np.random.default_rng(1)
    data = rng.integers(1, 256, 1000, dtype=np.uint8).tobytes()
    x = langid.windows_of(data)
    assert x.shape == (8, 128) and x.tobytes().rstrip(b"\0") == data
    net = langid.Network(["a", "b"])
    pooled, _ = net.pool(x)
    want = langid._softmax(np.maximum(pooled, 0) @ net.dense + net.offset)
    assert np.allclose(langid.Tables(net).probabilities(x), want, atol=1e-5)
