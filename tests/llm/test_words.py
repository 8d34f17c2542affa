import collections
import math
import random
import re

import edge
from pyspark.sql import functions as F

from sweepframe.llm import ngrams, quality, resample
from sweepframe.llm.common import on_files


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return collections.Counter([*words, *zip(words, words[1:])])


def test_sums_by_hand(spark):
    docs = on_files(edge.frame(spark))
    labels = spark.createDataFrame([(6, 1), (6, 1), (14, 1), (None, 1), (7, 0), (99, 1)], "doc_id long, quality int")
    own = [(i in (6, 14), grams(t)) for i, t, *_ in edge.TEXTS]
    r, t = sum((g for _, g in own), collections.Counter()), sum((g for k, g in own if k), collections.Counter())
    s = t.total() / r.total()
    want = []
    for known, g in own:
        if g:
            want.append((g.total(), round(sum(n * math.log((t[x] - n * known + 1 * s) / (s * (r[x] - n + 1))) for x, n in g.items()), 6)))
    found = ngrams.word_sums(docs, labels, F.col("quality") == 1).collect()
    assert sorted((x.n_grams, round(x.log_sum, 6)) for x in found) == sorted(want)


def test_symbols_before_words(spark, tmp_path):
    """Bad words with good endings."""
    rng = random.Random(1)
    words = [f"word{chr(97 + i % 26)}{i}" for i in range(200)]
    text = lambda mark="": " ".join(mark + rng.choice(words) for _ in range(150))
    rows = [(i, text()) for i in range(60)] + [(i, text("&&&")) for i in range(60, 80)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 80, 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    found = {r.doc_id: r.kept for r in quality.op3_quality_rules(spark, str(tmp_path)).collect()}
    assert all(found[i] == (i < 60) for i in found)
    picked = {r.doc_id for r in resample.op7_importance_resampling(spark, str(tmp_path)).collect() if r.picked}
    assert len(picked) == 40 and max(picked) < 60


def test_pairs_have_their_own_weight(spark):
    """Trusted and other rows have the same words in other pairs."""
    words = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(400):
        step = 7 if i % 2 else 11
        rows.append((i, " ".join(words[(i // 2 + k * step) % 400] for k in range(200))))
    docs = on_files(spark.createDataFrame(rows, "doc_id long, text string"))
    labels = spark.createDataFrame([(i, 1) for i in range(0, 400, 4)], "doc_id long, quality int")
    ratio = {r.doc_id: r.log_ratio for r in quality.quality_by_words(docs, labels).collect()}
    assert min(ratio[i] for i in range(0, 400, 2)) > 0 > max(ratio[i] for i in range(1, 400, 2)) + 1


def test_all_labels_count(spark, tmp_path):
    """If every row is trusted the ratio is 0, also with more labels than the small model's sample takes."""
    n = ngrams.TARGET_ROWS + 5_000
    rows = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and number"), F.pmod("id", F.lit(977)), F.lit(" again")).alias("text"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    assert quality.op3_quality_rules(spark, str(tmp_path)).where(F.abs("log_ratio") > 1e-12).count() == 0


def test_passes_add_up(spark, monkeypatch):
    """Each pass holds a range of the grams, is stored before the next, and all add up to one pass."""
    docs = on_files(edge.frame(spark))
    labels = spark.createDataFrame([(6, 1), (14, 1)], "doc_id long, quality int")
    sums = lambda: sorted((*r.place, r.n_grams, round(r.log_sum, 6)) for r in ngrams.word_sums(docs, labels, F.col("quality") == 1).collect())
    once, stored, store = sums(), [], ngrams.store
    monkeypatch.setattr(ngrams, "PART_GRAMS", 5000)
    monkeypatch.setattr(ngrams, "store", lambda df, kind: stored.append(kind) or store(df, kind))
    assert sums() == once and len(once) > 10
    assert stored == ["sums"] * ngrams.PASSES
