"""Each stage on its own input, against plain Python where the stage's rule is plain, and on rows that are odd."""

import collections
import re

import corpus_pipeline
import edge
import pytest
from conftest import SF
from test_similar import firsts

from sweepframe.llm.common import store


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage got and gave on the whole table."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = store(stage(spark, docs, SF), name)
        assert made.columns == docs.columns
        out[name] = docs.collect(), made.collect()
        docs = made
    out["packing"] = docs.collect(), corpus_pipeline.packing_stage(spark, docs, SF).collect()
    return out


def kept(pair):
    before, after = ({r.doc_id: r for r in rows} for rows in pair)
    assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    return before, after


def test_language(stages):
    before, after = kept(stages["language_id"])
    assert all(re.search(r"[^\W\d_]", r.text) for r in after.values())
    assert len(after) == len(before)  # every document here has words of a known language


def test_exact(stages):
    before, after = kept(stages["exact_dedup"])
    groups = collections.defaultdict(list)
    for r in before.values():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text)].append((-len(r.text), r.doc_id))
    assert set(after) == {min(g)[1] for g in groups.values()}


def test_near(stages):
    before, after = kept(stages["simhash_dedup"])
    assert set(after) == firsts([(i, r.text) for i, r in before.items()])


def test_mixing(stages):
    before, after = stages["mixing"]
    texts, taken = {r.doc_id: r.text for r in before}, collections.Counter()
    for r in after:
        taken[r.doc_id] += len(words(r.text))
        assert r.n_chars == len(r.text)
        assert set(words(r.text)) <= set(words(texts[r.doc_id]))
    sizes = {i: len(words(t)) for i, t in texts.items()}
    assert all(n <= 2 * sizes[i] for i, n in taken.items())
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.02 * sum(sizes.values())


def test_packing(stages):
    before, pieces = stages["packing"]
    filled = collections.Counter()
    for p in pieces:
        filled[p.sequence_id] += p.length
    assert sum(n != 1024 for n in filled.values()) <= 1
    assert collections.Counter(p.doc_id for p in pieces if p.start == 0) == collections.Counter(r.doc_id for r in before)


def text_groups(rows):
    """Numbers of rows with the same text but for white space."""
    return collections.Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in rows)


def test_language_of_odd_rows(spark):
    docs = edge.frame(spark)
    got = corpus_pipeline.language_stage(spark, docs, "").collect()
    assert got and all(re.search(r"[^\W\d_]", r.text) for r in got)
    assert not {1, 2, 3, 13} & {r.doc_id for r in got}
    assert set(map(tuple, got)) <= set(map(tuple, docs.collect()))


def test_exact_of_odd_rows(spark):
    docs = edge.frame(spark)
    got = corpus_pipeline.exact_stage(spark, docs, "").collect()
    assert got[0].asDict().keys() == docs.first().asDict().keys()
    assert text_groups(got) == dict.fromkeys(text_groups(docs.collect()), 1)
    assert len({r.doc_id for r in got} & {1, 2, 3}) == 1


def test_near_of_odd_rows(spark):
    docs = edge.frame(spark)
    got = corpus_pipeline.near_stage(spark, docs, "").collect()
    assert set(map(tuple, got)) <= set(map(tuple, docs.collect()))
    assert [r.doc_id for r in got if not words(r.text)] == [1]
    assert sum(r.text == edge.PASSAGE + " and more" for r in got) <= 1


def test_mixing_of_odd_rows(spark):
    docs = edge.frame(spark)
    got = corpus_pipeline.mixing_stage(spark, docs, "").collect()
    assert list(got[0].asDict()) == docs.columns
    assert all(r.n_chars == len(r.text or "") for r in got)
    there = {r.text for r in docs.collect()}
    assert all(any(r.text in (t or "") or set(words(r.text)) <= set(words(t)) for t in there) for r in got)


def test_packing_of_odd_rows(spark):
    docs = edge.frame(spark)
    got = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert collections.Counter(p.doc_id for p in got if p.start == 0) == collections.Counter(r.doc_id for r in docs.collect())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, stage):
    assert stage(spark, edge.empty(spark), "").count() == 0


def test_run_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
