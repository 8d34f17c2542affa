"""Operator 6 against plain Python and against SQL."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from sweepframe.llm import exact

ROWS = [
    (1, None, "a"), (2, " \t", "b"), (None, "x", "c"), (None, "x", "c"), (5, "x y", "d"), (6, "xy ", "d"), (7, "x y", "e"),
    (8, "é" * 50_000 + " z", "f"), (9, "é" * 50_000 + "z", "f"), (10, "x  y", "d"), (10, "x  y", "d"),
]
SCHEMA = "doc_id long, text string, group_size string"


def by_hand(rows):
    groups = {}
    for at, (doc_id, text, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, at))
    out = []
    for bare, members in groups.items():
        best = min(members)
        for m in members:
            name = lambda x: None if x[1] else x[2]
            out.append((name(m), name(best), len(members), hashlib.sha256(bare.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [exact.sha256, lambda c: F.substring(F.md5(c), 1, 1)])
def test_groups(spark, digest):
    got = exact.exact_dedup(spark.createDataFrame(ROWS, SCHEMA), digest=digest)
    found = got.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=repr) == by_hand(ROWS)
    kept = [r.text_sha256 for r in found if r.kept]
    assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in found})


def test_keep_first_has_the_rows_of_its_input(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 5


def test_empty_table(spark):
    assert exact.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_state_goes_on_with_new_files(spark, tmp_path):
    """A second run over a longer index adds to the state of the first."""
    index, state = str(tmp_path / "index"), str(tmp_path / "state")
    rows = lambda ids: spark.createDataFrame([(i, 1, b"k") for i in ids], "doc_id long, size long, digest binary").withColumn(
        "at", F.struct(F.lit("f").alias("file"), F.col("doc_id").alias("row")))
    rows([3, 4]).write.parquet(index)
    first = exact.absorb(spark, index, rows([1]).schema, state).collect()
    rows([2]).write.mode("append").parquet(index)
    second = exact.absorb(spark, index, rows([1]).schema, state).collect()
    assert [(r.n, r.best.doc_id) for r in first] == [(2, 3)]
    assert [(r.n, r.best.doc_id) for r in second] == [(3, 2)]
