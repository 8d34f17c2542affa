import collections
import re

import duckdb
import edge
import pytest

from sweepframe.llm import mixing

words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shares(sizes, weights, total, most):
    """Targets by sharing the excess again and again."""
    target = dict.fromkeys(sizes, 0.0)
    free, left = set(sizes), total
    while free and left > 1e-9:
        unit = left / sum(weights[s] for s in free)
        full = {s for s in free if unit * weights[s] >= most * sizes[s] - 1e-12}
        if not full:
            for s in free:
                target[s] = unit * weights[s]
            break
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= full
    return target


def check(found, rows, block, share=1.5, most=2.0):
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target = shares(sizes, weights, share * sum(sizes.values()), most)
    taken = collections.Counter()
    for r in found:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken <= most * r.size
        assert r.taken == r.whole * r.size + sum(s.length for s in r.spans)
        assert all(0 <= s.start and s.start + s.length <= r.size for s in r.spans)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 2 * block * (1 + len(rows) ** 0.5), (s, taken[s], target[s])


@pytest.mark.parametrize("block, shard", [(64, 1 << 20), (4, 2000), (1, 50)])
def test_edge_rows(spark, block, shard):
    docs = edge.frame(spark)
    found = mixing.plan(docs, block_words=block, shard_words=shard).collect()
    assert sorted((r.doc_id or -1, r.size) for r in found) == sorted((t[0] or -1, len(words(t[1]))) for t in edge.TEXTS)
    check(found, edge.TEXTS, block)
    again = mixing.plan(docs, block_words=block, shard_words=shard).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in again) == sorted((r.doc_id or -1, r.taken) for r in found)


def test_mix_holds_what_the_plan_takes(spark):
    docs = edge.frame(spark)
    mixed = mixing.mix(docs, block_words=4, shard_words=2000)
    assert mixed.columns == docs.columns
    got, want = collections.Counter(), collections.Counter()
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
    for r in mixing.plan(docs, block_words=4, shard_words=2000).collect():
        want[r.doc_id] += r.taken
    assert got == +want


def test_empty_table(spark):
    assert mixing.plan(edge.empty(spark)).count() == 0
    assert mixing.mix(edge.empty(spark)).count() == 0


def test_highest_quotients(spark):
    """Against plain enumeration, with ties and a part without a claim."""
    claims = {"a": 10.0, "b": 10.0, "c": 3.0, "d": 0.0, "e": 7.5, None: 1.0}
    for seats in (0, 1, 2, 5, 17, 100):
        parts = spark.createDataFrame([(1, n, c, seats) for n, c in claims.items()], "g int, name string, claim double, seats long")
        got = {r.name: r.quota for r in mixing.apportion(parts, ["g"], ["name"], "claim", "seats").collect()}
        quotients = sorted(((-c / (2 * j + 1), n is None, n or "", j) for n, c in claims.items() if c for j in range(seats)))[:seats]
        want = collections.Counter(None if q[1] else q[2] for q in quotients)
        assert got == {n: want[n] for n in claims}, seats


def test_sql(spark, tmp_path):
    """The check in SQL also holds with several shards a source."""
    rows = [(i, " ".join(f"w{j}" for j in range(i * 7 % 23)), "en", f"s{i % 5}", 0, *["c"] * len(edge.CLASHES)) for i in range(300)]
    edge.frame(spark, rows).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    sql = mixing.ORACLE.replace(str(mixing.SHARD_WORDS), "150")
    found = mixing.plan(spark.read.parquet(str(tmp_path / "d")), shard_words=150).collect()
    assert sorted((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in found) == sorted(con.execute(sql).fetchall())
