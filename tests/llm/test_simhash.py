import collections
import re

import edge
import numpy as np
import pytest
import xxhash

from sweepframe.llm import simhash


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64(" ".join(words[i:i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values):
    """Smallest member of each value's component."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = sorted(root)
    x = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1:] ^ x[i]) <= 2):
            a, b = find(v), find(values[i + 1 + int(j)])
            root[max(a, b)] = min(a, b)
    return {v: find(v) for v in values}


def test_edge_rows(spark):
    prints = [by_hand(t[1]) for t in edge.TEXTS]
    classes, least = components(prints), collections.defaultdict(lambda: None)
    for t, f in zip(edge.TEXTS, prints):
        known = least[classes[f]]
        least[classes[f]] = t[0] if known is None else known if t[0] is None else min(known, t[0])
    want = sorted(((t[0], f"{f:016x}", least[classes[f]]) for t, f in zip(edge.TEXTS, prints)), key=repr)
    found = simhash.near_groups(edge.frame(spark)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in found), key=repr) == want
    assert sum(r["first"] for r in found) == len(set(classes.values()))
    assert simhash.near_groups(edge.empty(spark)).count() == 0


@pytest.mark.parametrize("crowd", [1000, 3, 1])
def test_links_of_crowded_segments(spark, crowd):
    rng = np.random.default_rng(0)
    values = []
    for base in rng.integers(0, 1 << 63, 4, dtype=np.uint64):
        for _ in range(50):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(bit)
            values.append(x)
    table = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "f long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(table, crowd).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {v: find(v) for v in root} == components(values)
