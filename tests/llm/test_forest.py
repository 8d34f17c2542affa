import random
import re

import edge
import numpy as np
import pytest
from conftest import SF

from sweepframe.llm import forest


def grams(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def by_hand(rows):
    """``(doc_id, n, component_id, kept)`` of rows ``(doc_id, text)``, by comparing all sets."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), c, d == c) for i, ((d, _), s) in enumerate(zip(rows, sets)) for c in [least.get(find(i)) if s else d]), key=repr)


def found(spark, rows):
    made = forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((tuple(r) for r in made.collect()), key=repr)


def test_edge_rows(spark):
    rows = [(t[0], t[1]) for t in edge.TEXTS]
    made = sorted((tuple(r) for r in forest.near_duplicates(edge.frame(spark)).collect()), key=repr)
    assert made == by_hand(rows)
    assert forest.near_duplicates(edge.empty(spark)).count() == 0


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in forest.op11_lsh_forest(spark, SF).collect()), key=repr) == by_hand(rows)


def letters(count, slots, words=120, seed=1):
    """Form letters: one text with slots of 20 values, so that all are alike and few pairs reach 0.8."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(count):
        one = list(base)
        for s in range(slots):
            one[s * (words // slots)] = f"slot{s}v{rng.randrange(20)}"
        rows.append((i, " ".join(one)))
    return rows


@pytest.mark.parametrize(("slots", "seed"), [(5, 1), (8, 2)])
def test_crowds_of_form_letters(spark, slots, seed):
    rows = letters(400, slots, seed=seed)
    want = by_hand(rows)
    assert len({r[2] for r in want}) > 1 or slots == 5
    assert found(spark, rows) == want


def test_crowds_around_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        near = [f"w{j}" for j in range(200)]
        for at in rng.sample(range(200), rng.randrange(0, 12)):
            near[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(near)))
    assert found(spark, rows) == by_hand(rows)


def test_rest_is_whole_without_the_steps_before(spark, monkeypatch):
    """Small blocks: every pair of a crowd is met although no block holds it."""
    monkeypatch.setattr(forest, "BLOCK_SETS", 30)
    monkeypatch.setattr(forest, "BLOCK", 2000)
    rows = letters(150, 7, seed=4)
    assert found(spark, rows) == by_hand(rows)


def test_intersections_of_blocks():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 3000, rng.integers(1, 400))) for _ in range(40)]
    pack = lambda few: (np.concatenate(few), np.concatenate([[0], np.cumsum([len(s) for s in few])]))
    made = forest._common(pack(sets[:25]), pack(sets[20:]))
    assert (made == [[len(np.intersect1d(x, y)) for y in sets[20:]] for x in sets[:25]]).all()
