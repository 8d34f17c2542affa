import random

import corpus_pipeline
import edge
import pytest

from sweepframe.llm import forest, similar


def grams(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def firsts(rows):
    """Smallest identifier of each component by brute force."""
    sets, root = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if j < i and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {find(i) for i in root}


def planted(copies, seed=3):
    """Texts of 60 to 400 words, each with copies that have a few words replaced: similarity about 0.7 to 1."""
    rng, rows = random.Random(seed), []
    for k in range(30):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        rows.append(words)
        for _ in range(copies):
            near = list(words)
            for at in rng.sample(range(len(near)), max(1, int(len(near) * rng.uniform(0.0, 0.035)))):
                near[at] = f"x{rng.randrange(10**6)}"
            rows.append(near)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


def test_near_stage_finds_planted_copies(spark):
    rows = planted(4)
    want = firsts(rows)
    assert 30 <= len(want) < 100
    docs = edge.frame(spark, [(i, t, "en", "a", len(t), *["clash"] * len(edge.CLASHES)) for i, t in rows])
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == want


@pytest.mark.parametrize("crowd", [1000, 8, 2])
def test_crowds(spark, crowd, monkeypatch):
    monkeypatch.setattr(forest, "CROWD", crowd)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(150):
        near = list(words)
        for at in rng.sample(range(300), rng.choice([3, 8, 14])):
            near[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(near)))
    found = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found if r["first"]} == firsts(rows)


def test_copies_in_a_crowd_of_form_letters(spark):
    """Letters that are all alike but below the threshold, with copies of some at 0.8 to 0.95: the same rows stay as by brute force."""
    rng = random.Random(9)
    letter = lambda: [f"slot{k}v{rng.randrange(20)}" if k % 16 == 0 else f"w{k}" for k in range(160)]
    rows = [letter() for _ in range(900)]
    for i in range(60):
        near = list(rows[i])
        for at in rng.sample(range(160), 1 + i % 3):
            near[at] = f"x{rng.randrange(10**6)}"
        rows.append(near)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    want = firsts(rows)
    assert 850 < len(want) < 915
    found = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found if r["first"]} == want


def test_edge_rows(spark):
    found = similar.similar_groups(edge.frame(spark)).collect()
    assert len(found) == len(edge.ROWS)
    groups = {}
    for r in found:
        groups.setdefault(r.component, []).append(r)
    assert all(sum(r["first"] for r in g) == 1 for g in groups.values())
    assert sorted(r.doc_id for r in found if r["first"] and r.doc_id in (1, 2, 3)) == [1]
    assert similar.similar_groups(edge.empty(spark)).count() == 0
