import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.llm import rtree

SCHEMA = "vec_id long, embedding array<double>, label int, page string, q string, row string, dims string, w string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


def by_hand(rows, positives=5, negatives=10):
    good = [(i, v, [math.floor(256 * x) for x in e], lab) for i, (v, e, lab) in enumerate(rows)
            if lab is not None and e is not None and all(x is not None and math.isfinite(x) and abs(256 * x) < rtree.LARGEST for x in e)]
    out = []
    for r, a, q, lab in good:
        if a is None or a % 10:
            continue
        scored = [(-sum(x * y for x, y in zip(q, p)), v is None, v or 0, s, v, other) for s, v, p, other in good if s != r and len(p) == len(q)]
        same = sorted((x for x in scored if x[5] == lab), key=lambda x: x[:4])[:positives]
        for p in same:
            hard = sorted((x for x in scored if x[5] != lab and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0]), key=lambda x: x[:4])[:negatives]
            out += [(a, p[4], k + 1, n[4], -p[0], -n[0]) for k, n in enumerate(hard)]
    return sorted(out, key=repr)


def found(spark, rows, **sizes):
    return sorted((tuple(r) for r in rtree.hard_negatives(frame(spark, rows), F.col("vec_id") % 10 == 0, **sizes).collect()), key=repr)


def clusters(count, dims=6, seed=0):
    """Vectors around a few centres, so that boxes can be pruned; many ties by coarse values."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(i, np.round(centres[i % 5] + 0.4 * rng.normal(size=dims), 1).tolist(), int(rng.integers(0, 4))) for i in range(count)]


@pytest.mark.parametrize("sizes", [{}, {"page": 40, "leaf": 4}, {"page": 25, "leaf": 3, "directory": 3}])
def test_against_all_pairs(spark, sizes):
    rows = clusters(300)
    want = by_hand(rows)
    assert len(want) > 500
    assert found(spark, rows, **sizes) == want


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (10, None, 1), (20, [1.0, None], 1), (30, [nan, 1.0], 1), (40, [inf, 1.0], 2), (50, [1.0, 0.5], None),
            (None, [0.5, 0.25], 2), (None, [0.9, 0.4], 1), (3, [0.5, 0.2], 2), (3, [0.5, 0.2], 2), (4, [0.7, 0.1], 3), (60, [0.3], 1), (61, [0.9], 1), (62, [0.2], 2),
            (70, [], 1), (71, [], 2), (80, [-1.0, -1.0], 1), (90, [0.0, 0.0], 5), (91, [0.0, 0.0], 5), (92, [0.0, 0.0], 6), (93, [1e30, 0.0], 1), (5, [0.4, 0.3], -3)]
    assert found(spark, rows) == by_hand(rows)
    assert found(spark, rows, page=2, leaf=1) == by_hand(rows)
    assert found(spark, rows[:0]) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []


def test_a_third_of_the_rows_is_one_vector(spark):
    rows = clusters(200) + [(1000 + i, [0.5] * 6, i % 2) for i in range(100)]
    tiles = rtree.tiled(rtree.quantised(frame(spark, rows), "vec_id", "embedding", "label", 256), 20)
    assert max(r["count"] for r in tiles.groupBy("page").count().collect()) <= 40
    assert found(spark, rows, page=20, leaf=4) == by_hand(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-130_000, 130_000, 40) + 0.5).tolist(), int(i % 3)) for i in range(60)]
    assert found(spark, rows, page=16, leaf=4) == by_hand(rows)


def test_boxes_are_pruned():
    """Of two far clusters the queue opens one: the other's box lies strictly below the k-th score."""
    q = np.concatenate([np.full((64, 4), 100) + np.arange(64)[:, None], np.full((64, 4), -100)]).astype("<i4")
    page = {"rows": list(range(128)), "ids": list(range(128)), "dims": 4, "labels": [1] * 128, "q": q.tobytes(), "leaves": list(range(0, 129, 8))}
    tree, opened = rtree.Tree(page), []

    class Seen(list):
        def __getitem__(self, i):
            opened.append(i)
            return list.__getitem__(self, i)

    tree.leaves = Seen(tree.leaves)
    ask = {"qid": -1, "label": 1, "q": [1, 1, 1, 1], "tops": [{"w": 0, "low": -1 << 62, "high": 1 << 62, "floor": -1 << 62}]}
    assert [h[2] for h in tree.search([ask], True, 5)] == [63, 62, 61, 60, 59]
    assert opened == [7]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    q, v = rng.integers(-50, 50, (20, 8)), rng.integers(-50, 50, (200, 8))
    low, high = v.reshape(10, 20, 8).min(axis=1), v.reshape(10, 20, 8).max(axis=1)
    least, most = rtree.bounds(q, low, high)
    scores = (q @ v.T).reshape(20, 10, 20)
    assert (least <= scores.min(axis=2)).all() and (scores.max(axis=2) <= most).all()
