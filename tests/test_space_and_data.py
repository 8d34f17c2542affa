"""Tracks, places, pens, audits, splits, hashes and vectors on small fixed inputs."""

import math
import random
import tracemalloc

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from sweepframe.catalog import QUERIES, pixels
from sweepframe.operators import boxpairs, governance, pens, spatial, vectors, vision

MOTION = "clip string, i int, dx_px double, dy_px double, standoff double, depth_m double"


def track(spark, steps, standoff=1.0, **options):
    rows = [("c", i, *(d if d is not None else (None, None)), standoff, 1.0) for i, d in enumerate(steps)]
    return spatial.build_track(spark.createDataFrame(rows, MOTION), ["i"], **options).orderBy("i")


def test_straight_pass(spark):
    t = track(spark, [(0.0, 0.0)] + [(-40.0, 0.0)] * 10, mm_per_px_at_1m=2.0).collect()
    assert t[0]["along_m"] == 0.0 and abs(t[-1]["along_m"] - 0.80) < 1e-9 and t[-1]["orient"] == 1.0
    drift = [r["drift_m"] for r in t]
    assert drift == sorted(drift) and abs(drift[-1] - 0.04) < 1e-9


def test_gap_in_the_track_stays_visible(spark):
    t = track(spark, [None, (-40.0, 0.0), (-40.0, 0.0), None, (-40.0, 0.0)]).collect()
    assert [r["matched"] for r in t] == [True, True, True, False, True]
    assert t[3]["along_m"] == t[2]["along_m"]


def test_backward_pass_is_rotated_not_mirrored(spark):
    t = track(spark, [(0.0, 0.0)] + [(40.0, 10.0)] * 10, mm_per_px_at_1m=2.0).collect()[-1]
    assert t["orient"] == -1.0 and t["along_m"] > 0 and abs(t["across_m"] / t["along_m"] - 0.25) < 1e-3


def test_coverage_and_gaps(spark):
    t = track(spark, [(0.0, 0.0), (-100.0, 0.0), (-400.0, 0.0)], mm_per_px_at_1m=1.0)
    (gap,) = spatial.coverage_gaps(t, ["i"], frame="i").collect()
    assert (gap["from_frame"], gap["to_frame"], gap["gap_m"]) == (1, 2, 0.4)
    c = spatial.swept_coverage(t, 500).first()
    assert (c["along_extent_m"], c["mean_footprint_m"], c["swept_area_m2"], c["frames"]) == (0.5, 0.5, 0.25, 3)


def test_path_validation_reasons(spark):
    t = track(spark, [(0.0, 0.0), (-100.0, 0.0)], mm_per_px_at_1m=1.0)
    told = lambda m: spark.createDataFrame([("c", m)], "clip string, telemetry_path_m double")
    r = spatial.path_validation(t, told(0.11), ["i"], frame="i").first()
    assert r["comparable"] and r["agrees_within_20pct"]
    assert spatial.path_validation(t, told(0.0), ["i"], frame="i").first()["reason"] == "no telemetry distance"
    short = track(spark, [(0.0, 0.0)])
    assert spatial.path_validation(short, told(1.0), ["i"], frame="i").first()["reason"] == "track too short"


@pytest.mark.parametrize("pairs,error", [
    ([(10.0, 0.02, 0.5)] * 6, None), ([(10.0, 0.0, 0.5)] * 6, "no motion to calibrate against"), ([(0.0, 0.1, 0.5)] * 6, "need at least 5 usable frame pairs"),
    ([(10.0, 0.02, 0.5)] * 3, "need at least 5 usable frame pairs"),
])
def test_calibration(spark, pairs, error):
    df = spark.createDataFrame(pairs, "px double, m double, standoff double")
    r = spatial.calibrate_scale(df, image_width_px=1000).first()
    assert r["error"] == error
    if error is None:
        assert r["mm_per_px_at_1m"] == 4.0 and r["reference_standoff_m"] == 0.5 and abs(r["implied_hfov_deg"] - 126.9) < 0.1


SEEN = "clip string, i int, along_m double, across_m double, depth_m double, width_mm double, height_mm double, score double, x1 double, y1 double, x2 double, y2 double"


def sightings(spark, points, clip="c"):
    return spark.createDataFrame([(clip, i, float(x), float(y), 1.0, 10.0, 20.0, i / 100, 0.0, 0.0, 1.0, 1.0) for i, (x, y) in enumerate(points)], SEEN)


def test_single_linkage_chains(spark):
    s = spatial.cluster_sites(sightings(spark, [(0, 0), (0.2, 0), (0.4, 0), (5, 5)]), ["i"], frame="i").collect()
    assert [r["sightings"] for r in s] == [3, 1]
    assert (s[0]["first_frame"], s[0]["last_frame"], s[0]["best_frame"]) == (0, 2, 2) and s[0]["evidence"].startswith("moderate")
    assert "3 sightings" in s[0]["description"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_linkage_against_all_pairs(spark, seed):
    rnd = random.Random(seed)
    pts = [(round(rnd.uniform(-1.5, 1.5), 3), round(rnd.uniform(-1.5, 1.5), 3)) for _ in range(120)] + [(0.5, 0.5)] * 5
    got = spatial.link_within(sightings(spark, pts), 0.2013).collect()
    parent = list(range(len(pts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pts)):
        for j in range(i):
            if math.dist(pts[i], pts[j]) <= 0.2013:
                parent[find(i)] = find(j)
    label = {r["i"]: r["component"] for r in got}
    assert len(label) == len(pts)
    for i in range(len(pts)):
        for j in range(i):
            assert (label[i] == label[j]) == (find(i) == find(j))


def test_linkage_is_the_same_within_and_across_tasks(spark, monkeypatch):
    """Places of keys that fit a task are those of the cell tables; edges are compared a few pairs at a time."""
    rnd = random.Random(5)
    shape = [(round(rnd.uniform(-1.2, 1.2), 3), round(rnd.uniform(-1.2, 1.2), 3)) for _ in range(150)] + [(0.5, 0.5)] * 5
    seen = sightings(spark, shape).unionByName(sightings(spark, [(y + 40.0, -x) for x, y in shape[:70]], "d")).cache()

    def places():
        found = {}
        for r in spatial.link_within(seen, 0.1503).collect():
            found.setdefault((r["clip"], r["component"]), set()).add(r["i"])
        return sorted((clip, tuple(sorted(i))) for (clip, _), i in found.items())

    monkeypatch.setattr(spatial, "_PAIRS", 7)
    within = places()
    spark.conf.set("spark.sweepframe.groupRows", "20")
    try:
        assert places() == within
    finally:
        spark.conf.unset("spark.sweepframe.groupRows")


def test_min_sightings(spark):
    assert spatial.cluster_sites(sightings(spark, [(0, 0), (9, 9), (9, 9.1)]), ["i"], frame="i", min_sightings=2).count() == 1


def test_localise_rotates_with_the_track(spark):
    t = spark.createDataFrame([("f", 1.0, 0.0, 2.0, -1.0, 0.1)], "frame string, along_m double, across_m double, mm_per_px double, orient double, drift_m double")
    d = spark.createDataFrame([("f", 60.0, 50.0, 80.0, 50.0)], "frame string, x1 double, y1 double, x2 double, y2 double")
    r = spatial.localise(d, t, ["frame"], 100, 100).first()
    assert (r["along_m"], r["across_m"], r["width_mm"], r["height_mm"]) == (0.96, 0.0, 40.0, 0.0)


def test_diagonal_cells_are_one_region(spark):
    cells = spark.createDataFrame([("f", 0, 0, 0.9), ("f", 1, 1, 0.5), ("f", 3, 3, 0.4), ("f", 2, 0, 0.1)], "frame string, row int, col int, score double")
    boxes = spatial.grid_components(cells, 0.4, rows=4, cols=4, width_px=40, height_px=40).orderBy("x1").collect()
    assert [(b["x1"], b["y1"], b["x2"], b["y2"], b["cells"]) for b in boxes] == [(0.0, 0.0, 20.0, 20.0, 2), (30.0, 30.0, 40.0, 40.0, 1)]
    assert boxes[0]["score"] == 1.0 and boxes[1]["score"] == 0.5


def test_regions_of_many_grids(spark, monkeypatch):
    """Random grids against a flood fill, a few cells at a time; repeated cells count each, odd cells are left out."""
    monkeypatch.setattr(spatial, "_CELLS", 40)
    rng, rows, want = np.random.default_rng(5), [], []
    for f in range(30):
        grid = {(r, c): float(rng.uniform()) for r in range(7) for c in range(9)}
        rows += [(f, r, c, s) for (r, c), s in grid.items()]
        hot, seen = {k for k, s in grid.items() if s >= 0.6}, set()
        for start in sorted(hot):
            if start in seen:
                continue
            todo, part = [start], set()
            while todo:
                at = todo.pop()
                if at in part or at not in hot:
                    continue
                part.add(at)
                todo += [(at[0] + i, at[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
            seen |= part
            (r0, r1), (c0, c1) = ((min(v), max(v)) for v in zip(*part))
            top = max(grid[k] for k in hot if r0 <= k[0] <= r1 and c0 <= k[1] <= c1)
            want.append((f, c0 * 10.0, r0 * 10.0, (c1 + 1) * 10.0, (r1 + 1) * 10.0, round(top / 1.2, 9), len(part)))
    cells = spark.createDataFrame(rows + [(0, None, 3, 0.9), (0, 3, 3, None)], "frame int, row int, col int, score double")
    got = spatial.grid_components(cells, 0.6, rows=7, cols=9, width_px=90, height_px=70).collect()
    assert sorted((r["frame"], r["x1"], r["y1"], r["x2"], r["y2"], round(r["score"], 9), r["cells"]) for r in got) == sorted(want)
    assert spatial.grid_components(cells.limit(0), 0.6, rows=7, cols=9, width_px=90, height_px=70).count() == 0


def test_pens(spark):
    p = spark.createDataFrame([(1, 160.0, 15.0, 10.0), (2, -1.0, 15.0, 10.0), (3, 160.0, 0.0, 0.0), (4, 160.0, -1.0, 5.0)], "pen_id int, circumference_m double, cylinder_depth_m double, cone_depth_m double")
    good, bad = pens.pen_geometry(p)
    assert good.count() == 1 and {r["pen_id"] for r in bad.collect()} == {2, 3, 4}
    r = good.first()
    assert abs(r["net_area_m2"] - (160 * 15 + math.pi * r["radius_m"] * math.hypot(r["radius_m"], 10))) < 1e-9
    at = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 40.0, 20.0), (1, 2, 120.0, None), (1, 3, 0.0, 99.0)], "pen_id int, n int, along_m double, depth_m double")
    a, b, c, d = pens.place_on_pen(at, good).orderBy("n").collect()
    assert (a["bearing_deg"], a["section"], a["side"]) == (0.0, "wall", "at the barge")
    assert (b["bearing_deg"], b["section"], b["side"], b["arc_from_barge_m"]) == (90.0, "cone", "clockwise", 40.0)
    assert (c["side"], c["z_m"], c["arc_from_barge_m"]) == ("anticlockwise", 0.0, 40.0)
    assert d["x_m"] == 0.0 and d["y_m"] == 0.0, "the cone ends in a point"
    cov = pens.coverage_of_net(spark.createDataFrame([(1, 10.0, 0.0), (1, 10.0, 40.0)], "pen_id int, swept_area_m2 double, along_extent_m double"), good).orderBy("along_extent_m").collect()
    assert [x["passes_to_cover_ring"] for x in cov] == [None, 4]


# Governance ------------------------------------------------------------------------------

SAMPLE = "image string, grp string, width int, height int"
BOX = "image string, cls int, x1 double, y1 double, x2 double, y2 double"


def issues(spark, samples, boxes):
    return {r["kind"]: r for r in governance.audit(spark.createDataFrame(samples, SAMPLE), spark.createDataFrame(boxes, BOX)).collect()}


def test_audit_kinds(spark):
    samples = [(f"i{n}", f"g{n % 2}", 10, 10) for n in range(12)] + [("dead", "g0", 0, 0)]
    boxes = [(f"i{n}", n % 2, 0.1, 0.1, 0.2, 0.2) for n in range(12)] + [("dead", 0, 0.5, 0.5, 0.5, 0.9), ("i1", 0, 0.1, 0.1, 0.1001, 0.1001), ("i2", 0, 0.5, 0.5, 40.0, 0.6)]
    got = issues(spark, samples, boxes)
    assert set(got) == {"unreadable", "degenerate_box", "suspiciously_small", "box_out_of_bounds", "too_few_groups", "class_imbalance", "few_negatives"}
    assert got["degenerate_box"]["severity"] == "error" and got["suspiciously_small"]["severity"] == "warning"
    assert got["degenerate_box"]["files"] == ["dead"] and got["few_negatives"]["count"] == 0


def test_audit_of_nothing_and_of_unlabelled(spark):
    assert set(issues(spark, [], [])) == {"empty"}
    assert "no_labels" in issues(spark, [("a", "g", 1, 1)], [])


def test_examples_are_limited_not_counts(spark):
    got = issues(spark, [(f"i{n:02d}", f"g{n}", 0, 0) for n in range(20)], [])
    assert got["unreadable"]["count"] == 20 and got["unreadable"]["files"] == [f"i{n:02d}" for n in range(8)]


def test_grouped_split(spark):
    """Whole groups, near the ratios, and the same answer whatever the plans count as large."""
    data = [(f"c{g}_{i}", f"c{g}") for g in range(60) for i in range(5 + g % 4)] + [(f"hot_{i}", "hot") for i in range(90)]
    df = spark.createDataFrame(data, "image string, grp string")
    answers = []
    for limit in ("1000000", "8"):
        spark.conf.set("spark.sweepframe.groupRows", limit)
        try:
            answers.append({r["grp"]: r["split"] for r in governance.grouped_split(df, seed=1).collect()})
        finally:
            spark.conf.unset("spark.sweepframe.groupRows")
    assert answers[0] == answers[1] and len(answers[0]) == 61
    n = {s: sum(answers[0][g] == s for _, g in data) / len(data) for s in ("train", "val", "test")}
    assert abs(n["train"] - 0.7) < 0.25 and min(n.values()) > 0
    whole = df.withColumn("split", F.lit("train"))
    assert governance.straddling_groups(whole).count() == 0
    assert governance.straddling_groups(whole.unionByName(whole.limit(1).withColumn("split", F.lit("val")))).count() == 1


def test_four_large_groups_fill_every_split(spark):
    df = spark.createDataFrame([(f"c{g}",) for g in range(4) for _ in range(40)], "grp string")
    assert {r["split"] for r in governance.grouped_split(df).collect()} == {"train", "val", "test"}


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError, match="sum to 1"):
        governance.grouped_split(spark.createDataFrame([("a",)], "grp string"), ratios=(0.5, 0.2, 0.2))


def test_hash_split_is_stable(spark):
    df = spark.range(3000).select(F.col("id").alias("image"))
    n = {r["split"]: r["count"] for r in governance.hash_split(df, "image").groupBy("split").count().collect()}
    assert abs(n["train"] - 2100) < 150 and abs(n["val"] - 450) < 120


# Hashes ----------------------------------------------------------------------------------


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


@pytest.mark.parametrize("bucket_rows", [10_000, 3])
def test_near_duplicates_against_all_pairs(spark, bucket_rows):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(40)] + [rnd.getrandbits(13) << 51 for _ in range(20)] + [0, (1 << 64) - 1]
    data = [("a", f"a{i}", h) for i, h in enumerate(base)]
    for i, h in enumerate(base):
        for bit in rnd.sample(range(64), rnd.randrange(0, 7)):
            h ^= 1 << bit
        data.append(("b", f"b{i}", h))
    data.append(("b", "copy", base[0]))
    df = spark.createDataFrame([(s, n, signed(h)) for s, n, h in data], "split string, image string, h bigint")
    out = vision.near_duplicates(df, 4, bucket_rows=bucket_rows).collect()
    got = {(r["hash_a"], r["hash_b"], r["distance"]) for r in out}
    assert len(out) == len(got)
    want = {(signed(x), signed(y), (x ^ y).bit_count()) for s, _, x in data for t, _, y in data if s < t and (x ^ y).bit_count() <= 4}
    assert got == want


def test_a_bucket_of_many_hashes_is_cut_until_it_is_calm(spark):
    """Hashes that all share a band, and mostly another: few pairs are compared, none is lost or told twice."""
    rng = random.Random(2)
    values = [(rng.getrandbits(20) << 26) | 0x155 for _ in range(700)]
    values += [v ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for v in values[:80]]
    rows = [("ab"[i % 2], f"i{i}", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "split string, image string, h bigint")
    found = sorted((r["hash_a"], r["hash_b"], r["distance"]) for r in vision.near_duplicates(df, 4, bucket_rows=20).collect())
    sides = [{h for s, _, h in rows if s == k} for k in "ab"]
    assert found == sorted((x, y, (x ^ y).bit_count()) for x in sides[0] for y in sides[1] if (x ^ y).bit_count() <= 4)
    wide = vision.near_duplicates(df, 4, bucket_rows=10_000).collect()
    assert found == sorted((r["hash_a"], r["hash_b"], r["distance"]) for r in wide)


def test_crowded_cells_are_cut(spark):
    rng = np.random.default_rng(3)
    at = rng.uniform(0, 60, size=(300, 2))
    boxes = [("i", i, float(x), float(y), float(x + w), float(y + w)) for i, ((x, y), w) in enumerate(zip(at, rng.uniform(0.5, 4, 300)))]
    df = spark.createDataFrame(boxes, "image string, box_id int, x1 double, y1 double, x2 double, y2 double")
    key = lambda out: sorted((r["a_box_id"], r["b_box_id"], round(r["iou"], 9)) for r in out.collect())
    few, many = (key(boxpairs.overlapping_pairs(df, df, ["image"], crowd=c)) for c in (12, 10_000))
    assert few == many and len(many) > 600


def test_duplicates_inside_a_split_do_not_count(spark):
    df = spark.createDataFrame([("a", "x", 7), ("a", "y", 7)], "split string, image string, h bigint")
    assert vision.near_duplicates(df).count() == 0


def test_images_of_computed_hashes_are_found_without_broadcasts(spark):
    """Sizes that join by shuffle: the join on a hash that is an expression lost the column inside its lambda."""
    hashes = pixels.hashes(spark, SF)
    given = [(r["split"], r["image"], r["h"]) for r in hashes.collect()]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = vision.duplicated_images(hashes, vision.near_duplicates(hashes, 4, bits=56)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    near = {(s, h) for s, _, h in given for t, _, g in given if s != t and (h ^ g).bit_count() <= 4}
    assert sorted((r["split"], r["image"]) for r in out) == sorted((s, i) for s, i, h in given if (s, h) in near) and near


def test_difference_hash(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1.0, 5.0, 5.0, 6.0],)], "g array<double>")
    assert df.select(vision.difference_hash(F.col("g"), 3, 2)).first()[0] == 0b1001


# Vectors ---------------------------------------------------------------------------------


def features(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id bigint, v array<double>")


def test_gaussian_matches_numpy(spark):
    x = np.random.default_rng(1).normal(size=(200, 6)) * [1, 2, 3, 4, 5, 6]
    model = vectors.fit_gaussian(features(spark, x), "v")
    std = x.std(axis=0) + 1e-6
    z = (x - x.mean(axis=0)) / std
    inv = np.linalg.inv(0.9 * np.cov(z, rowvar=False) + 0.1 * np.eye(6))
    want = np.sqrt(np.einsum("ij,jk,ik->i", z, inv, z))
    got = [r["distance"] for r in vectors.mahalanobis(features(spark, x), "v", model).orderBy("id").collect()]
    assert np.allclose(got, want, atol=1e-8)
    with pytest.raises(ValueError, match="at least one"):
        vectors.fit_gaussian(features(spark, x).limit(0), "v")


@pytest.mark.parametrize(("bank_rows", "block"), [("50000", str(32 << 20)), ("7", str(32 << 20)), ("7", "96"), ("50000", "96")])
def test_nearest_in_bank(spark, bank_rows, block):
    rng = np.random.default_rng(2)
    x, b = rng.normal(size=(50, 4)), np.vstack([rng.normal(size=(30, 4)), np.ones((15, 4))])
    spark.conf.set(vectors.BANK_CONF, bank_rows)
    spark.conf.set(vectors.BLOCK_CONF, block)
    try:
        out = vectors.nearest_in_bank(features(spark, x), features(spark, b), "id", "v")
        got = [r["distance"] for r in out.orderBy("id").collect()]
        none = vectors.nearest_in_bank(features(spark, x[:3]), features(spark, b).limit(0), "id", "v").collect()
        assert vectors.nearest_in_bank(features(spark, x).limit(0), features(spark, b), "id", "v").count() == 0
    finally:
        spark.conf.unset(vectors.BANK_CONF)
        spark.conf.unset(vectors.BLOCK_CONF)
    assert np.allclose(got, np.linalg.norm(x[:, None] - b[None], axis=2).min(axis=1))
    assert [r["distance"] for r in none] == [None] * 3


def test_nearest_in_bank_leaves_far_cells_alone(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 5)) * 50
    b, x = (np.vstack([rng.normal(c, 0.5, size=(n, 5)) for c in centres]) for n in (20, 5))
    spark.conf.set(vectors.BLOCK_CONF, str(8 * 5 * 10))
    try:
        rows = vectors.nearest_in_bank(features(spark, x), features(spark, b), "id", "v", compared="pairs").orderBy("id").collect()
    finally:
        spark.conf.unset(vectors.BLOCK_CONF)
    assert np.allclose([r["distance"] for r in rows], np.linalg.norm(x[:, None] - b[None], axis=2).min(axis=1))
    assert sum(r["pairs"] for r in rows) < 0.5 * len(x) * len(b)


def test_nearest_compares_in_tiles_of_fixed_size(spark):
    """More rows and bank vectors than a tile, in parts, give the exact distances; memory does not grow with the block."""
    rng = np.random.default_rng(5)
    x, b = rng.normal(size=(2500, 3)), rng.normal(size=(3300, 3))
    want = np.linalg.norm(x[:, None] - b[None], axis=2).min(axis=1)
    assert np.allclose(vectors._nearest(x, [b[:7], b[7:1500], b[1500:]]), want)
    found = vectors.nearest_in_bank(features(spark, x), features(spark, b), "id", "v").orderBy("id").collect()
    assert np.allclose([r["distance"] for r in found], want)
    peaks = []
    for size in (4096, 65536):
        bank = rng.normal(size=(size, 8))
        tracemalloc.start()
        vectors._nearest(rng.normal(size=(2048, 8)), [bank])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 40 << 20 and peaks[1] < 1.2 * peaks[0]


@pytest.mark.parametrize("name", ["ood_calibrate_flag", "bank_threshold"])
def test_distances_to_the_bank_are_measured_once(spark, name):
    assert "CoGroup" not in QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("held", [400, 40, 20])
def test_kcenter_bank_spreads(spark, held):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.01, size=(20, 2)) for c in ((0, 0), (10, 0), (0, 10), (10, 10), (5, 5))])
    picks = vectors.kcenter_bank(features(spark, x), "id", "v", 5, held=held).collect()
    assert len(picks) == 5 and {int(r["id"]) // 20 for r in picks} == {0, 1, 2, 3, 4}
    with pytest.raises(ValueError, match="four times"):
        vectors.kcenter_bank(features(spark, x), "id", "v", 5, held=10)


def test_kcenter_radius_at_ten_times_the_rows(spark):
    """The tree's radius stays within a small factor of the sequential pick's, with the same memory per task."""
    rng = np.random.default_rng(6)
    for n in (300, 3000):
        x = rng.uniform(size=(n, 2))
        ids = [r["id"] for r in vectors.kcenter_bank(features(spark, x), "id", "v", 10, held=80).collect()]
        radius = lambda some: np.linalg.norm(x[:, None] - x[some][None], axis=2).min(axis=1).max()
        assert len(set(ids)) == 10 and radius(ids) <= 3 * radius(vectors._farthest(np.arange(n), x, 10))


def test_kcenter_where_keys_repeat(spark):
    """All rows under one key are one group: it is read piece by piece and still gives the spread rows."""
    rows = [(7, [float(c), float(i % 3) / 100]) for i in range(100) for c in (0, 10, 20)]
    picks = vectors.kcenter_bank(spark.createDataFrame(rows, "id bigint, v array<double>"), "id", "v", 3, held=12).collect()
    assert sorted(round(r["v"][0] / 10) for r in picks) == [0, 1, 2]
    assert vectors.kcenter_bank(spark.createDataFrame(rows[:0], "id bigint, v array<double>"), "id", "v", 3, held=12).count() == 0


@pytest.mark.parametrize("copies", [1, 3])
def test_kcenter_is_two_sequential_picks(spark, copies):
    """More picks of groups than a task may hold are one set of rows all the same, and copies of a pick are no picks."""
    from sweepframe.plans.seeded import draw

    x = np.random.default_rng(8).uniform(size=(600, 3)).repeat(copies, axis=0)
    f = features(spark, x)
    groups = np.array([r["g"] for r in f.select("id", (draw(0, "id") % (1 << int(np.ceil(np.log2(60 * copies))))).alias("g")).orderBy("id").collect()])
    first = np.sort(np.concatenate([np.flatnonzero(groups == g)[vectors._farthest(np.flatnonzero(groups == g), x[groups == g], 5)] for g in np.unique(groups)]))
    want = first[vectors._farthest(first, x[first], 5)]
    got = [r["id"] for r in vectors.kcenter_bank(f, "id", "v", 5, held=20).collect()]
    assert len(first) > 20 and sorted(got) == sorted(want.tolist())
    few = features(spark, np.eye(4).repeat(60, axis=0))
    assert vectors.kcenter_bank(few, "id", "v", 5, held=20).count() == 4


def test_random_bank_is_repeatable(spark):
    f = features(spark, np.eye(12))
    a, b = ({r["id"] for r in vectors.random_bank(f, "id", 5, seed=4).collect()} for _ in range(2))
    assert a == b and len(a) == 5
