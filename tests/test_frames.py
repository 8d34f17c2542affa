"""Statistics, gates, reports and planning on small fixed inputs."""

import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sweepframe.functions.intervals import wilson
from sweepframe.operators import gates, planning, reports, rubric, stats
from sweepframe.operators.gates import Band, Envelope
from sweepframe.plans import pin


def ci(spark, k, n):
    lo, hi = wilson(F.col("k"), F.col("n"))
    return tuple(spark.createDataFrame([(k, n)], "k bigint, n bigint").select(lo, hi).first())


def test_wilson(spark):
    assert ci(spark, 0, 0) == (None, None)
    lo, hi = ci(spark, 0, 20)
    assert lo == 0.0 and 0.15 < hi < 0.17
    lo, hi = ci(spark, 50, 100)
    assert abs(lo - 0.4038) < 1e-3 and abs(hi - 0.5962) < 1e-3
    with pytest.raises(Exception, match="out of range"):
        ci(spark, 5, 3)


def test_empty_group_has_no_rate(spark):
    r = stats.proportion(spark.createDataFrame([], "event int"), [], "event").first()
    assert (r["n"], r["k"], r["rate"], r["ci_lo"]) == (0, 0, None, None)


def bins(spark, data):
    return stats.with_rate(spark.createDataFrame(data, "bin int, lo double, hi double, n bigint, k bigint"))


def test_fit_needs_the_upper_bound(spark):
    few = bins(spark, [(0, 0.0, 0.2, 3, 0)])
    r = stats.fit_envelope(few, 0.05).first()
    assert r["fitted"] is False and r["range_lo"] is None, "three clean frames prove nothing"


def test_fit_takes_the_longest_run_the_earliest_of_equals(spark):
    good, bad = (400, 1), (400, 200)
    data = [(i, i / 5, (i + 1) / 5, *x) for i, x in enumerate([good, bad, good, good, bad, good, good])]
    r = stats.fit_envelope(bins(spark, data), 0.05).first()
    assert (r["fitted"], round(r["range_lo"], 6), round(r["range_hi"], 6), r["frames"], r["events"]) == (True, 0.4, 0.8, 800, 2)


def test_strict_fit_breaks_at_unseen_bins(spark):
    data = [(0, 0.0, 0.2, 400, 1), (3, 0.6, 0.8, 400, 1)]
    assert stats.fit_envelope(bins(spark, data), 0.05).first()["bins"] == 1
    assert stats.fit_envelope(bins(spark, data), 0.05, strict=False).first()["bins"] == 2


@pytest.mark.parametrize("values,note", [([], "no data"), ([1.0, 1.0], "metric is constant"), ([1.0, 2.0], "no contiguous range meets the target")])
def test_band_without_a_fit(spark, values, note):
    df = spark.createDataFrame([("m", v, 1) for v in values] or [("m", None, 1)], "model string, v double, e int")
    r = stats.fit_quality_band(df, "v", "e", keys=["model"]).first()
    assert (r["fitted"], r["note"]) == (False, note)


def test_band_open_on_the_outer_side(spark):
    df = spark.createDataFrame([(float(i), int(i >= 400)) for i in range(800)], "v double, e int")
    r = stats.fit_quality_band(df, "v", "e").first()
    assert r["fitted"] and r["band_min"] is None and 390 < r["band_max"] < 410


def test_fisher_against_enumeration(spark):
    def exact(a, na, b, nb):
        p = lambda x: Fraction(math.comb(na, x) * math.comb(nb, a + b - x), math.comb(na + nb, a + b))
        return float(sum(p(x) for x in range(max(0, a + b - nb), min(a + b, na) + 1) if p(x) <= p(a) * (1 + Fraction(1, 10**7))))

    cases = [
        (3, 10, 7, 12), (0, 5, 5, 5), (1, 30, 2, 25), (0, 4, 0, 9), (4, 4, 9, 9), (150, 400, 190, 420), (190, 420, 150, 400), (10, 1000, 0, 999_000),
        (0, 999_000, 10, 1000), (3, 20, 3, 20), (0, 20, 6, 20), (20, 20, 0, 20), (40, 60, 1, 900), (1, 1, 0, 1), (2, 3000, 1, 7),
    ]
    df = spark.createDataFrame(cases, "ka bigint, na bigint, kb bigint, nb bigint")
    got = [r[0] for r in df.select(stats.fisher_p(F.col("ka"), F.col("na"), F.col("kb"), F.col("nb"))).collect()]
    assert np.allclose(got, [exact(*c) for c in cases], rtol=1e-9, atol=0)


def test_fisher_on_large_counts(spark):
    df = spark.createDataFrame([(500_000, 1_000_000, 500_500, 1_000_000)], "ka bigint, na bigint, kb bigint, nb bigint")
    p = df.select(stats.fisher_p(F.col("ka"), F.col("na"), F.col("kb"), F.col("nb"))).first()[0]
    z = 500 / math.sqrt(1_000_000 * 2 * 0.25025 * (1 - 0.25025) * 4 / 3)
    assert 0.3 < p < 0.7 and z > 0


def test_correlation_tail(spark):
    # Two-sided t tails with closed forms: 1 degree of freedom (Cauchy) and 2 degrees.
    got = stats._two_sided_t_tail(np.array([1.0, 2.0, 0.0]), np.array([1.0, 2.0, 5.0]))
    assert np.allclose(got, [0.5, 1 - 2 / math.sqrt(2 + 4), 1.0], atol=1e-12)
    df = spark.createDataFrame([(float(r), n) for r, n in ((0.5, 20), (-0.9, 5))], "r double, n bigint")
    p = [x[0] for x in df.select(stats.correlation_p("r", "n")).collect()]
    assert abs(p[0] - 0.02477) < 1e-4 and abs(p[1] - 0.03739) < 1e-4


def test_single_class_has_no_correlation(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0)], "e int, x double")
    r = stats.point_biserial(df, "e", ["x"]).first()
    assert (r["r"], r["n"]) == (None, 3)


def test_icc_edges(spark):
    one = spark.createDataFrame([("a", 1), ("a", 0)], "g string, e int")
    assert stats.icc(one, "g", "e").first()["icc"] is None
    apart = spark.createDataFrame([("a", 1)] * 5 + [("b", 0)] * 5, "g string, e int")
    r = stats.icc(apart, "g", "e").first()
    assert r["icc"] == 1.0 and abs(r["design_effect"] - 5.0) < 1e-9 and abs(r["effective_n"] - 2.0) < 1e-9


def test_bootstrap_is_repeatable_and_wide(spark):
    data = [(c, int(i < c * 3)) for c in range(8) for i in range(30)]
    df = spark.createDataFrame(data, "g int, e int")
    a, b = (stats.cluster_bootstrap(df, "g", "e", 400, seed=3).first() for _ in range(2))
    assert a == b and a["ci_lo"] < a["point"] < a["ci_hi"]
    naive = stats.proportion(df, [], "e").first()
    assert a["ci_hi"] - a["ci_lo"] > naive["ci_hi"] - naive["ci_lo"]
    means = np.array([c * 3 / 30 for c in range(8)])
    draws = np.random.default_rng(0).choice(means, (4000, 8)).mean(axis=1)
    assert abs(a["ci_lo"] - np.quantile(draws, 0.025)) < 0.06 and abs(a["ci_hi"] - np.quantile(draws, 0.975)) < 0.06
    single = stats.cluster_bootstrap(df.where("g = 1"), "g", "e", 50).first()
    assert single["ci_lo"] is None


def test_bootstrap_of_many_clusters_joins_and_agrees(spark):
    data = [(k, c, int((i * 7 + c) % 11 < c % 5)) for k in "ab" for c in range(12 if k == "a" else 5) for i in range(9 + c)]
    df = spark.createDataFrame(data, "k string, g int, e int")
    held, joined = (sorted(stats.cluster_bootstrap(df, "g", "e", 60, keys=["k"], held=h).collect()) for h in (100, 3))
    assert [(r["k"], r["clusters"]) for r in held] == [("a", 12), ("b", 5)]
    assert all(abs(x - y) < 1e-12 for p, q in zip(held, joined) for x, y in zip(p[1:], q[1:]))
    alone = stats.cluster_bootstrap(df.where("k = 'b'"), "g", "e", 60).first()
    assert tuple(alone) == tuple(held[1])[1:]


def test_draws_are_never_sent_whole(spark):
    """Draws are clusters times replicates but look as small as the clusters; only the table of replicates is broadcast."""
    numbered = pin(spark.range(40).selectExpr("if(id < 30, 'a', 'b') AS k", "id % 30 AS _no", "id % 7 + 1 AS n", "CAST(id % 5 AS DOUBLE) AS s"))
    for keys in (["k"], []):
        whole = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"))
        rates = stats._joined_rates(numbered, whole, keys, stats.draw_coefficients(3, 20))
        text = rates._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in text and text.count("BroadcastExchange") == 1 and "_a#" in text.split("BroadcastExchange")[1]
        assert rates.count() == 20 * (2 if keys else 1)


def test_bootstrap_of_nothing(spark):
    assert stats.cluster_bootstrap(spark.createDataFrame([], "k string, g int, e int"), "g", "e", 10, keys=["k"]).count() == 0


def test_mediation_needs_thirty_rows(spark):
    df = spark.range(20).selectExpr("id * 1.0 AS x", "id * 2.0 AS y")
    assert stats.mediation(df, ["x"], ["y"]).first()["r2"] is None
    df = spark.range(60).selectExpr("id * 1.0 AS x", "(id % 7) * 1.0 AS z", "id * 2.0 - (id % 7) AS y")
    r = stats.mediation(df, ["x", "z"], ["y"]).first()
    assert abs(r["coef_x"] - 2) < 1e-6 and abs(r["coef_z"] + 1) < 1e-6 and abs(r["r2"] - 1) < 1e-9


def test_unknown_column_or_statistic(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    assert "unknown column" in stats.column_stats(df, "nope").first()["error"]
    assert "unknown statistic" in stats.column_stats(df, "x", statistic="mode").first()["error"]
    assert stats.column_stats(df, "x", statistic="median").first().asDict() == {"median": 1.0}


# Gates -----------------------------------------------------------------------------------

SPEC = Envelope(0.4, 0.9, 0.2)
FRAME = "standoff double, net_speed double, locked boolean"


@pytest.mark.parametrize("frame,status,n", [
    ((0.6, 0.1, True), "in_envelope", 0), ((1.4, 0.28, True), "out_of_envelope", 2), ((0.6, 0.1, False), "unknown", 1),
    ((0.6, 0.1, None), "unknown", 1), ((None, 0.1, True), "unknown", 1), ((0.6, None, True), "in_envelope", 0), ((0.4, 0.2, True), "in_envelope", 0),
])
def test_envelope_gate(spark, frame, status, n):
    r = gates.envelope_gate(spark.createDataFrame([frame], FRAME), SPEC).first()
    assert r["status"] == status and len(r["reasons"]) == n


def test_failed_fit_trusts_nothing(spark):
    r = gates.envelope_gate(spark.createDataFrame([(0.6, 0.1, True)], FRAME), Envelope(fitted=False)).first()
    assert (r["status"], r["reasons"]) == ("unknown", ["no validated operating envelope for this model"])


def test_unknown_counts_against_compliance(spark):
    df = gates.envelope_gate(spark.createDataFrame([(0.6, 0.1, True)] * 4 + [(0.6, 0.1, None)], FRAME), SPEC)
    r = gates.validity(df).first()
    assert (r["compliance"], r["unknown"]) == (0.8, 1) and r["verdict"].startswith("accept with note")
    (lost,) = gates.not_inspected(df).collect()
    assert (lost["status"], lost["frames"], lost["share"], lost["n"]) == ("unknown", 1, 0.2, 1)


def test_open_band_sides(spark):
    df = spark.createDataFrame([(5.0, 1.0), (50.0, 99.0)], "sharpness double, contrast double")
    assert [r["in_band"] for r in gates.band_check(df, Band(sharpness_min=10.0)).collect()] == [False, True]
    assert all(r["in_band"] for r in gates.band_check(df, Band()).collect())


def test_runs(spark):
    hits = [1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([("c", i, h) for i, h in enumerate(hits)], "clip string, i int, h int")
    runs = gates.event_runs(df, ["clip"], ["i"], F.col("h") > 0)
    assert sorted(r["frames"] for r in runs.collect()) == [1, 2, 3]
    r = gates.run_summary(runs, ["clip"]).first()
    assert (r["candidate_events"], r["confirmed_events"], r["longest_event"]) == (3, 1, 3)
    sparse = df.where("h = 1")
    assert gates.event_runs(sparse, ["clip"], ["i"], F.col("h") > 0).count() == 1
    assert gates.event_runs(sparse, ["clip"], ["i"], F.col("h") > 0, max_index_gap=1).count() == 3


def scores(spark, clean, damaged):
    return spark.createDataFrame([(False, s) for s in clean] + [(True, s) for s in damaged], "damaged boolean, top_score double")


def test_measure_without_denominator(spark):
    r = gates.release_measure(scores(spark, [None, 0.9], [])).first()
    assert (r["clean_frames"], r["false_alarm_rate"], r["recall"], r["precision"]) == (2, 0.5, None, 0.0)


def test_gate_fails_closed(spark):
    checks = gates.release_gate(gates.release_measure(scores(spark, [], []))).collect()
    assert checks == [] or all(not r["passed"] for r in checks)
    checks = gates.release_gate(gates.release_measure(scores(spark, [None] * 60, []))).orderBy("position").collect()
    assert [r["passed"] for r in checks] == [True, False, True, False] and checks[0]["verdict"] == "FAIL"
    good = gates.release_gate(gates.release_measure(scores(spark, [None] * 60, [0.9] * 60)))
    assert {r["verdict"] for r in good.collect()} == {"PASS"}


def test_lowest_feasible_threshold(spark):
    s = gates.threshold_sweep(scores(spark, [0.1] * 9 + [0.52], [0.9] * 10))
    r = gates.choose_threshold(s, 0.1).first()
    assert (r["achievable"], r["conf"], r["recall"]) == (True, 0.15, 1.0)
    assert gates.choose_threshold(gates.threshold_sweep(scores(spark, [0.99], [0.9])), 0.0).first()["achievable"] is False


def test_unknown_report(spark):
    with pytest.raises(KeyError, match="choose from"):
        reports.run_report(spark, "nope")


# Planning --------------------------------------------------------------------------------


@pytest.mark.parametrize("wave,current,rating,n", [
    (0.3, 0.05, "good", 1), (0.7, 0.05, "marginal", 1), (1.2, 0.15, "poor", 2), (0.2, 0.3, "poor", 1), (None, None, "unknown", 1), (None, 0.1, "marginal", 1),
])
def test_rating(spark, wave, current, rating, n):
    df = spark.createDataFrame([(1, wave, current)], "time int, sea_surface_wave_height_m double, sea_water_speed_ms double")
    r = planning.rate_hours(df).first()
    assert r["rating"] == rating and len(r["reasons"]) == n


def test_best_window_prefers_a_later_good_hour(spark):
    h = spark.createDataFrame([(1, "marginal"), (2, "poor"), (3, "good")], "time int, rating string")
    assert tuple(planning.best_window(h).first()) == (3, "good")
    assert planning.forecast_summary(h).first()["best_time"] == 3
    assert tuple(planning.best_window(h.where("time = 2")).first()) == (None, None)


def test_growth(spark):
    t = spark.createDataFrame([("c", i, 10.0 if i % 2 else -4.0, 1000.0) for i in range(6)], "cohort string, step int, temperature_c double, initial_weight_g double")
    last = planning.tgc_growth(t, ["cohort"], ["step"]).orderBy("step").collect()[-1]["weight_g"]
    assert abs(last - (10 + 0.002 * 30) ** 3) < 1e-6
    assert planning.degree_days(t, ["cohort"]).first()["degree_days"] == 30.0
    w = 1000.0
    for i in range(6):
        temp = 10.0 if i % 2 else -4.0
        eff = max(0.0, 1 - abs(temp - (15.57 - 0.8426 * math.log(w))) / 6)
        w = (w ** (1 / 3) + 0.002 * max(0.0, temp) * eff) ** 3
    got = planning.tgc_growth_corrected(t, ["cohort"], ["step"]).orderBy("step").collect()[-1]["weight_g"]
    assert abs(got - w) < 1e-9
    with pytest.raises(Exception, match="positive"):
        planning.tgc_growth(t.withColumn("initial_weight_g", F.lit(0.0)), ["cohort"], ["step"]).collect()


def test_optimum_falls_with_weight(spark):
    df = spark.createDataFrame([(2.0, 15.0), (2000.0, 15.0)], "weight_g double, temperature_c double")
    a, b = planning.thermal_state(df).collect()
    assert a["thermal_optimum_c"] > 14.9 and b["thermal_optimum_c"] < 9.3 and b["state"].startswith("above optimum")
    with pytest.raises(Exception, match="positive"):
        planning.thermal_state(df.withColumn("weight_g", F.lit(0.0))).collect()


# Answers ---------------------------------------------------------------------------------


def test_grounding_and_artifacts(spark):
    df = spark.createDataFrame([("Would it detect a real hole?", "F1 is 0.97.", ), ("Would it find damage?", "Not measured: synthetic only.")], "question string, answer string")
    assert [r["missing_caveat"] for r in rubric.check_grounding(df).collect()] == [True, False]
    text = spark.createDataFrame([("See `reports/results/a.json`, (data/processed/x) and reports/results/a.json.",)], "t string")
    assert text.select(rubric.cited_artifacts(F.col("t"))).first()[0] == ["reports/results/a.json", "data/processed/x"]


def test_rubric_checks(spark):
    a = spark.createDataFrame([("q", "The data is unavailable.", ["tool"])], "id string, answer string, tools_used array<string>")
    rule = "id string, must_caveat boolean, must_use_tool boolean, must_cite_artifact boolean, must_admit_missing boolean, must_mention array<string>, must_mention_any array<string>, must_not_mention array<string>"
    r = spark.createDataFrame([("q", True, True, False, True, ["Data"], [], ["hole"])], rule)
    out = rubric.score_answers(a, r, ["unavailable"]).first()
    assert out["failed_checks"] == ["states_boundary"] and not out["passed"] and out["mentions_any"] is None
    assert rows(rubric.rubric_rates(rubric.score_answers(a, r, ["unavailable"]))) == [(1, 0, 0.0, 0.0, 1.0)]


def test_opposed_pairs_keep_to_one_condition(spark):
    r = spark.createDataFrame(
        [("c", "x", 0.5), ("c", "y", -0.2), ("d", "x", 0.1), ("d", "y", 0.3), ("d", "z", None)], "condition string, model string, r double")
    pairs = stats.opposed_pairs(r)
    assert [tuple(p) for p in pairs.collect()] == [("c", "x", "y", 0.5, -0.2)]
    assert "Cartesian" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_missing_temperatures_are_unknown(spark):
    t = spark.createDataFrame(
        [("a", 1, 10.0, 100.0), ("a", 2, None, 100.0), ("a", 3, 12.0, 100.0), ("b", 1, None, 50.0)],
        "cohort string, step int, temperature_c double, initial_weight_g double")
    assert {r["cohort"]: r["degree_days"] for r in planning.degree_days(t, ["cohort"]).collect()} == {"a": 22.0, "b": None}
    without = t.where("temperature_c IS NOT NULL")
    for grow in (planning.tgc_growth, planning.tgc_growth_corrected):
        got = {(r["cohort"], r["step"]): r["weight_g"] for r in grow(t, ["cohort"], ["step"]).collect()}
        assert got[("a", 2)] is None and got[("b", 1)] is None
        want = {(r["cohort"], r["step"]): r["weight_g"] for r in grow(without, ["cohort"], ["step"]).collect()}
        assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_means_at_a_half_are_rounded_up_in_every_order(spark):
    """Ten times 0.1 is a hair below 1 as a sum of doubles; NaN still gives the mean of doubles."""
    kind = "clip string, i int, standoff double, net_speed double, locked boolean, sharpness double, ndet int"
    low = [("a", i, 0.1 / 100, 0.1, True, 0.1 if i < 10 else 0.0, 0) for i in range(20)]
    odd = [("b", 0, 1.0, 0.1, True, float("nan"), 0), ("c", 0, 1.0, 0.1, True, 1e300, 0), ("d", 0, 1.0, 0.1, True, None, 0)]
    got = gates.pass_report(spark.createDataFrame(low + odd, kind).coalesce(1), SPEC, order=["i"], ndet="ndet")
    means = {r["clip"]: r["sharpness_mean"] for r in got.collect()}
    assert means["a"] == 0.1 and math.isnan(means["b"]) and means["c"] == 1e300 and means["d"] is None


def test_extremes_and_shares_are_rounded_as_in_sql(spark):
    """A double may lie below the half that its decimal shows; infinite, NaN and missing distances stay what they are."""
    kind = "clip string, i int, standoff double, net_speed double, locked boolean, sharpness double, ndet int"
    data = [("a", 0, 0.285, 0.1, True, 1.0, 0), ("a", 1, 1.015, 0.1, True, 1.0, 0), ("b", 0, 0.125, 0.1, True, 1.0, 0), ("b", 1, 2.345, 0.1, True, 1.0, 0),
            ("c", 0, math.inf, 0.1, True, 1.0, 0), ("c", 1, 1e300, 0.1, True, 1.0, 0), ("d", 0, None, 0.1, True, 1.0, 0), ("e", 0, math.nan, 0.1, True, 1.0, 0)]
    many = [("f", i, 0.5 if i < 3 else 9.0, 0.1, True, 1.0, 1 if i < 29 else 0) for i in range(20_000)]
    df = spark.createDataFrame(data + many, kind)
    got = {r["clip"]: r for r in gates.pass_report(df, SPEC, order=["i"], ndet="ndet", band=(0.5, None)).collect()}
    con = duckdb.connect()
    sql = lambda value, digits: con.execute(f"SELECT round({value}::DOUBLE, {digits})").fetchone()[0]
    assert (got["a"]["standoff_min"], got["a"]["standoff_max"]) == (sql("0.285", 2), sql("1.015", 2)) == (0.28, 1.01)
    assert (got["b"]["standoff_min"], got["b"]["standoff_max"]) == (sql("0.125", 2), sql("2.345", 2)) == (0.13, 2.35)
    assert (got["c"]["standoff_min"], got["c"]["standoff_max"]) == (sql("1e300", 2), math.inf)
    assert got["d"]["standoff_min"] is None and math.isnan(got["e"]["standoff_max"])
    assert got["f"]["compliance"] == sql("3 / 20000::DOUBLE", 4) == 0.0001 and got["f"]["share_in_band"] == 1.0
