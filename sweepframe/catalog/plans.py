"""Site planning, growth, answers and request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning, rubric
from .bindings import daily_temperature, events, forecast, sites
from .registry import query, table
from .statistics import rounded

SITES = """
WITH si AS (SELECT s_suppkey AS loknr, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'SLETTET' ELSE 'AKTIV' END AS status, n_name AS county, s_acctbal AS capacity,
  CASE WHEN s_suppkey % 3 = 0 THEN 'STK' ELSE 'TN' END AS unit, s_suppkey % 3 <> 0 AS sea, s_suppkey % 7 <> 0 AS coords,
  'Fjord ' || (s_suppkey % 4) || ' AS, Havn ' || (s_suppkey % 6) || ' AS' AS operators, CASE WHEN s_suppkey % 2 = 0 THEN 'Matfisk' ELSE '' END AS form
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)
"""


@query(SITES + """SELECT count(*) AS sites, count_if(status = 'AKTIV')::BIGINT AS active, count_if(sea)::BIGINT AS sea_sites, count_if(NOT sea)::BIGINT AS land_sites,
  round(sum(CASE WHEN sea AND unit = 'TN' THEN capacity ELSE 0 END), 1) AS licensed_tonnes_total,
  trunc(sum(CASE WHEN NOT sea AND unit = 'STK' THEN capacity ELSE 0 END))::BIGINT AS licensed_individuals_total, 'Matfisk' AS production_forms FROM si""")
def register_summary(spark, sf):
    return planning.register_summary(sites(spark, sf))


@query(SITES + "SELECT county, count(*) AS sites FROM si GROUP BY 1")
def sites_per_county(spark, sf):
    return planning.sites_per_county(sites(spark, sf))


@query(SITES + "SELECT operator, count(*) AS licences FROM (SELECT trim(unnest(string_split(operators, ','))) AS operator FROM si) WHERE operator <> '' GROUP BY 1")
def operators_exploded(spark, sf):
    return planning.operator_counts(sites(spark, sf))


@query(SITES + "SELECT loknr, name, sea AS is_sea_site, status = 'AKTIV' AS is_active, coords AS has_coordinates, CASE WHEN unit = 'TN' THEN capacity END AS capacity_tonnes FROM si WHERE lower(operators) LIKE '%fjord 2%'")
def sites_by_operator(spark, sf):
    found = planning.by_operator(sites(spark, sf), "  FJORD 2 ")
    return planning.planning_order(found).select("loknr", "name", "is_sea_site", "is_active", "has_coordinates", "capacity_tonnes")


HOURS = """
WITH fo AS (SELECT user_id % 10 AS loknr, (epoch_us(ts) // 3600000000)::BIGINT AS time, avg(value) / 60.0 + 0.0123 AS wave, count(*) * 0.09::DOUBLE AS cur FROM events GROUP BY 1, 2),
ra AS (SELECT *, greatest(CASE WHEN wave > 1 THEN 2 WHEN wave > 0.5 THEN 1 ELSE 0 END, CASE WHEN cur >= 0.3 THEN 2 WHEN cur >= 0.1 THEN 1 ELSE 0 END) AS w,
  list_filter([CASE WHEN wave > 1 THEN printf('wave height %.1f m above 1.0 m — launch and recovery difficult', wave) WHEN wave > 0.5 THEN printf('wave height %.1f m — workable but degraded', wave) END,
   CASE WHEN cur >= 0.3 THEN printf('current %.2f m/s at or above the fastest commanded sweep (0.3 m/s) — net-following degraded', cur)
        WHEN cur >= 0.1 THEN printf('current %.2f m/s comparable to the slowest commanded sweep (0.1 m/s) — expect station-keeping effort', cur) END], lambda x: x IS NOT NULL) AS rs FROM fo),
rt AS (SELECT loknr, time, wave, cur, ['good', 'marginal', 'poor'][w + 1] AS rating, CASE WHEN len(rs) = 0 THEN 'wave and current both inside the range this system was characterised in'
  ELSE array_to_string(rs, '; ') END AS reasons FROM ra)
"""


@query(HOURS + "SELECT loknr, time, rating, reasons, round(cur / 0.1, 2) AS current_vs_sweep FROM rt")
def forecast_ratings(spark, sf):
    return planning.rate_hours(forecast(spark, sf)).select("loknr", "time", "rating", F.array_join("reasons", "; ").alias("reasons"), "current_vs_sweep")


@query(HOURS + """SELECT loknr, count(*) AS hours, min(time) AS "from", max(time) AS "to", count_if(rating = 'good')::BIGINT AS good, count_if(rating = 'marginal')::BIGINT AS marginal,
  count_if(rating = 'poor')::BIGINT AS poor, 0::BIGINT AS unknown, round(avg(CASE WHEN rating = 'good' THEN 1.0 ELSE 0.0 END), 3) AS good_fraction,
  coalesce(min(CASE WHEN rating = 'good' THEN time END), min(CASE WHEN rating = 'marginal' THEN time END)) AS best_time,
  CASE WHEN count_if(rating = 'good') > 0 THEN 'good' WHEN count_if(rating = 'marginal') > 0 THEN 'marginal' END AS best_rating FROM rt GROUP BY 1""")
def best_window(spark, sf):
    return planning.forecast_summary(planning.rate_hours(forecast(spark, sf)), ["loknr"])


@query(HOURS + """, s AS (SELECT s_suppkey AS loknr, s_name AS name FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 ORDER BY 1 LIMIT 8)
SELECT rt.loknr, name, time, rating FROM rt JOIN s USING (loknr)""")
def site_windows(spark, sf):
    return planning.site_windows(sites(spark, sf), forecast(spark, sf)).select("loknr", "name", "time", "rating")


TEMPS = """
WITH RECURSIVE te AS (SELECT user_id AS cohort, (epoch_us(ts) // 86400000000)::BIGINT AS step, avg(value) / 5.0 - 1.0 AS t, 100.0::DOUBLE + user_id AS w0 FROM events GROUP BY 1, 2),
nu AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY step) AS n FROM te)
"""


@query(TEMPS + """, d AS (SELECT cohort, step, t, w0, 15.57 - 0.8426 * ln(w0) AS opt FROM te)
SELECT cohort, step, round(opt, 6) AS thermal_optimum_c, round(t - opt, 6) AS delta_c, CASE WHEN t - opt > 3 THEN 'above optimum — growth suppressed, oxygen demand elevated'
  WHEN t - opt > 1 THEN 'slightly above optimum' WHEN t - opt < -3 THEN 'well below optimum — growth slowed' WHEN t - opt < -1 THEN 'slightly below optimum' ELSE 'near optimum' END AS state FROM d""")
def thermal_state(spark, sf):
    out = planning.thermal_state(daily_temperature(spark, sf), "initial_weight_g")
    return rounded(out.select("cohort", "step", "thermal_optimum_c", "delta_c", "state"))


@query(TEMPS + "SELECT cohort, step, round((cbrt(w0) + sum(greatest(t, 0) * 0.002) OVER (PARTITION BY cohort ORDER BY step)) ** 3, 6) AS weight_g FROM te")
def tgc_growth(spark, sf):
    return rounded(planning.tgc_growth(daily_temperature(spark, sf), ["cohort"], ["step"]).select("cohort", "step", "weight_g"))


@query(TEMPS + """, w AS (SELECT cohort, 0::BIGINT AS n, NULL::BIGINT AS step, w0 AS weight FROM nu WHERE n = 1
  UNION ALL SELECT w.cohort, nu.n, nu.step, (w.weight ** (1.0::DOUBLE / 3) + 0.002::DOUBLE * greatest(0.0, t) * greatest(0.0, 1 - abs(t - (15.57::DOUBLE - 0.8426::DOUBLE * ln(w.weight))) / 6.0)) ** 3
  FROM w JOIN nu ON nu.cohort = w.cohort AND nu.n = w.n + 1)
SELECT cohort, step, round(weight, 6) AS weight_g FROM w WHERE n > 0""")
def tgc_corrected(spark, sf):
    return rounded(planning.tgc_growth_corrected(daily_temperature(spark, sf), ["cohort"], ["step"]).select("cohort", "step", "weight_g"))


@query(TEMPS + "SELECT cohort, round(sum(greatest(t, 0)), 6) AS degree_days FROM te GROUP BY 1")
def degree_days(spark, sf):
    return rounded(planning.degree_days(daily_temperature(spark, sf), ["cohort"]))




@query("""WITH u AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'),
a AS (SELECT c.conv_id, c.turn, question, text AS answer, lower(text) AS low FROM conversations c JOIN u ON u.conv_id = c.conv_id AND u.turn = c.turn - 1 WHERE role = 'assistant')
SELECT conv_id, turn, contains(lower(question), 'ou') OR contains(lower(question), 'es') AS touches_unvalidated, contains(low, 'the') OR contains(low, 'an') AS states_boundary,
  (contains(lower(question), 'ou') OR contains(lower(question), 'es')) AND NOT (contains(low, 'the') OR contains(low, 'an')) AS missing_caveat FROM a""")
def grounding_check(spark, sf):
    """Assistant turns against the user turn before them, with phrase lists that occur in the texts."""
    return rubric.check_grounding(answers(spark, sf), ["ou", "es"], ["the", "an"]).select(
        "conv_id", "turn", "touches_unvalidated", "states_boundary", "missing_caveat")


def answers(spark, sf):
    c = table(spark, sf, "conversations")
    asked = c.where(F.col("role") == "user").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    return c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("answer")).join(asked, ["conv_id", "turn"])


RUBRIC = """
WITH a AS (SELECT conv_id, turn, lower(text) AS low, len(text) AS n FROM conversations WHERE role = 'assistant'),
r AS (SELECT *, contains(low, 'the') OR contains(low, 'an') AS c1, CASE WHEN turn % 2 = 1 THEN n % 3 > 0 END AS c2, contains(low, 'en') AS c3,
  contains(low, 'est') OR contains(low, 'er') AS c4, NOT contains(low, 'zzz') AS c5 FROM a),
s AS (SELECT *, coalesce(c1, true) AND coalesce(c2, true) AND coalesce(c3, true) AND coalesce(c4, true) AND coalesce(c5, true) AS ok FROM r)
"""


def scored_answers(spark, sf):
    c = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    key = F.format_string("%d-%d", "conv_id", "turn")
    given = c.select(key.alias("id"), "conv_id", F.col("text").alias("answer"),
                     F.when(F.length("text") % 3 > 0, F.array(F.lit("search"))).otherwise(F.array().cast("array<string>")).alias("tools_used"))
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    rules = c.select(
        key.alias("id"), F.lit(True).alias("must_caveat"), (F.col("turn") % 2 == 1).alias("must_use_tool"), F.lit(False).alias("must_cite_artifact"),
        F.lit(False).alias("must_admit_missing"), words("EN").alias("must_mention"), words("est", "er").alias("must_mention_any"), words("zzz").alias("must_not_mention"))
    return rubric.score_answers(given, rules, ["missing"], ["the", "an"])


@query(RUBRIC + """SELECT conv_id || '-' || turn AS id, c1 AS states_boundary, c2 AS used_tool, c3 AS mentions_all, c4 AS mentions_any, c5 AS avoids_all, ok AS passed FROM s""")
def answer_rubric(spark, sf):
    return scored_answers(spark, sf).select("id", "states_boundary", "used_tool", "mentions_all", "mentions_any", "avoids_all", "passed")


@query(RUBRIC + """SELECT count(*) AS answers, count_if(ok)::BIGINT AS passed, round(avg(ok::INT), 3) AS pass_rate, round(avg(c1::INT), 3) AS boundary_disclosure_rate,
  round(avg(c2::INT), 3) AS tool_grounding_rate FROM s""")
def rubric_rates(spark, sf):
    return rubric.rubric_rates(scored_answers(spark, sf))


def requests(spark, sf):
    return events(spark, sf).select(
        F.col("event_type").alias("path"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("error"),
        F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k")).alias("method"))


@query("""SELECT event_type AS path, count(*) AS requests, count_if(event_type = 'error')::BIGINT AS errors, round(avg(value), 2) AS latency_ms_avg FROM events GROUP BY 1""")
def request_metrics(spark, sf):
    return rubric.request_metrics(requests(spark, sf))


@query("SELECT json_extract_string(props, '$.k') AS method, count(*) AS inferences FROM events WHERE event_type = 'view' GROUP BY 1")
def inference_counts(spark, sf):
    return rubric.inference_counts(requests(spark, sf))


