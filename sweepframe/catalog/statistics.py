"""Frame statistics on line items: event = returned, cluster = supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.intervals import overlap
from ..operators import stats
from ..plans.seeded import draw_sql
from .bindings import events, frames
from .registry import query, table

FRAMES = """
WITH fr AS (SELECT l_suppkey AS clip, strftime(l_shipdate, '%Y') AS year, l_quantity / 50.0 AS standoff,
  l_discount * 4.0 AS net_speed, l_tax > 0.01 AS locked, l_extendedprice AS sharpness, l_quantity AS quantity,
  l_discount AS discount, l_tax AS tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS event,
  l_linestatus AS linestatus, l_partkey AS partkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem)
"""


def wilson_sql(k: str = "k", n: str = "n") -> tuple[str, str]:
    z2 = "3.8416"
    p = f"({k} / {n}::DOUBLE)"
    mid = f"({p} + {z2} / (2.0 * {n}))"
    half = f"(1.96 * sqrt({p} * (1 - {p}) / {n} + {z2} / (4.0 * {n} * {n})))"
    down = f"(1 + {z2} / {n})"
    return f"greatest(0.0, ({mid} - {half}) / {down})", f"least(1.0, ({mid} + {half}) / {down})"


LO, HI = wilson_sql()
ROUNDED = {c: 6 for c in ("rate", "ci_lo", "ci_hi")}


def rounded(df, digits: int = 6):
    """Round every double column at the presentation edge; ``+ 0.0`` turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields
    ])


@query(FRAMES + f""", g AS (SELECT clip, count(*) AS n, sum(event)::BIGINT AS k FROM fr GROUP BY clip)
SELECT clip, n, k, round(k / n::DOUBLE, 6) AS rate, round({LO}, 6) AS ci_lo, round({HI}, 6) AS ci_hi FROM g""")
def wilson_by_cluster(spark, sf):
    return rounded(stats.proportion(frames(spark, sf), ["clip"], "event"))


EDGES = [round(0.1 * i, 1) for i in range(12)]
DOSE = FRAMES + f""", b AS (
  SELECT linestatus, event, len(list_filter([{', '.join(map(str, EDGES))}]::DOUBLE[], lambda e: e <= standoff)) - 1 AS bin FROM fr),
d AS (SELECT linestatus, bin::INT AS bin, count(*) AS n, sum(event)::BIGINT AS k FROM b
  WHERE bin >= 0 AND bin < {len(EDGES) - 1} GROUP BY 1, 2),
w AS (SELECT *, k / n::DOUBLE AS rate, {LO} AS ci_lo, {HI} AS ci_hi,
  ([{', '.join(map(str, EDGES))}]::DOUBLE[])[bin + 1] AS lo, ([{', '.join(map(str, EDGES))}]::DOUBLE[])[bin + 2] AS hi FROM d)
"""


@query(DOSE + """SELECT linestatus, bin, n, k, round(rate, 6) AS rate, round(ci_lo, 6) AS ci_lo,
  round(ci_hi, 6) AS ci_hi, round(lo, 6) AS lo, round(hi, 6) AS hi FROM w""")
def dose_response(spark, sf):
    return rounded(stats.dose_response(frames(spark, sf), "standoff", "event", EDGES, ["linestatus"]))


@query(DOSE + f""", q AS (SELECT *, bin - row_number() OVER (PARTITION BY linestatus ORDER BY bin) AS run FROM w WHERE ci_hi <= 0.345),
r AS (SELECT linestatus, run, count(*) AS bins, min(bin) AS first_bin, min(lo) AS range_lo, max(hi) AS range_hi,
  sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM q GROUP BY 1, 2),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY linestatus ORDER BY bins DESC, first_bin) = 1)
SELECT s.linestatus, bins IS NOT NULL AS fitted, range_lo, range_hi, bins, n AS frames, k AS events,
  round(k / n::DOUBLE, 6) AS rate, CASE WHEN bins > 0 THEN round({LO}, 6) END AS ci_lo,
  CASE WHEN bins > 0 THEN round({HI}, 6) END AS ci_hi
FROM (SELECT DISTINCT linestatus FROM w) s LEFT JOIN best USING (linestatus)""")
def envelope_fit(spark, sf):
    bins = stats.dose_response(frames(spark, sf), "standoff", "event", EDGES, ["linestatus"])
    return rounded(stats.fit_envelope(bins, 0.345, ["linestatus"]))


@query(FRAMES + f""", cuts AS (
  SELECT linestatus, list_sort(list_distinct(quantile_cont(sharpness, [0.0,0.125,0.25,0.375,0.5,0.625,0.75,0.875,1.0]))) AS edges
  FROM fr GROUP BY 1),
b AS (SELECT fr.linestatus, event, edges,
  CASE WHEN sharpness = edges[-1] THEN len(edges) - 2 ELSE len(list_filter(edges, lambda e: e <= sharpness)) - 1 END AS bin
  FROM fr JOIN cuts USING (linestatus)),
w AS (SELECT linestatus, bin, edges[bin + 1] AS lo, edges[bin + 2] AS hi, count(*) AS n, sum(event)::BIGINT AS k FROM b GROUP BY ALL),
v AS (SELECT *, {HI} AS ci_hi, row_number() OVER (PARTITION BY linestatus ORDER BY bin) AS pos,
  min(bin) OVER (PARTITION BY linestatus) AS lowest, max(bin) OVER (PARTITION BY linestatus) AS highest FROM w),
q AS (SELECT *, pos - row_number() OVER (PARTITION BY linestatus ORDER BY bin) AS run FROM v WHERE ci_hi <= 0.35),
r AS (SELECT linestatus, run, count(*) AS bins, min(bin) AS first_bin, max(bin) AS last_bin, min(lo) AS lo, max(hi) AS hi,
  sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, any_value(lowest) AS lowest, any_value(highest) AS highest FROM q GROUP BY 1, 2),
best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY linestatus ORDER BY bins DESC, first_bin) = 1)
SELECT linestatus, bins IS NOT NULL AS fitted, CASE WHEN bins IS NULL THEN 'no contiguous range meets the target' END AS note,
  CASE WHEN first_bin > lowest THEN round(lo, 6) END AS band_min, CASE WHEN last_bin < highest THEN round(hi, 6) END AS band_max,
  bins, n AS frames, k AS events, round(k / n::DOUBLE, 6) AS rate
FROM (SELECT DISTINCT linestatus FROM fr) LEFT JOIN best USING (linestatus)""")
def quality_band_fit(spark, sf):
    return rounded(stats.fit_quality_band(frames(spark, sf), "sharpness", "event", 0.35, keys=["linestatus"]))


BAND = FRAMES + f""", g AS (SELECT clip, linestatus, count(*) AS n, sum(event)::BIGINT AS k FROM fr
  WHERE standoff >= 0.3 AND standoff < 0.7 GROUP BY 1, 2),
h AS (SELECT *, {LO} AS ci_lo, {HI} AS ci_hi FROM g),
two AS (SELECT clip, count(*) AS groups, min(linestatus) AS la, max(linestatus) AS lb FROM h GROUP BY clip)
"""
LN_CHOOSE = "lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0)"


@query(BAND + """SELECT two.clip, groups, a.linestatus AS linestatus_a, a.n AS n_a, a.k AS k_a, round(a.k / a.n::DOUBLE, 6) AS rate_a,
  b.linestatus AS linestatus_b, b.n AS n_b, b.k AS k_b, round(b.k / b.n::DOUBLE, 6) AS rate_b,
  CASE WHEN groups = 2 THEN a.ci_hi >= b.ci_lo AND b.ci_hi >= a.ci_lo END AS intervals_overlap,
  CASE WHEN groups = 2 THEN CASE WHEN a.ci_hi >= b.ci_lo AND b.ci_hi >= a.ci_lo THEN 'rates overlap' ELSE 'rates separate' END END AS reading
  FROM two JOIN h a ON a.clip = two.clip AND a.linestatus = la JOIN h b ON b.clip = two.clip AND b.linestatus = lb""")
def matched_band(spark, sf):
    return rounded(stats.matched_band(frames(spark, sf), "linestatus", "standoff", "event", (0.3, 0.7), ["clip"]).drop("fisher_p"))


@query(BAND + f""", t AS (SELECT two.clip, a.n AS na, a.k AS ka, b.n AS nb, b.k AS kb FROM two
  JOIN h a ON a.clip = two.clip AND a.linestatus = la JOIN h b ON b.clip = two.clip AND b.linestatus = lb WHERE groups = 2),
s AS (SELECT *, unnest(range(greatest(0, ka + kb - nb), least(ka + kb, na) + 1)) AS x FROM t),
p AS (SELECT clip, {LN_CHOOSE.format(n='na', k='x')} + {LN_CHOOSE.format(n='nb', k='(ka + kb - x)')} - ({LN_CHOOSE.format(n='(na + nb)', k='(ka + kb)')}) AS lp,
  {LN_CHOOSE.format(n='na', k='ka')} + {LN_CHOOSE.format(n='nb', k='kb')} - ({LN_CHOOSE.format(n='(na + nb)', k='(ka + kb)')}) AS seen FROM s)
SELECT clip, round(p, 8) AS fisher_p, round(log10(p), 6) AS log10_p
FROM (SELECT clip, least(1.0, sum(CASE WHEN lp <= seen + 1e-7 THEN exp(lp) ELSE 0 END)) AS p FROM p GROUP BY clip)""")
def fisher_exact(spark, sf):
    both = stats.matched_band(frames(spark, sf), "linestatus", "standoff", "event", (0.3, 0.7), ["clip"])
    p = F.col("fisher_p")
    return both.where(F.col("groups") == 2).select("clip", F.round(p, 8).alias("fisher_p"), F.round(F.log10(p), 6).alias("log10_p"))


@query(FRAMES + """, c AS (SELECT linestatus, clip, count(*) AS n, avg(event) AS m, var_pop(event) * count(*) AS ss FROM fr GROUP BY 1, 2),
t AS (SELECT linestatus, count(*) AS k, sum(n)::BIGINT AS nn, sum(n * n)::DOUBLE AS n2, sum(ss) AS w,
  sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b FROM c GROUP BY 1),
v AS (SELECT *, b / (k - 1) AS msb, w / (nn - k) AS msw, (nn - n2 / nn) / (k - 1) AS n0 FROM t),
i AS (SELECT *, greatest(0.0, least(1.0, (msb - msw) / (msb + (n0 - 1) * msw))) AS icc FROM v)
SELECT linestatus, k AS clusters, nn AS naive_n, round(nn / k::DOUBLE, 6) AS mean_cluster_size, round(icc, 6) AS icc,
  round(1 + (nn / k::DOUBLE - 1) * icc, 6) AS design_effect, round(nn / (1 + (nn / k::DOUBLE - 1) * icc), 4) AS effective_n FROM i""")
def icc_design_effect(spark, sf):
    out = stats.icc(frames(spark, sf), "clip", "event", ["linestatus"])
    return rounded(out.withColumn("effective_n", F.round("effective_n", 4)))


@query(FRAMES + """, c AS (SELECT clip, avg(event) AS rate, count(*) AS n FROM fr GROUP BY clip)
SELECT round(min(rate), 6) AS min_rate, round(max(rate), 6) AS max_rate, round(max(rate) - min(rate), 6) AS spread,
  round(max(CASE WHEN clip % 2 = 0 THEN rate END) - min(CASE WHEN clip % 2 = 0 THEN rate END), 6) AS subset_spread FROM c""")
def cluster_rate_spread(spark, sf):
    rates = stats.proportion(frames(spark, sf), ["clip"], "event")
    return rounded(stats.rate_spread(rates, subset=F.col("clip") % 2 == 0))


def bootstrap_sql(per: str, keys: str, replicates: int, seed: int) -> str:
    """Common tables that end in ``boot(keys, ci_lo, ci_hi)``; ``per`` names a table of ``keys, clip, n, s``."""
    p = stats.DRAW_PRIME
    word = lambda j: f"{draw_sql(seed, f'(r || chr(47) || {j})')} % {p}"
    return f"""co AS (SELECT r, {word(0)} AS a, {word(1)} AS b, {word(2)} AS c, {word(3)} AS d FROM range({replicates}) t(r)),
nu AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY clip) - 1 AS no, count(*) OVER (PARTITION BY {keys}) AS k FROM {per}),
pk AS (SELECT {keys}, r, ((((a * no + b) % {p} * no + c) % {p} * no + d) % {p}) * k // {p} AS pick FROM nu CROSS JOIN co),
ra AS (SELECT {keys}, r, sum(s) / sum(n) AS rate FROM pk JOIN (SELECT {keys}, no, n, s FROM nu) u USING ({keys}) WHERE u.no = pick GROUP BY {keys}, r),
boot AS (SELECT {keys}, quantile_cont(rate, 0.025) AS ci_lo, quantile_cont(rate, 0.975) AS ci_hi FROM ra GROUP BY {keys})"""


@query(FRAMES + ", per AS (SELECT 1 AS one, clip, count(*) AS n, sum(event)::DOUBLE AS s FROM fr GROUP BY clip), " + bootstrap_sql("per", "one", 2000, 7)
       + """ SELECT round((SELECT sum(s) / sum(n) FROM per), 6) AS point, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi,
  (SELECT count(*) FROM per) AS clusters FROM boot""")
def cluster_bootstrap(spark, sf):
    return rounded(stats.cluster_bootstrap(frames(spark, sf), "clip", "event", replicates=2000, seed=7))


CONDITIONS = ["quantity", "discount", "sharpness", "tax"]
CORR = FRAMES + ", e AS (" + " UNION ALL ".join(
    f"SELECT clip, '{c}' AS condition, count({c}) AS n, "
    f"CASE WHEN min(event) < max(event) AND min({c}) < max({c}) AND count({c}) >= 3 THEN corr(event, {c}) END AS r, "
    f"avg(CASE WHEN event = 1 THEN {c} END) AS me, avg(CASE WHEN event = 0 THEN {c} END) AS mc, sum(event)::BIGINT AS events FROM fr GROUP BY clip"
    for c in CONDITIONS) + ")"


@query(CORR + """SELECT clip, condition, n, round(r, 6) AS r, round(me, 6) AS mean_when_event, round(mc, 6) AS mean_when_clean
FROM e QUALIFY row_number() OVER (PARTITION BY clip ORDER BY abs(round(r, 6)) DESC NULLS LAST, condition) <= 2""")
def condition_correlations(spark, sf):
    """The two strongest correlates of every supplier."""
    from ..operators.ranking import top_per_group

    tests = rounded(stats.point_biserial(frames(spark, sf), "event", CONDITIONS, ["clip"]))
    ranked = tests.withColumn("_size", F.coalesce(F.abs("r"), F.lit(-1.0)))
    return top_per_group(ranked, ["clip"], [F.col("_size").desc(), F.col("condition")], 2).drop("_size")


@query()
def condition_p_values(spark, sf):
    """Every condition over the whole table with its two-sided p (tail checked in the tests)."""
    tests = stats.point_biserial(frames(spark, sf), "event", CONDITIONS)
    return rounded(tests.withColumn("p", stats.correlation_p("r", "n")), 9)


@query(CORR + """SELECT clip, condition, n, round(CASE WHEN events > 0 THEN r END, 6) AS r, round(me, 6) AS mean_when_event,
  round(mc, 6) AS mean_when_clean, events, CASE WHEN events = 0 THEN 'no events, uninformative' ELSE 'tested' END AS verdict FROM e""")
def within_cluster_tests(spark, sf):
    return rounded(stats.within_cluster_tests(frames(spark, sf), "clip", "event", CONDITIONS))


@query("""WITH s AS (SELECT count(*) AS n, covar_pop(l_quantity, l_quantity) AS aa, covar_pop(l_discount, l_discount) AS bb,
  covar_pop(l_tax, l_tax) AS cc, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_tax) AS ac,
  covar_pop(l_discount, l_tax) AS bc, covar_pop(l_quantity, l_extendedprice) AS ay, covar_pop(l_discount, l_extendedprice) AS by_,
  covar_pop(l_tax, l_extendedprice) AS cy, var_pop(l_extendedprice) AS yy FROM lineitem),
d AS (SELECT *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) AS det FROM s),
b AS (SELECT n, yy, ay, by_, cy,
  (ay*(bb*cc-bc*bc) - ab*(by_*cc-bc*cy) + ac*(by_*bc-bb*cy)) / det AS b1,
  (aa*(by_*cc-bc*cy) - ay*(ab*cc-bc*ac) + ac*(ab*cy-by_*ac)) / det AS b2,
  (aa*(bb*cy-by_*bc) - ab*(ab*cy-by_*ac) + ay*(ab*bc-bb*ac)) / det AS b3 FROM d)
SELECT 'l_extendedprice' AS target, n, round((b1*ay + b2*by_ + b3*cy) / yy, 6) AS r2, round(b1, 3) AS coef_l_quantity,
  round(b2, 2) AS coef_l_discount, round(b3, 2) AS coef_l_tax FROM b""")
def mediation_ols(spark, sf):
    out = stats.mediation(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], ["l_extendedprice"])
    return out.select(
        "target", "n", F.round("r2", 6).alias("r2"), F.round("coef_l_quantity", 3).alias("coef_l_quantity"),
        F.round("coef_l_discount", 2).alias("coef_l_discount"), F.round("coef_l_tax", 2).alias("coef_l_tax"),
    )


@query("""WITH e AS (SELECT p_brand AS model, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS event, l_extendedprice, l_quantity
  FROM lineitem JOIN part ON p_partkey = l_partkey),
c AS (SELECT model, 'sharpness' AS condition, corr(event, l_extendedprice) AS r FROM e GROUP BY 1
  UNION ALL SELECT model, 'quantity', corr(event, l_quantity) FROM e GROUP BY 1)
SELECT a.condition, a.model AS a, b.model AS b, round(a.r, 6) AS r_a, round(b.r, 6) AS r_b
FROM c a JOIN c b ON a.condition = b.condition AND a.model < b.model AND a.r * b.r < 0""")
def opposed_pairs(spark, sf):
    items = frames(spark, sf).join(
        table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), F.col("p_brand").alias("model")), "partkey"
    )
    r = stats.point_biserial(items, "event", ["sharpness", "quantity"], ["model"])
    return rounded(stats.opposed_pairs(r))


@query("""SELECT user_id, avg(value).round(6) AS mean, min(value) AS min, max(value) AS max, round(stddev_samp(value), 6) AS std,
  round(median(value), 6) AS median, count(value) AS count FROM events GROUP BY user_id""")
def column_stats(spark, sf):
    return rounded(stats.column_stats(events(spark, sf), "value", ["user_id"]))


@query(FRAMES + """, q AS (SELECT quantile_cont(sharpness, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS e FROM fr),
b AS (SELECT linestatus, event, sharpness, unnest(range(0, 5)) AS bin, e FROM fr, q)
SELECT linestatus, bin::INT AS bin, count(*) AS n, round(avg(event), 6) AS rate, round(avg(sharpness), 4) AS centre
FROM b WHERE sharpness >= e[bin + 1] AND sharpness <= e[bin + 2] GROUP BY 1, 2 HAVING count(*) >= 20""")
def quantile_rate_curve(spark, sf):
    out = stats.quantile_curve(frames(spark, sf), "sharpness", "event", "linestatus")
    return out.select("linestatus", "bin", "n", F.round("rate", 6).alias("rate"), F.round("centre", 4).alias("centre"))


@query(FRAMES + """, c AS (SELECT year, clip, avg(event) AS rate FROM fr GROUP BY 1, 2),
w AS (SELECT * FROM c ORDER BY rate DESC, clip, year LIMIT 1),
k AS (SELECT c.* FROM c JOIN w ON c.year = w.year WHERE c.clip <> w.clip ORDER BY c.rate, c.clip LIMIT 1)
SELECT w.year, w.clip AS worst, round(w.rate, 6) AS worst_rate, k.clip AS cleanest, round(k.rate, 6) AS cleanest_rate FROM w, k""")
def extreme_clusters(spark, sf):
    per_year = frames(spark, sf).withColumn("clip", F.col("clip"))
    return rounded(stats.extreme_clusters(per_year, "clip", "year", "event"))


@query("""WITH r AS (SELECT event_id, user_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS i, count(*) OVER () AS n FROM events),
s AS (SELECT unnest(range(0, 12)) AS k)
SELECT k AS i, event_id, user_id, event_type, value FROM s JOIN r ON r.i = floor(k * (n - 1) / 11)""")
def evenly_spaced_rows(spark, sf):
    rows = events(spark, sf).select("event_id", "user_id", "event_type", "value")
    return stats.evenly_spaced(rows, ["event_id"], 12)


@query(FRAMES + f""", g AS (SELECT year, count(*) AS n, sum(event)::BIGINT AS k FROM fr GROUP BY 1), w AS (SELECT *, {LO} AS lo, {HI} AS hi FROM g)
SELECT a.year AS year_a, b.year AS year_b, round(a.lo, 6) AS lo_a, round(b.lo, 6) AS lo_b, a.hi >= b.lo AND b.hi >= a.lo AS overlap
FROM w a JOIN w b ON CAST(b.year AS INT) = CAST(a.year AS INT) + 1""")
def interval_overlap(spark, sf):
    """Whether the intervals of successive years meet."""
    p = stats.proportion(frames(spark, sf), ["year"], "event").withColumn("_y", F.col("year").cast("int"))
    a = p.select(F.col("year").alias("year_a"), (F.col("_y") + 1).alias("_y"), F.col("ci_lo").alias("lo_a"), F.col("ci_hi").alias("hi_a"))
    b = p.select(F.col("year").alias("year_b"), "_y", F.col("ci_lo").alias("lo_b"), F.col("ci_hi").alias("hi_b"))
    meets = overlap(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"))
    return rounded(a.join(b, "_y").select("year_a", "year_b", "lo_a", "lo_b", meets.alias("overlap")))
