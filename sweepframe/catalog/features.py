"""Anomaly models and memory banks on embeddings; label 0 is normal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.parsing import mean_of
from ..operators import detections, vectors
from ..plans import pin
from ..plans.seeded import draw_sql
from .registry import query, table
from .statistics import rounded


def embeddings(spark, sf):
    return table(spark, sf, "embeddings").withColumn("v", F.transform("embedding", lambda x: x.cast("double")))


def thirds(spark, sf):
    """Three features per vector: the means of its thirds."""
    e = embeddings(spark, sf)
    return e.withColumn("f", F.array(*[mean_of(F.slice("v", a, n)) for a, n in ((1, 21), (22, 21), (43, 22))]))


GAUSS = """
WITH f AS (SELECT vec_id, label, list_avg(embedding[1:21]::DOUBLE[]) AS a, list_avg(embedding[22:42]::DOUBLE[]) AS b, list_avg(embedding[43:64]::DOUBLE[]) AS c FROM embeddings),
s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) + 1e-6 AS sa, stddev_pop(b) + 1e-6 AS sb, stddev_pop(c) + 1e-6 AS sc FROM f WHERE label = 0),
z AS (SELECT vec_id, label, (a - ma) / sa AS x, (b - mb) / sb AS y, (c - mc) / sc AS w FROM f, s),
k AS (SELECT 0.9 * covar_samp(x, x) + 0.1 AS xx, 0.9 * covar_samp(y, y) + 0.1 AS yy, 0.9 * covar_samp(w, w) + 0.1 AS ww,
  0.9 * covar_samp(x, y) AS xy, 0.9 * covar_samp(x, w) AS xw, 0.9 * covar_samp(y, w) AS yw FROM z WHERE label = 0),
d AS (SELECT *, xx * (yy * ww - yw * yw) - xy * (xy * ww - yw * xw) + xw * (xy * yw - yy * xw) AS det FROM k),
q AS (SELECT vec_id, label, sqrt((x*x*(yy*ww-yw*yw) + y*y*(xx*ww-xw*xw) + w*w*(xx*yy-xy*xy)
  + 2*x*y*(xw*yw-xy*ww) + 2*x*w*(xy*yw-xw*yy) + 2*y*w*(xy*xw-xx*yw)) / det) AS distance FROM z, d)
"""


def _gauss(spark, sf):
    f = thirds(spark, sf)
    model = vectors.fit_gaussian(f.where(F.col("label") == 0), "f")
    return vectors.mahalanobis(f, "f", model)


@query(GAUSS + "SELECT vec_id, label, round(distance, 6) AS distance FROM q")
def gaussian_anomaly(spark, sf):
    return rounded(_gauss(spark, sf).select("vec_id", "label", "distance"))


@query(GAUSS + "SELECT label, round(max(distance), 6) AS score, (SELECT round(quantile_cont(distance, 0.99), 6) FROM q WHERE label = 0) AS threshold FROM q GROUP BY label")
def anomaly_threshold(spark, sf):
    scored = _gauss(spark, sf)
    cut = vectors.distance_threshold(scored.where(F.col("label") == 0)).scalar()
    return rounded(vectors.frame_scores(scored, "label").withColumn("threshold", cut))


@query()
def gaussian_full_vector(spark, sf):
    """All 64 dimensions; the arithmetic is checked against NumPy in the tests."""
    e = embeddings(spark, sf)
    model = vectors.fit_gaussian(e.where(F.col("label") == 0), "v")
    return rounded(vectors.mahalanobis(e, "v", model).select("vec_id", "label", "distance"))


NEAREST = """
WITH b AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE label = 0),
d AS (SELECT vec_id, label, min(list_distance(embedding::DOUBLE[], v)) AS distance FROM embeddings, b GROUP BY 1, 2)
"""


def _nearest(spark, sf):
    e = embeddings(spark, sf)
    near = vectors.nearest_in_bank(e.select("vec_id", "v"), e.where(F.col("label") == 0), "vec_id", "v")
    return near.join(e.select("vec_id", "label"), "vec_id")


@query(NEAREST + "SELECT vec_id, label, round(distance, 6) AS distance FROM d")
def nn_memory_bank(spark, sf):
    return rounded(_nearest(spark, sf).select("vec_id", "label", "distance"))


@query(NEAREST + "SELECT round(median(distance), 6) AS median, round(quantile_cont(distance, 0.99), 6) AS p99, round(2 * median(distance), 6) AS threshold FROM d WHERE label <> 0")
def bank_threshold(spark, sf):
    return rounded(vectors.bank_threshold(pin(_nearest(spark, sf).where(F.col("label") != 0))))


@query(NEAREST + """, t AS (SELECT quantile_cont(distance, 0.95) AS thr FROM d WHERE label = 1)
SELECT label, count(*) AS frames, round(avg(CASE WHEN distance >= thr THEN 1.0 ELSE 0.0 END), 6) AS flag_rate, round(avg(distance), 6) AS mean_score,
  round(any_value(thr), 6) AS threshold FROM d, t GROUP BY 1""")
def ood_calibrate_flag(spark, sf):
    rows = pin(_nearest(spark, sf).withColumnRenamed("distance", "score"))  # read for the cut-off and for the flags
    threshold = detections.ood_threshold(rows.where(F.col("label") == 1))
    flagged = detections.ood_flags(rows, threshold)
    return rounded(flagged.groupBy("label").agg(
        F.count(F.lit(1)).alias("frames"), F.avg(F.when(F.col("ood"), 1.0).otherwise(0.0)).alias("flag_rate"),
        F.avg("score").alias("mean_score")).withColumn("threshold", threshold.scalar()))


@query(f"SELECT vec_id, label FROM embeddings ORDER BY {draw_sql(3, 'vec_id')}, vec_id LIMIT 64")
def random_bank(spark, sf):
    return vectors.random_bank(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", 64, seed=3)


PICKS, HELD = 8, 128


def farthest_sql(name: str, rows: str) -> str:
    """Common tables ending in ``name(g, vec_id, v)``: the farthest-point picks of every group of ``rows(g, vec_id, v)``."""
    return f"""{name}_st AS (
  SELECT g, 1 AS step, vec_id, v, list_distance(v, arg_min(v, vec_id) OVER (PARTITION BY g)) AS gap, min(vec_id) OVER (PARTITION BY g) AS pick FROM {rows}
  UNION ALL
  SELECT g, step + 1, vec_id, v, least(gap, list_distance(v, nv)), nid FROM (
    SELECT *, first_value(vec_id) OVER w AS nid, first_value(v) OVER w AS nv FROM {name}_st WHERE step < {PICKS} WINDOW w AS (PARTITION BY g ORDER BY gap DESC, vec_id))
), {name} AS (SELECT DISTINCT g, vec_id, v FROM {name}_st WHERE vec_id = pick)"""


@query(f"""WITH RECURSIVE n AS (SELECT (1 << greatest(0, ceil(log2(greatest(1, 2.0 * count(*) / {HELD})))::INTEGER))::BIGINT AS groups FROM embeddings),
e AS (SELECT {draw_sql(0, 'vec_id')} % groups AS g, vec_id, embedding::DOUBLE[] AS v FROM embeddings, n), {farthest_sql('one', 'e')},
m AS (SELECT 0 AS g, vec_id, v FROM one), {farthest_sql('two', 'm')}
SELECT vec_id FROM two""")
def kcenter_bank(spark, sf):
    """Farthest-point picks from groups, then from all their picks."""
    e = embeddings(spark, sf).select("vec_id", "v")
    return vectors.kcenter_bank(e, "vec_id", "v", PICKS, held=HELD).select("vec_id")


@query("""WITH p AS (SELECT vec_id, list_filter(list_transform(embedding::DOUBLE[], lambda x: round((x + 0.5) * 2000)), lambda b: b > 1000) AS b,
  list_transform(embedding[1:8]::DOUBLE[], lambda x: CASE WHEN x > 0.1 THEN 65535.0 ELSE round(1500 + x * 1000) END) AS t FROM embeddings)
SELECT vec_id, round(list_avg(b), 6) AS altitude, round(list_avg(list_transform(list_filter(t, lambda x: x <> 65535.0), lambda x: abs(x - 1500))), 6) AS thrust_effort,
  CASE WHEN t[1] <> 65535.0 THEN t[1] END AS thrust_0 FROM p""")
def sentinel_array_effort(spark, sf):
    """Beam means and thruster effort with absent channels; arrays come from the vectors."""
    from ..functions.parsing import mean_positive
    from ..sources.telemetry import thrust_columns

    e = embeddings(spark, sf)
    beams = F.transform("v", lambda x: F.round((x + 0.5) * 2000) - 1000)
    pwm = F.transform("v", lambda x: F.when(x > 0.1, 65535.0).otherwise(F.round(1500 + x * 1000)))
    cols = thrust_columns(F.col("pwm"))
    rows = e.select("vec_id", beams.alias("beams"), pwm.alias("pwm")).select("vec_id", (mean_positive(F.col("beams")) + 1000).alias("altitude"), *cols)
    return rounded(rows.select("vec_id", "altitude", "thrust_effort", "thrust_0"))
