"""Report functions for callers that ask by name: SQL table functions and a dispatcher over a table of requests.

A request names a function and carries its arguments as a JSON object. An answer is a row
``ok, error, choices, result``: ``result`` is a VARIANT, and what cannot be answered is a row with an
``error`` text and the ``choices`` there are, never an exception. The functions are SQL table functions,
so a caller may also put them behind LATERAL, with columns of any table as arguments.

Nothing is computed per request. :func:`publish` registers summaries (a row per model, per telemetry
column, per claim, per pass) as views; a function looks its row up, which Spark plans as a join of the
distinct arguments with the summary.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import group_quantiles, pin
from . import gates, stats
from .ranking import top_per_group

ANSWER = "ok BOOLEAN, error STRING, choices ARRAY<STRING>, result VARIANT"
VIEWS = ("report_passes", "report_alarms", "report_claims", "report_telemetry", "report_findings")
#: Words that ask for the list of topics instead of one.
ALL_TOPICS = ("", "all", "list")
STRONGEST = 4


@dataclass(frozen=True)
class Report:
    """A callable report: its parameters with their SQL types, and how many of them must be given."""

    name: str
    parameters: tuple[tuple[str, str], ...]
    required: int
    body: str


# Summaries -------------------------------------------------------------------------------


def flight_profiles(frames: DataFrame, clip: str = "clip", columns: Mapping[str, str] | None = None) -> DataFrame:
    """One row per clip of a frame table: frames, commanded and achieved standoff with its range, speed, water, image quality.

    ``columns`` may rename ``commanded, standoff, net_speed, depth, temperature, sharpness, contrast``;
    a column the table lacks is NULL. The commanded standoff is the median, exact for clips of any size.
    """
    names = {c: c for c in ("commanded", "standoff", "net_speed", "depth", "temperature", "sharpness", "contrast")} | dict(columns or {})
    col = lambda c: F.col(names[c]) if names[c] in frames.columns else F.lit(None).cast("double")
    out = frames.groupBy(clip).agg(
        F.count(F.lit(1)).alias("frames"), F.round(F.avg(col("standoff")), 3).alias("achieved_standoff_m"),
        F.array(F.round(F.min(col("standoff")), 2), F.round(F.max(col("standoff")), 2)).alias("standoff_range_m"),
        F.round(F.avg(col("net_speed")), 3).alias("net_speed_ms"), F.round(F.avg(col("depth")), 2).alias("depth_m"),
        F.round(F.avg(col("temperature")), 2).alias("temperature_c"), F.round(F.avg(col("sharpness")), 1).alias("sharpness"),
        F.round(F.avg(col("contrast")), 1).alias("contrast"))
    if names["commanded"] not in frames.columns:
        return out.withColumn("commanded_standoff_m", F.lit(None).cast("double"))
    middle = group_quantiles(frames.where(col("commanded").isNotNull()), [clip], names["commanded"], [0.5], "_m")
    return out.join(middle, clip, "left").withColumn("commanded_standoff_m", F.round(F.col("_m")[0], 3)).drop("_m")


def alarm_summary(frames: DataFrame, conditions: Sequence[str], model: str = "model", clip: str = "clip", event: str = "event", replicates: int = 2000, seed: int = 0) -> DataFrame:
    """One row per model: false-alarm rate with naive and clustered interval, clustering, every clip, strongest correlates.

    ``frames`` has a row per model and frame, ``event`` is 0 or 1. Correlates are the four of largest |r|.
    """
    keys = [model]
    rate = stats.proportion(frames, keys, event).select(model, "rate", F.array("ci_lo", "ci_hi").alias("naive_ci95"))
    boot = stats.cluster_bootstrap(frames, clip, event, replicates, seed, keys).select(model, F.array("ci_lo", "ci_hi").alias("clustered_ci95"))
    spread = stats.icc(frames, clip, event, keys).select(model, "icc", "effective_n", "naive_n")
    per_clip = stats.proportion(frames, [model, clip], event).groupBy(model).agg(
        F.array_sort(F.collect_list(F.struct(F.col(clip).alias("clip"), "rate", F.col("n").alias("frames")))).alias("by_clip"))
    tests = stats.point_biserial(frames, event, conditions, keys)
    ranked = top_per_group(tests.withColumn("_size", F.coalesce(F.abs("r"), F.lit(-1.0))), keys, [F.desc("_size"), F.col("condition")], STRONGEST)
    ranked = ranked.withColumn("p", stats.correlation_p("r", "n")).groupBy(model).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("_size")).alias("_by"), "condition", "r", "p"))).alias("_c"))
    correlates = ranked.select(model, F.transform("_c", lambda c: F.struct(c["condition"].alias("condition"), c["r"].alias("r"), c["p"].alias("p"))).alias("strongest_correlates"))
    out = rate
    for part in (boot, spread, per_clip, correlates):
        out = out.join(part, model, "left")
    return out


def telemetry_summary(samples: DataFrame) -> DataFrame:
    """``clip, stream, column, mean, min, max, std, median, count, source_topic`` of long samples.

    ``samples``: ``clip, stream, column, value`` and perhaps ``source_topic``, one row per reading;
    columns that never had a value have count 0.
    """
    keys = ["clip", "stream", "column"]
    topic = F.min("source_topic") if "source_topic" in samples.columns else F.lit(None).cast("string")
    return stats.column_stats(samples, "value", keys).join(samples.groupBy(*keys).agg(topic.alias("source_topic")), keys)


# Functions -------------------------------------------------------------------------------


def _quoted(words: Sequence[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _capture_body(spec: gates.Envelope) -> str:
    # The sentences of gates.envelope_gate.
    over = [f"CASE WHEN standoff_m < {spec.standoff_min} THEN format_string('standoff %.2f m below validated minimum %.2f m', standoff_m, {spec.standoff_min}D) END"]
    if spec.standoff_max is not None:
        over.append(f"CASE WHEN standoff_m > {spec.standoff_max} THEN format_string('standoff %.2f m above validated maximum %.2f m', standoff_m, {spec.standoff_max}D) END")
    if spec.speed_max is not None:
        over.append(f"CASE WHEN speed_ms > {spec.speed_max} THEN format_string('sweep speed %.2f m/s above validated maximum %.2f m/s', speed_ms, {spec.speed_max}D) END")
    lock = "WHEN NOT coalesce(net_lock, false) THEN 'net-plane estimate not locked'" if spec.require_lock else ""
    blocked = f"CASE {lock} WHEN standoff_m IS NULL THEN 'no standoff telemetry for this frame' END" if spec.fitted else "'no validated operating envelope for this model'"
    return f"""SELECT true, CAST(NULL AS STRING), CAST(NULL AS ARRAY<STRING>), to_variant_object(named_struct(
  'status', CASE WHEN blocked IS NOT NULL THEN '{gates.UNKNOWN}' WHEN size(over) > 0 THEN '{gates.OUT_OF_ENVELOPE}' ELSE '{gates.IN_ENVELOPE}' END,
  'reasons', CASE WHEN blocked IS NOT NULL THEN array(blocked) ELSE over END))
FROM (SELECT {blocked} AS blocked, filter(array({', '.join(over)}), r -> r IS NOT NULL) AS over)"""


def reports(spec: gates.Envelope = gates.OBSERVED_ENVELOPE) -> tuple[Report, ...]:
    """The callable functions; ``spec`` is the range that capture conditions are checked against."""
    values = ", ".join(f"'{s}', any_value({s})" for s in stats.STATISTICS)
    telemetry = f"""SELECT error IS NULL, error, CASE WHEN error LIKE 'unknown statistic%' THEN array({_quoted(sorted(stats.STATISTICS))})
    WHEN error LIKE 'unknown column%' THEN names WHEN error LIKE 'no telemetry%' THEN streams END,
  CASE WHEN error IS NULL THEN to_variant_object(named_struct('clip', clip, 'stream', stream, 'column', column, 'statistic', statistic, 'source_topic', topic,
    'result', CASE WHEN statistic = 'all' THEN found ELSE map_filter(found, (k, v) -> k = statistic) END)) END
FROM (SELECT *, CASE WHEN rows = 0 THEN concat('no telemetry for clip ', coalesce(clip, 'null'), ' stream ', coalesce(stream, 'null'))
      WHEN NOT array_contains(names, column) OR column IS NULL THEN concat('unknown column ', coalesce(column, 'null'))
      WHEN coalesce(found['count'], 0) = 0 THEN concat('column ', column, ' has no values for this clip')
      WHEN statistic IS NULL OR statistic <> 'all' AND statistic NOT IN ({_quoted(stats.STATISTICS)}) THEN concat('unknown statistic ', coalesce(statistic, 'null')) END AS error
  FROM (SELECT count(*) AS rows, sort_array(collect_set(t.column)) AS names, any_value(source_topic) AS topic FROM report_telemetry t WHERE t.clip = telemetry_stat.clip AND t.stream = telemetry_stat.stream),
    (SELECT map({values}) AS found FROM report_telemetry t WHERE t.clip = telemetry_stat.clip AND t.stream = telemetry_stat.stream AND t.column = telemetry_stat.column),
    (SELECT sort_array(collect_set(t.stream)) AS streams FROM report_telemetry t WHERE t.clip = telemetry_stat.clip))"""
    one = lambda view, key, what, asked: f"""SELECT n > 0, CASE WHEN n = 0 THEN concat('unknown {what} ', coalesce({asked}, 'null')) END,
  CASE WHEN n = 0 THEN (SELECT sort_array(collect_set(CAST({key} AS STRING))) FROM {view}) END, r
FROM (SELECT count(*) AS n, any_value(to_variant_object(struct(*))) AS r FROM {view} WHERE CAST({key} AS STRING) = {asked})"""  # noqa: E731
    topics = f"""SELECT listed OR n > 0, CASE WHEN NOT listed AND n = 0 THEN concat('unknown topic ', coalesce(topic, 'null')) END, CASE WHEN NOT listed AND n = 0 THEN known END,
  CASE WHEN listed THEN to_variant_object(named_struct('topics', known, 'unvalidated', open)) ELSE r END
FROM (SELECT coalesce(topic IN ({_quoted(ALL_TOPICS)}), false) AS listed),
  (SELECT count(*) AS n, any_value(to_variant_object(struct(*))) AS r FROM report_claims c WHERE c.topic = claim_for.topic),
  (SELECT sort_array(collect_set(topic)) AS known, sort_array(collect_set(topic) FILTER (WHERE level = 'not_validated')) AS open FROM report_claims)"""
    whole = lambda view, what: f"""SELECT size(rows) > 0, CASE WHEN size(rows) = 0 THEN 'no {what} published' END, CAST(NULL AS ARRAY<STRING>), CASE WHEN size(rows) > 0 THEN to_variant_object(named_struct('{what}', rows)) END
FROM (SELECT array_sort(collect_list(struct(*))) AS rows FROM {view})"""  # noqa: E731
    return (
        Report("list_passes", (), 0, whole("report_passes", "passes")),
        Report("false_alarms", (("model", "STRING"),), 1, one("report_alarms", "model", "model", "false_alarms.model")),
        Report("claim_for", (("topic", "STRING"),), 1, topics),
        Report("telemetry_stat", (("clip", "STRING"), ("stream", "STRING"), ("column", "STRING"), ("statistic", "STRING")), 3, telemetry),
        Report("capture_check", (("standoff_m", "DOUBLE"), ("speed_ms", "DOUBLE"), ("net_lock", "BOOLEAN")), 2, _capture_body(spec)),
        Report("findings", (), 0, whole("report_findings", "findings")),
    )


#: What an optional argument is when it isn't given.
DEFAULTS = {"statistic": "'all'", "net_lock": "true"}


def publish(
    spark: SparkSession, *, passes: DataFrame | None = None, alarms: DataFrame | None = None, claims: DataFrame | None = None,
    telemetry: DataFrame | None = None, findings: DataFrame | None = None, spec: gates.Envelope = gates.OBSERVED_ENVELOPE,
) -> tuple[str, ...]:
    """Register the summaries as views and the reports as SQL table functions; returns the functions' names.

    A summary that is left out is an empty view: its function then answers that nothing is published.
    ``findings`` has ``kind, position, text``. Calling it again replaces everything. Summaries are stored,
    since a function reads one more than once.
    """
    empty = {
        "report_passes": "clip STRING, frames BIGINT", "report_alarms": "model STRING, rate DOUBLE", "report_claims": "topic STRING, statement STRING, level STRING, artifact STRING, caveat STRING",
        "report_telemetry": "clip STRING, stream STRING, column STRING, " + ", ".join(f"{s} {'BIGINT' if s == 'count' else 'DOUBLE'}" for s in stats.STATISTICS) + ", source_topic STRING",
        "report_findings": "kind STRING, position INT, text STRING",
    }
    for view, given in zip(VIEWS, (passes, alarms, claims, telemetry, findings)):
        (spark.createDataFrame([], empty[view]) if given is None else pin(given)).createOrReplaceTempView(view)
    for r in reports(spec):
        parameters = ", ".join(f"{n} {t} DEFAULT {DEFAULTS[n]}" if n in DEFAULTS else f"{n} {t}" for n, t in r.parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {r.name}({parameters}) RETURNS TABLE({ANSWER}) RETURN {r.body}")
    return tuple(r.name for r in reports(spec))


def answer(
    requests: DataFrame, name: str = "name", arguments: str = "arguments", read: Mapping[str, Column] | None = None
) -> DataFrame:
    """``requests`` with ``ok, error, choices, result``; call :func:`publish` before.

    ``arguments`` is JSON text, an object or null for none. An unknown function, text that is no JSON
    object, a missing or unexpected argument, and whatever a function refuses, are error rows.
    A result may be as long as a table of clips, and every request gets a copy. ``read`` names columns over
    ``ok, error, choices, result`` to give instead: each different call is answered and read once, and
    only what was read goes to its requests.
    """
    if read is not None:
        # Stored: each function reads the calls, and its filters would be pushed to the requests.
        calls = pin(requests.select(F.col(name).alias("_name"), F.col(arguments).alias("_arguments")).distinct())
        told = pin(answer(calls, "_name", "_arguments").select("_name", "_arguments", *[c.alias(n) for n, c in read.items()]))
        same = F.col(name).eqNullSafe(F.col("_name")) & F.col(arguments).eqNullSafe(F.col("_arguments"))
        return requests.join(told, same).drop("_name", "_arguments")
    known = reports()
    parsed = requests.withColumn("_a", F.try_parse_json(F.coalesce(F.col(arguments), F.lit("{}"))))
    object_ = F.coalesce(F.schema_of_variant("_a").startswith("OBJECT"), F.lit(False))
    keys = F.when(object_, F.coalesce(F.json_object_keys(F.coalesce(F.col(arguments), F.lit("{}"))), F.array().cast("array<string>")))
    parsed = parsed.withColumn("_keys", keys)
    named = F.col(name)
    trouble, offered = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.array().cast("array<string>"))
    for r in known:
        allowed = F.array(*[F.lit(p) for p, _ in r.parameters]).cast("array<string>")
        needed = F.array(*[F.lit(p) for p, _ in r.parameters[: r.required]]).cast("array<string>")
        lack, extra = F.array_except(needed, "_keys"), F.array_sort(F.array_except(F.col("_keys"), allowed))
        text = F.when(F.col("_keys").isNull(), F.lit(f"bad arguments for {r.name}: not a JSON object")).when(
            (F.size(lack) > 0) | (F.size(extra) > 0),
            F.concat(F.lit(f"bad arguments for {r.name}: missing ["), F.array_join(lack, ", "), F.lit("], unexpected ["), F.array_join(extra, ", "), F.lit("]")))
        trouble, offered = trouble.when(named == r.name, text), offered.when(named == r.name, allowed)
    unknown = F.concat(F.lit("unknown function "), F.coalesce(named, F.lit("null")))
    names = F.array(*[F.lit(r.name) for r in known])
    parsed = parsed.withColumns({"_error": trouble.when(~F.coalesce(named.isin(*[r.name for r in known]), F.lit(False)), unknown),
                                 "_choices": offered.otherwise(names)})
    spark, kept = requests.sparkSession, requests.columns
    refused = parsed.where(F.col("_error").isNotNull()).select(
        *kept, F.lit(False).alias("ok"), F.col("_error").alias("error"), F.col("_choices").alias("choices"), F.lit(None).cast("variant").alias("result"))
    asked = parsed.where(F.col("_error").isNull())
    shown = ", ".join(f"q.`{c}`" for c in kept)
    for r in known:
        given = [F.try_variant_get("_a", f"$.{n}", t) for n, t in r.parameters]
        given = [F.coalesce(g, F.expr(DEFAULTS[n])) if n in DEFAULTS else g for g, (n, _) in zip(given, r.parameters)]
        typed = asked.where(named == r.name).select(*kept, *[g.alias(f"_p{i}") for i, g in enumerate(given)])
        call = f"{r.name}({', '.join(f'q._p{i}' for i in range(len(given)))})"
        refused = refused.unionByName(spark.sql(f"SELECT {shown}, f.* FROM {{typed}} q, LATERAL {call} f", typed=typed))
    return refused
