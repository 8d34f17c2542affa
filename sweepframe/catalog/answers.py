"""Report functions called by name, over tables of requests; flight profiles of the frame table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import requests
from .bindings import events, frames
from .registry import query, table
from .statistics import CONDITIONS, FRAMES, HI, LO, bootstrap_sql, rounded

REPLICATES, SEED = 400, 11
STREAMS = ["click", "error", "purchase", "signup", "view", "sonar"]
MODELS = ["F", "O", "Q"]
STATISTICS = ["all", "mean", "median", "max", "mode"]


def _pick(key: str, words: list[str]) -> str:
    """The word that a row's key names, for Spark and for DuckDB."""
    return "CASE " + " ".join(f"WHEN {key} % {len(words)} = {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def profiles(spark, sf):
    """Frames of a supplier's pass; quantity stands for the commanded distance, there is no contrast."""
    return requests.flight_profiles(
        frames(spark, sf), columns={"commanded": "quantity", "depth": "discount", "temperature": "tax"}
    )


def samples(spark, sf):
    """Events as long telemetry: user = clip, type = stream, the value and the hour as columns, and one column that is never read."""
    e = events(spark, sf)
    readings = F.expr("stack(3, 'value', value, 'hour', CAST(hour(ts) AS DOUBLE), 'gain', CAST(NULL AS DOUBLE)) AS (column, value)")
    return e.select(F.col("user_id").cast("string").alias("clip"), F.col("event_type").alias("stream"), F.concat(F.lit("/"), "event_type").alias("source_topic"), "ts", F.col("value")).select(
        "clip", "stream", "source_topic", readings)


def ledger(spark, sf):
    """Nations as claims; their region decides the level."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_name").alias("topic"), F.concat(F.lit("lies in "), "r_name").alias("statement"),
                    F.when(F.col("r_regionkey") == 0, "not_validated").otherwise("measured_on_real_data").alias("level"),
                    F.lit(None).cast("string").alias("artifact"), F.format_string("region %d", "r_regionkey").alias("caveat"))


def notes(spark, sf):
    return table(spark, sf, "region").select(
        F.when(F.col("r_regionkey") < 3, "conclusion").otherwise("caveat").alias("kind"), F.col("r_regionkey").cast("int").alias("position"), F.col("r_name").alias("text"))


PROFILES = FRAMES + """, pr AS (SELECT clip, count(*) AS frames, round(median(quantity), 3) AS commanded_standoff_m, round(avg(standoff), 3) AS achieved_standoff_m,
  round(min(standoff), 2) AS standoff_min_m, round(max(standoff), 2) AS standoff_max_m, round(avg(net_speed), 3) AS net_speed_ms, round(avg(discount), 2) AS depth_m,
  round(avg(tax), 2) AS temperature_c, round(avg(sharpness), 1) AS sharpness, NULL::DOUBLE AS contrast FROM fr GROUP BY clip)
"""


@query(PROFILES + "SELECT * FROM pr")
def flight_profile_frames(spark, sf):
    found = profiles(spark, sf).withColumns({"standoff_min_m": F.col("standoff_range_m")[0], "standoff_max_m": F.col("standoff_range_m")[1]})
    return found.drop("standoff_range_m")


ASKED_MODEL = _pick("c_custkey", MODELS)


@query(FRAMES + f""", per AS (SELECT linestatus AS model, clip, count(*) AS n, sum(event)::DOUBLE AS s FROM fr GROUP BY ALL), {bootstrap_sql('per', 'model', REPLICATES, SEED)},
wi AS (SELECT model, n, k, k / n::DOUBLE AS rate, {LO} AS lo, {HI} AS hi FROM (SELECT linestatus AS model, count(*) AS n, sum(event)::BIGINT AS k FROM fr GROUP BY 1)),
cl AS (SELECT model, count(*) AS clips, min_by(clip, clip) AS first_clip, min_by(s / n, clip) AS first_rate FROM per GROUP BY 1),
rr AS (SELECT linestatus AS model, UNNEST([{', '.join(f"'{c}'" for c in CONDITIONS)}]) AS condition, UNNEST([{', '.join(f'corr(event, {c})' for c in CONDITIONS)}]) AS r FROM fr GROUP BY 1),
tc AS (SELECT model, list(round(abs(r), 6) ORDER BY round(abs(r), 6) DESC) AS sizes FROM rr GROUP BY 1)
SELECT c_custkey AS id, wi.model IS NOT NULL AS ok, CASE WHEN wi.model IS NULL THEN 'unknown model ' || asked END AS error, CASE WHEN wi.model IS NULL THEN 'F, O' END AS choices,
  round(rate, 6) AS rate, round(lo, 6) AS naive_lo, round(hi, 6) AS naive_hi, round(ci_lo, 6) AS clustered_lo, round(ci_hi, 6) AS clustered_hi, wi.n AS naive_n,
  clips, first_clip, round(first_rate, 6) AS first_rate, sizes[1] AS strongest, sizes[4] AS weakest
FROM (SELECT c_custkey, {ASKED_MODEL} AS asked FROM customer) q LEFT JOIN wi ON wi.model = asked LEFT JOIN boot ON boot.model = asked LEFT JOIN cl ON cl.model = asked LEFT JOIN tc ON tc.model = asked""")
def request_false_alarms(spark, sf):
    """Every customer asks for a model's false alarms; a third asks for one nobody trained."""
    found = frames(spark, sf).withColumnRenamed("linestatus", "model")
    requests.publish(spark, alarms=requests.alarm_summary(found, CONDITIONS, replicates=REPLICATES, seed=SEED))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("false_alarms").alias("name"), F.to_json(F.struct(F.expr(ASKED_MODEL).alias("model"))).alias("arguments"))
    at = lambda path, kind="double": F.variant_get("result", f"$.{path}", kind)
    read = {
        "ok": F.col("ok"), "error": F.col("error"), "choices": F.array_join("choices", ", "), "rate": at("rate"), "naive_lo": at("naive_ci95[0]"), "naive_hi": at("naive_ci95[1]"),
        "clustered_lo": at("clustered_ci95[0]"), "clustered_hi": at("clustered_ci95[1]"), "naive_n": at("naive_n", "bigint"),
        "clips": F.when(F.col("ok"), F.size(at("by_clip", "array<variant>")).cast("bigint")), "first_clip": at("by_clip[0].clip", "bigint"), "first_rate": at("by_clip[0].rate"),
        "strongest": F.abs(at("strongest_correlates[0].r")), "weakest": F.abs(at("strongest_correlates[3].r"))}
    return rounded(requests.answer(asked, read=read).select("id", *read))


@query(f"""WITH sm AS (SELECT user_id::VARCHAR AS clip, event_type AS stream, UNNEST(['value', 'hour', 'gain']) AS "column", UNNEST([value, hour(ts)::DOUBLE, NULL]) AS v FROM events),
st AS (SELECT clip, stream, "column", avg(v) AS mean, min(v) AS min, max(v) AS max, stddev_samp(v) AS std, median(v) AS median, count(v) AS count FROM sm GROUP BY ALL),
q AS (SELECT c_custkey AS id, (c_custkey % 160)::VARCHAR AS clip, {_pick('(c_custkey // 7)', STREAMS)} AS stream, {_pick('(c_custkey // 3)', ['value', 'hour', 'gain', 'depth'])} AS "column", {_pick('c_custkey', STATISTICS)} AS statistic FROM customer),
er AS (SELECT q.*, mean, min, max, std, median, count,
  (SELECT array_to_string(list_sort(list(DISTINCT stream)), ', ') FROM st WHERE st.clip = q.clip) AS streams, EXISTS (SELECT 1 FROM st WHERE st.clip = q.clip AND st.stream = q.stream) AS known
  FROM q LEFT JOIN st USING (clip, stream, "column")),
er2 AS (SELECT *, CASE WHEN NOT known THEN 'no telemetry for clip ' || clip || ' stream ' || stream WHEN count IS NULL THEN 'unknown column ' || "column" WHEN count = 0 THEN 'column gain has no values for this clip'
  WHEN statistic = 'mode' THEN 'unknown statistic mode' END AS error FROM er)
SELECT id, error IS NULL AS ok, error, CASE WHEN error LIKE 'no telemetry%' THEN coalesce(streams, '') WHEN error LIKE 'unknown column%' THEN 'gain, hour, value' WHEN error LIKE 'unknown statistic%' THEN 'count, max, mean, median, min, std' END AS choices,
  CASE WHEN error IS NULL THEN '/' || stream END AS source_topic,
  round(CASE WHEN error IS NULL AND statistic IN ('all', 'mean') THEN mean END, 6) AS mean, round(CASE WHEN error IS NULL AND statistic IN ('all', 'median') THEN median END, 6) AS median,
  CASE WHEN error IS NULL AND statistic IN ('all', 'max') THEN max END AS max, round(CASE WHEN error IS NULL AND statistic = 'all' THEN std END, 6) AS std, CASE WHEN error IS NULL AND statistic = 'all' THEN count::DOUBLE END AS count
FROM er2""")
def request_telemetry(spark, sf):
    """Every customer asks for a statistic of some user's telemetry, sometimes of a stream, column or statistic there isn't."""
    requests.publish(spark, telemetry=requests.telemetry_summary(samples(spark, sf)))
    arguments = F.struct((F.col("c_custkey") % 160).cast("string").alias("clip"), F.expr(_pick("(c_custkey div 7)", STREAMS)).alias("stream"),
                         F.expr(_pick("(c_custkey div 3)", ["value", "hour", "gain", "depth"])).alias("column"), F.expr(_pick("c_custkey", STATISTICS)).alias("statistic"))
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("telemetry_stat").alias("name"), F.to_json(arguments).alias("arguments"))
    at = lambda c: F.variant_get("result", f"$.result.{c}", "double").alias(c)
    return rounded(requests.answer(asked).select(
        "id", "ok", "error", F.array_join("choices", ", ").alias("choices"), F.variant_get("result", "$.source_topic", "string").alias("source_topic"), *[at(c) for c in ("mean", "median", "max", "std", "count")]))


@query(FRAMES + """, c AS (SELECT *, CASE WHEN NOT locked THEN ['net-plane estimate not locked'] ELSE list_filter([
    CASE WHEN standoff * 2 < 0.19 THEN printf('standoff %.2f m below validated minimum 0.19 m', standoff * 2) END,
    CASE WHEN standoff * 2 > 1.54 THEN printf('standoff %.2f m above validated maximum 1.54 m', standoff * 2) END,
    CASE WHEN net_speed > 0.35 THEN printf('sweep speed %.2f m/s above validated maximum 0.35 m/s', net_speed) END], lambda x: x IS NOT NULL) END AS rs FROM fr)
SELECT l_orderkey, l_linenumber, partkey, clip, CASE WHEN NOT locked THEN 'unknown' WHEN len(rs) > 0 THEN 'out_of_envelope' ELSE 'in_envelope' END AS status, array_to_string(rs, '; ') AS reasons FROM c""")
def request_capture(spark, sf):
    """Every frame asks whether its capture conditions are among the evaluated ones; the SQL function takes columns."""
    requests.publish(spark)
    frames(spark, sf).createOrReplaceTempView("asked_frames")
    return spark.sql("""SELECT l_orderkey, l_linenumber, partkey, clip, variant_get(f.result, '$.status', 'string') AS status,
        array_join(variant_get(f.result, '$.reasons', 'array<string>'), '; ') AS reasons
        FROM asked_frames q, LATERAL capture_check(q.standoff * 2, q.net_speed, q.locked) f""")


TOPIC = "CASE WHEN c_custkey % 10 = 0 THEN 'ATLANTIS' WHEN c_custkey % 11 = 0 THEN 'all' WHEN c_custkey % 13 = 0 THEN NULL ELSE n_name END"


@query(f"""WITH q AS (SELECT c_custkey AS id, {TOPIC} AS topic FROM customer JOIN nation ON n_nationkey = c_nationkey),
l AS (SELECT n_name, 'lies in ' || r_name AS statement, CASE WHEN r_regionkey = 0 THEN 'not_validated' ELSE 'measured_on_real_data' END AS level, r_regionkey FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT id, topic = 'all' AND topic IS NOT NULL OR l.n_name IS NOT NULL AS ok, CASE WHEN topic IS NULL OR topic <> 'all' AND l.n_name IS NULL THEN 'unknown topic ' || coalesce(topic, 'null') END AS error,
  (CASE WHEN topic IS NULL OR topic <> 'all' AND l.n_name IS NULL THEN (SELECT count(*) FROM l) ELSE -1 END)::INTEGER AS choices, l.statement, l.level, 'region ' || l.r_regionkey AS caveat,
  CASE WHEN topic = 'all' THEN (SELECT array_to_string(list_sort(list(n_name)), ',') FROM l WHERE level = 'not_validated') END AS unvalidated
FROM q LEFT JOIN l ON l.n_name = q.topic""")
def request_claims(spark, sf):
    """Every customer asks what may be claimed about its nation; some ask for the list, or for nothing known."""
    requests.publish(spark, claims=ledger(spark, sf))
    asked = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.expr(TOPIC).alias("topic"))
    asked.createOrReplaceTempView("asked_topics")
    at = lambda c: f"variant_get(f.result, '$.{c}', 'string') AS {c}"
    return spark.sql(f"""SELECT q.id, f.ok, f.error, coalesce(size(f.choices), -1) AS choices, {at('statement')}, {at('level')}, {at('caveat')},
        array_join(variant_get(f.result, '$.unvalidated', 'array<string>'), ',') AS unvalidated FROM asked_topics q, LATERAL claim_for(q.topic) f""")


NAMES = ["list_passes", "false_alarms", "claim_for", "telemetry_stat", "capture_check", "findings", "web_search"]
ARGUMENTS = ["{}", '{"model": "F"}', '{"topic": "NATION_3"}', '{"clip": "3", "stream": "click", "column": "value"}', '{"standoff_m": 0.5, "speed_ms": 0.2}', '{"verbose": true}', "[1, 2]", "no json"]
NEEDS = {"list_passes": [], "false_alarms": ["model"], "claim_for": ["topic"], "telemetry_stat": ["clip", "stream", "column"], "capture_check": ["standoff_m", "speed_ms"], "findings": []}
MAY = {**NEEDS, "telemetry_stat": [*NEEDS["telemetry_stat"], "statistic"], "capture_check": [*NEEDS["capture_check"], "net_lock"]}


def _outcome(name: str, arguments: str) -> tuple[bool, str | None, int]:
    """What a request of the table below comes to: ok, error, number of choices."""
    if name not in NEEDS:
        return False, f"unknown function {name}", len(NEEDS)
    if not arguments.startswith("{"):
        return False, f"bad arguments for {name}: not a JSON object", len(MAY[name])
    given = [w.strip().strip('"') for w in arguments.strip("{}").replace(",", ":").split(":")[::2] if w.strip()]
    lack, extra = [p for p in NEEDS[name] if p not in given], sorted(p for p in given if p not in MAY[name])
    if lack or extra:
        return False, f"bad arguments for {name}: missing [{', '.join(lack)}], unexpected [{', '.join(extra)}]", len(MAY[name])
    return True, None, -1


OUTCOMES = ", ".join(
    "({}, {}, {}, {}, {})".format(i, j, str(ok).lower(), "NULL" if error is None else f"'{error}'", choices)
    for i, n in enumerate(NAMES) for j, a in enumerate(ARGUMENTS) for ok, error, choices in [_outcome(n, a)])


@query(PROFILES + f""", o(i, j, ok, error, choices) AS (VALUES {OUTCOMES})
SELECT o_orderkey AS id, {_pick('o_orderkey', NAMES)} AS name, ok, error, choices, CASE WHEN ok THEN CASE i WHEN 0 THEN (SELECT max(frames) FROM pr)::VARCHAR WHEN 1 THEN 'F' WHEN 2 THEN 'NATION_3' WHEN 3 THEN 'all' WHEN 4 THEN 'in_envelope'
  WHEN 5 THEN (SELECT count(*) FROM region)::VARCHAR END END AS told
FROM orders JOIN o ON i = o_orderkey % {len(NAMES)} AND j = (o_orderkey // {len(NAMES)}) % {len(ARGUMENTS)}""")
def request_dispatch(spark, sf):
    """Every order is a request as a caller writes it: any function with any arguments, most of them wrong."""
    found = frames(spark, sf).withColumnRenamed("linestatus", "model")
    requests.publish(spark, passes=profiles(spark, sf), claims=ledger(spark, sf), findings=notes(spark, sf), telemetry=requests.telemetry_summary(samples(spark, sf)),
                     alarms=requests.alarm_summary(found, CONDITIONS, replicates=REPLICATES, seed=SEED))
    asked = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_pick("o_orderkey", NAMES)).alias("name"), F.expr(_pick(f"(o_orderkey div {len(NAMES)})", ARGUMENTS)).alias("arguments"))
    at = lambda path, kind="string": F.try_variant_get("result", f"$.{path}", kind)
    most = F.array_max(F.transform(at("passes", "array<variant>"), lambda p: F.variant_get(p, "$.frames", "bigint"))).cast("string")
    told = F.coalesce(at("model"), at("topic"), at("statistic"), at("status"), most, F.nullif(F.size(at("findings", "array<variant>")), F.lit(-1)).cast("string"))
    read = {"ok": F.col("ok"), "error": F.col("error"), "choices": F.coalesce(F.size("choices"), F.lit(-1)), "told": F.when(F.col("ok"), told)}
    return requests.answer(asked, read=read).select("id", "name", *read)
