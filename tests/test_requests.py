import json

import pytest
from pyspark.sql import functions as F

from sweepframe.operators import gates, requests


@pytest.fixture
def published(spark):
    samples = spark.createDataFrame(
        [("c1", "dvl", "v", 1.0, "/t"), ("c1", "dvl", "v", 3.0, "/t"), ("c1", "dvl", "w", None, "/t"), ("c2", "ins", "v", 5.0, "/u")],
        "clip string, stream string, column string, value double, source_topic string")
    claims = spark.createDataFrame(
        [("t1", "s", "not_validated", None, "x"), ("t2", "s2", "measured", "a", None)], "topic string, statement string, level string, artifact string, caveat string")
    frames = spark.createDataFrame([("m1", f"c{i % 4}", int(i % 3 == 0), float(i % 7), float(i)) for i in range(80)], "model string, clip string, event int, q double, z double")
    requests.publish(spark, telemetry=requests.telemetry_summary(samples), claims=claims, alarms=requests.alarm_summary(frames, ["q", "z"], replicates=50),
                     findings=spark.createDataFrame([("caveat", 2, "b"), ("caveat", 1, "a")], "kind string, position int, text string"))
    return spark


def asked(spark, *calls):
    rows = [(i, n, a if a is None or isinstance(a, str) else json.dumps(a)) for i, (n, a) in enumerate(calls)]
    got = requests.answer(spark.createDataFrame(rows, "id int, name string, arguments string"))
    return [(r["ok"], r["error"], r["choices"], json.loads(r["j"]) if r["j"] else None) for r in got.withColumn("j", F.to_json("result")).orderBy("id").collect()]


def test_answers(published):
    call = {"clip": "c1", "stream": "dvl", "column": "v"}
    whole, one, topics, topic, alarms, findings = asked(
        published, ("telemetry_stat", call), ("telemetry_stat", {**call, "statistic": "max"}), ("claim_for", {"topic": "all"}), ("claim_for", {"topic": "t1"}),
        ("false_alarms", {"model": "m1"}), ("findings", None))
    assert whole[0] and whole[3]["result"] == {"mean": 2.0, "min": 1.0, "max": 3.0, "std": pytest.approx(2**0.5), "median": 2.0, "count": 2.0} and whole[3]["source_topic"] == "/t"
    assert one[3]["result"] == {"max": 3.0}
    assert topics[3] == {"topics": ["t1", "t2"], "unvalidated": ["t1"]}
    assert topic[3] == {"topic": "t1", "statement": "s", "level": "not_validated", "artifact": None, "caveat": "x"}
    assert alarms[3]["rate"] == pytest.approx(27 / 80) and [c["clip"] for c in alarms[3]["by_clip"]] == ["c0", "c1", "c2", "c3"]
    assert {c["condition"] for c in alarms[3]["strongest_correlates"]} == {"q", "z"}
    assert [f["text"] for f in findings[3]["findings"]] == ["a", "b"]


def test_refusals_are_rows(published):
    call = {"clip": "c1", "stream": "dvl", "column": "v"}
    got = asked(
        published, ("telemetry_stat", {**call, "column": "zz"}), ("telemetry_stat", {**call, "stream": "nope"}), ("telemetry_stat", {**call, "clip": "c9"}), ("telemetry_stat", {**call, "column": "w"}),
        ("telemetry_stat", {**call, "statistic": "mode"}), ("claim_for", {"topic": "t9"}), ("claim_for", {"topic": None}), ("false_alarms", {"model": "m2"}), ("list_passes", {}),
        ("nonsense", {}), (None, {}), ("findings", "[1]"), ("findings", "{oops"), ("claim_for", {}), ("claim_for", {"topic": "t1", "x": 1}), ("findings", "null"))
    assert not any(ok for ok, *_ in got) and all(result is None for *_, result in got)
    assert [(e, c) for _, e, c, _ in got] == [
        ("unknown column zz", ["v", "w"]), ("no telemetry for clip c1 stream nope", ["dvl"]), ("no telemetry for clip c9 stream dvl", []), ("column w has no values for this clip", None),
        ("unknown statistic mode", ["count", "max", "mean", "median", "min", "std"]), ("unknown topic t9", ["t1", "t2"]), ("unknown topic null", ["t1", "t2"]), ("unknown model m2", ["m1"]), ("no passes published", None),
        ("unknown function nonsense", [r.name for r in requests.reports()]), ("unknown function null", [r.name for r in requests.reports()]),
        ("bad arguments for findings: not a JSON object", []), ("bad arguments for findings: not a JSON object", []), ("bad arguments for claim_for: missing [topic], unexpected []", ["topic"]),
        ("bad arguments for claim_for: missing [], unexpected [x]", ["topic"]), ("bad arguments for findings: not a JSON object", [])]


def test_nothing_asked(published):
    assert requests.answer(published.createDataFrame([], "id int, name string, arguments string")).count() == 0


@pytest.mark.parametrize("spec", [gates.OBSERVED_ENVELOPE, gates.Envelope(0.3, None, None, require_lock=False), gates.Envelope(fitted=False)])
def test_capture_check_is_the_gate(spark, spec):
    rows = [(s, v, lock) for s in (None, 0.05, 0.25, 1.0, 2.0) for v in (None, 0.1, 0.9) for lock in (None, True, False)]
    frames = spark.createDataFrame(rows, "standoff double, net_speed double, locked boolean")
    requests.publish(spark, spec=spec)
    frames.createOrReplaceTempView("conditions")
    got = spark.sql("""SELECT standoff, net_speed, locked, variant_get(f.result, '$.status', 'string') AS status, variant_get(f.result, '$.reasons', 'array<string>') AS reasons
        FROM conditions q, LATERAL capture_check(q.standoff, q.net_speed, q.locked) f""")
    want = gates.envelope_gate(frames, spec) if spec != gates.OBSERVED_ENVELOPE else gates.check_conditions(frames)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


def test_profiles_without_some_columns(spark):
    frames = spark.createDataFrame([("a", 1.0, 0.5), ("a", 2.0, 0.7), ("b", None, None)], "clip string, standoff double, net_speed double")
    a, b = requests.flight_profiles(frames).orderBy("clip").collect()
    assert (a["frames"], a["achieved_standoff_m"], a["standoff_range_m"], a["net_speed_ms"], a["commanded_standoff_m"], a["contrast"]) == (2, 1.5, [1.0, 2.0], 0.6, None, None)
    assert b["achieved_standoff_m"] is None


def test_equal_calls_are_read_once(published):
    calls = [("claim_for", '{"topic": "t1"}'), ("claim_for", '{"topic": "t9"}'), (None, "{}"), ("findings", None)]
    rows = published.createDataFrame([(i, *calls[i % 4]) for i in range(400)], "id int, name string, arguments string")
    got = requests.answer(rows, read={"ok": F.col("ok"), "level": F.variant_get("result", "$.level", "string"), "mark": F.uuid()}).collect()
    assert sorted(r["id"] for r in got) == list(range(400)) and len({r["mark"] for r in got}) == 4
    assert {(r["id"] % 4, r["ok"], r["level"]) for r in got} == {(0, True, "not_validated"), (1, False, None), (2, False, None), (3, True, None)}
    assert got[0].asDict().keys() == {"id", "name", "arguments", "ok", "level", "mark"}
