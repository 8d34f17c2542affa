import pandas as pd
import pytest
from pyspark.sql import functions as F

from sweepframe.functions import parsing
from sweepframe.operators import timealign
from sweepframe.sources import telemetry

STREAM = "clip string, t double, v double, source_topic string"


def stream(spark, samples):
    return spark.createDataFrame([("c", float(t), float(v), "top") for t, v in samples], STREAM)


def frames(spark, times):
    return spark.createDataFrame([("c", f"f{i}", t) for i, t in enumerate(times)], "clip string, frame string, t double")


def joined(spark, times, samples, tol=0.5):
    out = timealign.asof_nearest(frames(spark, times), {"s": stream(spark, samples)}, by=["clip"], time="t", tolerance=tol, tiebreak="v")
    return {r["frame"]: r["s_v"] for r in out.collect()}


def test_one_sample_per_frame(spark):
    assert joined(spark, [100.0, 100.5], [(100.0, 0.60), (100.5, 0.72)]) == {"f0": 0.60, "f1": 0.72}


def test_never_stale_beyond_tolerance(spark):
    assert joined(spark, [100.0], [(999.0, 1.0)]) == {"f0": None}
    assert joined(spark, [100.0], [(100.5, 1.0)]) == {"f0": 1.0}, "the tolerance itself still counts"


def test_equal_distance_takes_the_earlier(spark):
    assert joined(spark, [100.0], [(99.75, 1.0), (100.25, 2.0)]) == {"f0": 1.0}


def test_untimed_rows_stay(spark):
    assert joined(spark, [None, 100.0], [(100.0, 1.0)]) == {"f0": None, "f1": 1.0}


@pytest.mark.parametrize("limit", ["1000000", "30"])
def test_same_as_pandas(spark, limit):
    left = [(i * 7919 % 1000) / 4 for i in range(120)]
    right = [((i * 104729 % 997) / 4, float(i)) for i in range(90)]
    right = list({t: (t, v) for t, v in right}.values())
    spark.conf.set("spark.sweepframe.groupRows", limit)
    try:
        got = joined(spark, left, right, 1.0)
    finally:
        spark.conf.unset("spark.sweepframe.groupRows")
    a = pd.DataFrame({"t": left, "frame": [f"f{i}" for i in range(len(left))]}).sort_values("t", kind="stable")
    b = pd.DataFrame(right, columns=["t", "v"]).sort_values("t")
    want = pd.merge_asof(a, b, on="t", direction="nearest", tolerance=1.0)
    assert got == {f: (None if pd.isna(v) else v) for f, v in zip(want["frame"], want["v"])}


def test_index_lookup_keeps_frames_outside_the_index(spark):
    index = spark.createDataFrame([("clipA", [5.0])], "clip string, times array<double>")
    paths = spark.createDataFrame([("d/clipA_video_000000.jpg",), ("d/clipA_video_000009.jpg",), ("d/notes.txt",)], "path string")
    out = timealign.frame_records(paths, timealign.index_times(index)).orderBy("msg_index").collect()
    assert [(r["clip"], r["msg_index"], r["t"]) for r in out] == [("clipA", 0, 5.0), ("clipA", 9, None)]


def test_numbers_longer_than_the_name(spark):
    """A number given beside a path counts; without one the name's is read."""
    times = spark.createDataFrame([("c1", 1234567, 7.0), ("c1", 123456, 3.0)], "clip string, msg_index bigint, t double")
    paths = spark.createDataFrame([("c1_video_123456.jpg", 1234567), ("c1_video_123456.png", None)], "path string, msg_index bigint")
    out = timealign.frame_records(paths, times).orderBy("frame").collect()
    assert [(r["frame"], r["clip"], r["msg_index"], r["t"]) for r in out] == [("c1_video_123456.jpg", "c1", 1234567, 7.0), ("c1_video_123456.png", "c1", 123456, 3.0)]


def test_join_frames_and_coverage(spark):
    index = spark.createDataFrame([("clipA", [100.0, 500.0])], "clip string, times array<double>")
    paths = spark.createDataFrame([("clipA_video_000000.jpg",), ("clipA_video_000001.jpg",)], "path string")
    plane = spark.createDataFrame([("clipA", 100.0, 0.6, 1.0, 0.3, 0.4, "p")], "clip string, t double, net_distance double, net_lock double, net_vel_u double, net_vel_v double, source_topic string")
    table = timealign.frame_table(timealign.join_frames(paths, timealign.index_times(index), {"net_plane": plane}))
    cover = timealign.join_coverage(table, "net_plane_net_distance").first()
    assert (cover["frames"], cover["timestamped"], cover["matched"], cover["matched_pct"]) == (2, 2, 1, 50.0)
    good = timealign.usable_frames(table).collect()
    assert len(good) == 1 and abs(good[0]["net_speed"] - 0.5) < 1e-12 and good[0]["depth"] is None


def test_coverage_of_nothing(spark):
    none = spark.createDataFrame([], "t double, x double")
    row = timealign.join_coverage(none, "x").first()
    assert row["frames"] == 0 and row["matched_pct"] is None


@pytest.mark.parametrize("text,want", [("1.5", 1.5), ("abc", None), ("NaN", None), (None, None), ("1e3", 1000.0)])
def test_safe_double(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(parsing.safe_double(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("path,want", [("x/2024-08-22_14-47-39_data.bag", "2024-08-22_14-47-39"), ("2024_video.bag", "2024"), ("plain.bag", "plain")])
def test_clip_id(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(parsing.clip_id(F.col("p"))).first()[0] == want


@pytest.mark.parametrize("name,want", [("clip_000123", "clip"), ("a-b-0042", "a-b"), ("frame12", "frame12")])
def test_group_of(spark, name, want):
    assert spark.createDataFrame([(name,)], "p string").select(parsing.group_of(F.col("p"))).first()[0] == want


def messages(spark, found):
    return spark.createDataFrame([("c", t, "m", n, p) for t, n, p in found], "clip string, topic string, msgtype string, ts_ns bigint, payload string")


def test_second_choice_instrument(spark):
    m = messages(spark, [
        ("/nucleus1000dvl/bottomtrack", 2_000_000_000, '{"dvl_velocity_xyz":{"x":1,"y":2,"z":"bad"},"beam_distance":[2.0,-1.0,4.0],"dvl_fom_xyz":{"x":0.1},"data_valid":true}'),
        ("/nucleus1000dvl/bottomtrack", 3_000_000_000, '{"beam_distance":[0.0,-1.0]}')])
    a, b = telemetry.extract_stream(m, "dvl").orderBy("ts_ns").collect()
    assert (a["vel_x"], a["vel_z"], a["altitude"], a["fom"], a["valid"]) == (1.0, None, 3.0, 0.1, 1.0)
    assert b["altitude"] is None and b["valid"] == 0.0 and b["source_topic"] == "/nucleus1000dvl/bottomtrack"


def test_first_present_topic_wins(spark):
    m = messages(spark, [("/sensor/dvl_velocity", 1, '{"velocity":{"x":5,"y":0,"z":0},"altitude":2.5,"velocity_valid":"True"}'), ("/nucleus1000dvl/bottomtrack", 2, "{}")])
    (row,) = telemetry.extract_stream(m, "dvl").collect()
    assert row["vel_x"] == 5.0 and row["altitude"] == 2.5 and row["valid"] == 1.0


def test_absent_thruster_channels(spark):
    m = messages(spark, [("/commanded_thrust", 1, '{"data":[1600,1400,65535,65535]}')])
    (row,) = telemetry.extract_stream(m, "thrust").collect()
    assert (row["thrust_0"], row["thrust_2"], row["thrust_7"], row["thrust_effort"], row["t_header"]) == (1600.0, None, None, 100.0, None)


def test_header_and_normal(spark):
    m = messages(spark, [("/navigation/plane_approximation", 10, '{"NetDistance":0.6,"NetLock":1,"NormalDVL":[0.1,0.2],"header":{"stamp":{"sec":12,"nanosec":500000000}}}')])
    (row,) = telemetry.extract_stream(m, "net_plane").collect()
    assert (row["net_distance"], row["net_normal_y"], row["net_normal_z"], row["t_header"]) == (0.6, 0.2, None, 12.5)


def test_all_streams_extract(spark):
    empty = messages(spark, [])
    out = telemetry.extract_telemetry(empty)
    assert len(out) == 13 and all(df.count() == 0 for df in out.values())
    assert telemetry.stream_catalogue(spark).count() == 13


def test_rate_needs_a_span(spark):
    one = stream(spark, [(5.0, 1.0)])
    assert timealign.stream_summary(one, ["clip"]).first()["rate_hz"] is None


def test_messages_stay_where_they_are(spark):
    """Choosing a topic never moves messages, also where no table is small enough for Spark's own broadcast."""
    rows = [(c, t, f"{c}{t}", i, '{"altitude": 1}') for i, (c, t) in enumerate([("a", "/sensor/dvl_velocity"), ("a", "/nucleus1000dvl/bottomtrack"), ("b", "/nucleus1000dvl/bottomtrack"), (None, "/sensor/dvl_velocity"), ("a", "/bluerov2/battery"), (None, "/bluerov2/battery")])]
    m = spark.createDataFrame(rows, "clip string, topic string, msgtype string, ts_ns bigint, payload string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, want in (("dvl", [("a", "/sensor/dvl_velocity"), ("b", "/nucleus1000dvl/bottomtrack")]), ("battery", [("a", "/bluerov2/battery")])):
            out = telemetry.extract_stream(m, name)
            assert "hashpartitioning" not in out._jdf.queryExecution().executedPlan().toString()
            assert sorted((r["clip"], r["source_topic"]) for r in out.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
