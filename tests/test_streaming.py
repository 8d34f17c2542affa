import json

from pyspark.sql import functions as F

from sweepframe.streaming import sessions


def land(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in records))


def at(seconds):
    return f"2024-01-01T00:{int(seconds) // 60:02d}:{seconds % 60:06.3f}Z"


def test_session_status(spark, tmp_path):
    land(tmp_path / "in", "a.json", [
        {"session": "s", "ts": at(i), "inferred": i % 2 == 0, "latency_ms": 30.0 + i, "confirmed": i} for i in range(5)])
    source = spark.readStream.schema("session STRING, ts TIMESTAMP, inferred BOOLEAN, latency_ms DOUBLE, confirmed INT").json(str(tmp_path / "in"))
    q = sessions.session_status(source).writeStream.format("memory").queryName("status").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    (r,) = spark.table("status").collect()
    assert (r["captured"], r["inferred"], r["dropped"], r["latency_ms"], r["confirmed_now"], r["capture_fps"]) == (5, 3, 2, 34.0, 4, 1.25)


def test_newest_frame_goes_on(spark, tmp_path):
    land(tmp_path / "in", "a.json", [{"session": "s", "ts": at(i), "f": i} for i in range(3)])
    source = spark.readStream.schema("session STRING, ts TIMESTAMP, f INT").json(str(tmp_path / "in"))
    sessions.newest_frames(source, str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination()
    (r,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert (r["f"], r["dropped"]) == (2, 2)


def test_streams_align(spark, tmp_path):
    land(tmp_path / "f", "a.json", [{"clip": "c", "frame": f"f{i}", "ts": at(10.0 + i)} for i in range(3)])
    land(tmp_path / "f", "z.json", [{"clip": "c", "frame": "end", "ts": at(300.0)}])
    land(tmp_path / "s", "a.json", [
        {"clip": "c", "ts": at(10.2), "value": 1.0}, {"clip": "c", "ts": at(9.9), "value": 2.0}, {"clip": "c", "ts": at(11.25), "value": 4.0},
        {"clip": "c", "ts": at(10.75), "value": 3.0}, {"clip": "c", "ts": at(14.0), "value": 9.0}])
    land(tmp_path / "s", "z.json", [{"clip": "c", "ts": at(300.0), "value": 0.0}])
    read = lambda p, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).json(str(p))
    out = sessions.align_streams(read(tmp_path / "f", "clip STRING, frame STRING, ts TIMESTAMP"), read(tmp_path / "s", "clip STRING, ts TIMESTAMP, value DOUBLE"))
    q = out.writeStream.format("memory").queryName("aligned").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["frame"]: r["value"] for r in spark.table("aligned").collect()}
    assert got == {"f0": 2.0, "f1": 3.0, "f2": None}


def test_request_rates(spark, tmp_path):
    land(tmp_path / "in", "a.json", [{"ts": at(i * 40.0), "path": "/p", "error": i == 0, "latency_ms": 10.0} for i in range(6)])
    source = spark.readStream.schema("ts TIMESTAMP, path STRING, error BOOLEAN, latency_ms DOUBLE").json(str(tmp_path / "in"))
    q = sessions.request_rates(source).writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    per = spark.table("rates").orderBy("window").select("requests", "errors").collect()
    assert [tuple(r) for r in per] == [(2, 1), (1, 0), (2, 0), (1, 0)]
    assert spark.table("rates").select(F.sum("requests")).first()[0] == 6
