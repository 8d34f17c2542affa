"""The tracker against a frame-by-frame model, and the streaming form against the batch form."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sweepframe.operators import tracking
from sweepframe.operators.tracking import Confirmation
from sweepframe.streaming import confirm

FRAME = "clip string, frame_idx bigint"
BOX = "clip string, frame_idx bigint, box_id bigint, x1 double, y1 double, x2 double, y2 double, score double"


def model(frames, boxes, rule):
    """Straight walk over every frame of every clip, kept apart from the library on purpose."""
    def overlap(a, b):
        w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        i = max(0, w) * max(0, h)
        u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
        return i / u if u > 0 else 0.0

    out = {}
    for clip in {f[0] for f in frames}:
        live, nxt = [], 0
        for idx in sorted(f[1] for f in frames if f[0] == clip):
            dets = sorted([b for b in boxes if b[0] == clip and b[1] == idx and b[7] >= rule.conf], key=lambda b: b[2])
            open_ = list(range(len(dets)))
            for t in live:
                best, pick = rule.iou_match, None
                for j in open_:
                    v = overlap(t["box"], dets[j][3:7])
                    if v >= best:
                        best, pick = v, j
                if pick is None:
                    t["miss"] += 1
                else:
                    t.update(box=dets[pick][3:7], hits=t["hits"] + 1, miss=0)
                    out[(clip, idx, dets[pick][2])] = (t["id"], t["hits"])
                    open_.remove(pick)
            for j in open_:
                live.append({"id": nxt, "box": dets[j][3:7], "hits": 1, "miss": 0})
                out[(clip, idx, dets[j][2])] = (nxt, 1)
                nxt += 1
            live = [t for t in live if t["miss"] <= rule.max_age]
    return out


def scenario(seed):
    rnd = random.Random(seed)
    frames, boxes = [], []
    for clip in ("a", "b", "hot"):
        for idx in range(120 if clip == "hot" else 25):
            frames.append((clip, idx))
            quiet = rnd.random() < 0.35
            for j in range(0 if quiet else rnd.randrange(0, 4)):
                x, y = rnd.randrange(0, 30), rnd.randrange(0, 30)
                boxes.append((clip, idx, j, float(x), float(y), float(x + rnd.randrange(10, 30)), float(y + rnd.randrange(10, 30)), rnd.randrange(0, 5) / 4))
    return frames, boxes


@pytest.mark.parametrize("seed,rule", [(1, Confirmation()), (2, Confirmation(0.3, 2, 0, 0.5)), (3, Confirmation(0.1, 1, 1, 0.25))])
@pytest.mark.parametrize("limit", ["1000000", "15"])
def test_same_tracks_as_the_model(spark, seed, rule, limit):
    frames, boxes = scenario(seed)
    spark.conf.set("spark.sweepframe.groupRows", limit)
    try:
        out = tracking.assign_tracks(spark.createDataFrame(frames, FRAME), spark.createDataFrame(boxes, BOX), rule=rule).collect()
    finally:
        spark.conf.unset("spark.sweepframe.groupRows")
    got = {(r["clip"], r["frame_idx"], r["box_id"]): (r["track_id"], r["hits"]) for r in out}
    assert got == model(frames, boxes, rule)
    assert all(r["confirmed"] == (r["hits"] >= rule.min_hits) for r in out)


def moving(n, score=0.9):
    return [("c", i, 0, float(i), 0.0, 20.0 + i, 20.0, score) for i in range(n)]


def visible(spark, frames, boxes, rule=Confirmation()):
    t = tracking.assign_tracks(spark.createDataFrame(frames, FRAME), spark.createDataFrame(boxes, BOX), rule=rule)
    return sorted(r["frame_idx"] for r in t.where("confirmed").collect())


def test_confirmed_from_the_third_frame(spark):
    assert visible(spark, [("c", i) for i in range(5)], moving(5)) == [2, 3, 4]


def test_blip_never_confirms(spark):
    assert visible(spark, [("c", i) for i in range(4)], moving(1), Confirmation(max_age=1)) == []


def test_score_gate(spark):
    boxes = [("c", 0, 0, 0.0, 0.0, 20.0, 20.0, 0.4), ("c", 1, 0, 0.0, 0.0, 20.0, 20.0, 0.9)]
    assert visible(spark, [("c", 0), ("c", 1)], boxes, Confirmation(min_hits=1, conf=0.5)) == [1]


def test_empty_frames_age_tracks(spark):
    boxes = [b for b in moving(9) if b[1] in (0, 1, 5, 6, 7)]
    assert visible(spark, [("c", i) for i in range(9)], boxes) == [7], "three empty frames end the first track"
    assert visible(spark, [("c", i) for i in (0, 1, 5, 6, 7)], boxes) == [5, 6, 7]


def test_one_alert_per_track_and_heartbeats(spark):
    frames = spark.createDataFrame([("c", i) for i in range(10)], FRAME)
    assigned = tracking.assign_tracks(frames, spark.createDataFrame(moving(10), BOX))
    alerts = tracking.first_alerts(assigned)
    assert [(r["track_id"], r["frame_idx"]) for r in alerts.collect()] == [(0, 2)]
    beats = tracking.heartbeats(frames, alerts, 5).orderBy("frames").collect()
    assert [(r["frame_idx"], r["frames"], r["alerts"]) for r in beats] == [(4, 5, 1), (9, 10, 1)]


def test_stream_equals_batch(spark, tmp_path):
    frames, boxes = scenario(7)
    rule = Confirmation()
    landed = tmp_path / "in"
    landed.mkdir()
    by = {}
    for b in boxes:
        by.setdefault((b[0], b[1]), []).append(dict(zip(("box_id", "x1", "y1", "x2", "y2", "score"), b[2:])))
    for part, (lo, hi) in enumerate(((0, 40), (40, 80), (80, 200))):
        with open(landed / f"{part}.json", "w") as fh:
            for clip, idx in frames:
                if lo <= idx < hi:
                    fh.write(json.dumps({"clip": clip, "frame_idx": idx, "ts": f"2024-01-01T00:{idx // 60:02d}:{idx % 60:02d}Z", "boxes": by.get((clip, idx), [])}) + "\n")
        os.utime(landed / f"{part}.json", (1000 + part, 1000 + part))
    source = spark.readStream.schema(confirm.FRAMES).option("maxFilesPerTrigger", 1).json(str(landed))
    q = confirm.write_alerts(confirm.alert_stream(source, rule, heartbeat=20), str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination()
    out = spark.read.schema(confirm.OUTPUT).json(str(tmp_path / "out"))
    fr = spark.createDataFrame(frames, FRAME)
    alerts = tracking.first_alerts(tracking.assign_tracks(fr, spark.createDataFrame(boxes, BOX), rule=rule))
    key = lambda df: {(r["clip"], r["frame_idx"], r["track_id"], r["box_id"]) for r in df.collect()}
    assert key(out.where("event = 'damage_confirmed'")) == key(alerts) and alerts.count() > 5
    beats = {(r["clip"], r["frame_idx"], r["frames"], r["alerts"]) for r in out.where("event = 'heartbeat'").collect()}
    assert beats == {tuple(r) for r in tracking.heartbeats(fr, alerts, 20).select("clip", "frame_idx", "frames", "alerts").collect()}
    assert out.where("event = 'late_frame'").count() == 0


def test_late_frames_are_reported_not_tracked(spark, tmp_path):
    landed = tmp_path / "in"
    landed.mkdir()
    box = {"box_id": 0, "x1": 0.0, "y1": 0.0, "x2": 9.0, "y2": 9.0, "score": 0.9}
    for part, ids in enumerate(([5, 6], [4, 7])):
        (landed / f"{part}.json").write_text("\n".join(json.dumps({"clip": "c", "frame_idx": i, "ts": "2024-01-01T00:00:00Z", "boxes": [box]}) for i in ids))
        os.utime(landed / f"{part}.json", (1000 + part, 1000 + part))
    source = spark.readStream.schema(confirm.FRAMES).option("maxFilesPerTrigger", 1).json(str(landed))
    confirm.write_alerts(confirm.alert_stream(source, Confirmation(), 0), str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True).awaitTermination()
    got = {(r["event"], r["frame_idx"]) for r in spark.read.schema(confirm.OUTPUT).json(str(tmp_path / "out")).select("event", "frame_idx").collect()}
    assert got == {("late_frame", 4), ("damage_confirmed", 7)}


def land_parts(landed, parts):
    landed.mkdir()
    for i, rows in enumerate(parts):
        (landed / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        os.utime(landed / f"{i}.json", (1000 + i, 1000 + i))


def second(i):
    return f"2024-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z"


def test_runs_end_and_free_their_state(spark, tmp_path):
    """Frames shuffled within the delay and over triggers: the events of the batch form, a summary per run, state of quiet clips gone."""
    frames, boxes = scenario(7)
    by, rng = {}, random.Random(1)
    for b in boxes:
        by.setdefault((b[0], b[1]), []).append(dict(zip(("box_id", "x1", "y1", "x2", "y2", "score"), b[2:])))
    rows = [{"clip": c, "frame_idx": i, "ts": second(i), "latency_ms": 10.0 + i % 5, "boxes": by.get((c, i), [])} for c, i in frames]
    rows.sort(key=lambda r: r["frame_idx"] + rng.uniform(0, 15))
    parts = [rows[k:k + len(rows) // 6 + 1] for k in range(0, len(rows), len(rows) // 6 + 1)]
    ends = [[{"clip": "other", "frame_idx": k, "ts": second(3000 + 600 * k), "boxes": []}] for k in range(2)]
    land_parts(tmp_path / "in", parts + ends)
    source = spark.readStream.schema(confirm.FRAMES + ", latency_ms DOUBLE").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    events = confirm.alert_stream(source, heartbeat=20, delay="30 seconds", grace="10 seconds", quiet="5 minutes")
    q = confirm.write_alerts(events, str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination()
    out = spark.read.schema(confirm.OUTPUT).json(str(tmp_path / "out")).where("clip <> 'other'")
    fr = spark.createDataFrame([(r["clip"], r["frame_idx"], r["latency_ms"]) for r in rows], FRAME + ", latency_ms double")
    bx = spark.createDataFrame(boxes, BOX)
    alerts = tracking.first_alerts(tracking.assign_tracks(fr, bx))
    key = lambda df: sorted((r["clip"], r["frame_idx"], r["track_id"], r["box_id"]) for r in df.collect())
    assert key(out.where("event = 'damage_confirmed'")) == key(alerts) and alerts.count() > 5
    beats = sorted((r["clip"], r["frame_idx"], r["frames"], r["alerts"]) for r in out.where("event = 'heartbeat'").collect())
    assert beats == sorted(tuple(r) for r in tracking.heartbeats(fr, alerts, 20).select("clip", "frame_idx", "frames", "alerts").collect())
    assert out.where("event = 'late_frame'").count() == 0
    told = ["clip", "frames", "raw_detections", F.col("alerts").alias("confirmed_alerts"), "mean_latency_ms", "throughput_fps"]
    summary = tracking.run_summary(fr, bx, alerts, "latency_ms").select("clip", "frames", "raw_detections", "confirmed_alerts", "mean_latency_ms", "throughput_fps")
    assert sorted(map(tuple, out.where("event = 'run_summary'").select(*told).collect())) == sorted(map(tuple, summary.collect()))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1  # only the clip that is still on


def test_late_frames_within_grace_are_reported_and_later_ones_counted(spark, tmp_path):
    box = {"box_id": 0, "x1": 0.0, "y1": 0.0, "x2": 9.0, "y2": 9.0, "score": 0.9}
    row = lambda i, clip="c": {"clip": clip, "frame_idx": i, "ts": second(i), "boxes": [box]}
    land_parts(tmp_path / "in", [[row(100), row(102), row(101)], [row(130)], [row(99)], [row(103), row(140)], [row(10)], [row(4000, "z")], [row(8000, "z")]])
    source = spark.readStream.schema(confirm.FRAMES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    events = confirm.alert_stream(source, heartbeat=0, delay="10 seconds", grace="60 seconds", quiet="5 minutes")
    q = confirm.write_alerts(events, str(tmp_path / "out"), str(tmp_path / "ck"), availableNow=True)
    q.awaitTermination()
    got = sorted((r["event"], r["frame_idx"], r["frames"]) for r in spark.read.schema(confirm.OUTPUT).json(str(tmp_path / "out")).where("clip = 'c'").collect())
    assert got == [("damage_confirmed", 102, 3), ("late_frame", 99, 3), ("run_summary", 140, 6)]
    assert sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) == 1


def test_the_buffer_has_a_bound():
    run = confirm.Run("c", json.loads(json.dumps(confirm._FRESH)), Confirmation(), 0)
    for i in (5, 4, 3, 9, 8, 1):
        run.admit((i, i, "[]", None), 3)
    assert [w[0] for w in sorted(run.s["waiting"])] == [5, 8, 9] and run.s["frames"] == 2
    assert [e["frame_idx"] for e in run.events] == [1]


def test_latest_per_trigger(spark):
    e = spark.createDataFrame([("s", 1, "a"), ("s", 3, "c"), ("s", 2, "b")], "session string, ts int, f string")
    (r,) = tracking.latest_per_trigger(e, ["session"], "ts").collect()
    assert (r["f"], r["dropped"]) == ("c", 2)


def test_run_summary(spark):
    frames = spark.createDataFrame([("c", i, 20.0) for i in range(4)], FRAME + ", latency_ms double")
    boxes = spark.createDataFrame(moving(4), BOX)
    alerts = tracking.first_alerts(tracking.assign_tracks(frames, boxes))
    r = tracking.run_summary(frames, boxes, alerts, "latency_ms").first()
    assert (r["frames"], r["raw_detections"], r["confirmed_alerts"], r["mean_latency_ms"], r["throughput_fps"]) == (4, 4, 1, 20.0, 50.0)


def test_tasks_follow_the_number_of_frames(spark, monkeypatch):
    """More frames are more tasks, not larger ones; boxes of frames that are not listed count for nothing."""
    monkeypatch.setattr(tracking, "FRAMES_PER_TASK", 5)
    frames = spark.createDataFrame([("c", i) for i in range(60)], FRAME)
    seen = [("c", i, i, 0.0, 0.0, 10.0, 10.0, 0.9) for i in range(60)]
    got = tracking.assign_tracks(frames, spark.createDataFrame([*seen, ("c", 99, 99, 0.0, 0.0, 10.0, 10.0, 0.9)], BOX))
    assert [tuple(r) for r in got.select("frame_idx", "track_id", "hits").orderBy("frame_idx").collect()] == [(i, 0, i + 1) for i in range(60)]
    dealt = got._jdf.queryExecution().optimizedPlan().toString()
    assert ", 12" in dealt and "RepartitionByExpression" in dealt
