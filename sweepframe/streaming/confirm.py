"""Temporal confirmation on a stream of frames, with alerts, heartbeats, late frames and run summaries."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracking import Confirmation, advance

FRAMES = "clip STRING, frame_idx BIGINT, ts TIMESTAMP, boxes ARRAY<STRUCT<box_id: BIGINT, x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE, score: DOUBLE>>"
OUTPUT = (
    "event STRING, clip STRING, frame_idx BIGINT, track_id BIGINT, box_id BIGINT, score DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, "
    "frames BIGINT, alerts BIGINT, raw_detections BIGINT, mean_latency_ms DOUBLE, throughput_fps DOUBLE"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
#: Most frames of a clip that wait for their turn.
BUFFER = 10_000
_FRESH = {"tracks": [], "born": 0, "last": None, "frames": 0, "alerts": 0, "raw": 0, "latency": 0.0, "timed": 0, "newest": None, "waiting": []}


class Run:
    """One clip's run: what its state holds, and the events that frames give."""

    def __init__(self, clip: str, state: dict, rule: Confirmation, heartbeat: int):
        self.clip, self.s, self.rule, self.heartbeat, self.events = clip, state, rule, heartbeat, []

    def tell(self, event: str, **values) -> None:
        self.events.append({"event": event, "clip": self.clip, "frames": self.s["frames"], "alerts": self.s["alerts"], **values})

    def admit(self, frame: tuple, most: int) -> None:
        """Take a frame into the buffer; a frame at or before the last one followed is late."""
        s = self.s
        if s["last"] is not None and frame[0] <= s["last"]:
            self.tell("late_frame", frame_idx=frame[0])
            return
        s["newest"] = frame[1] if s["newest"] is None else max(s["newest"], frame[1])
        heapq.heappush(s["waiting"], frame)
        if len(s["waiting"]) > most:
            self.follow(heapq.heappop(s["waiting"]))

    def release(self, until: float) -> None:
        """Follow the waiting frames in frame order, as far as their time has come."""
        while self.s["waiting"] and self.s["waiting"][0][1] <= until:
            self.follow(heapq.heappop(self.s["waiting"]))

    def follow(self, frame: tuple) -> None:
        idx, _, text, latency = frame
        s, rule = self.s, self.rule
        if s["last"] is not None and idx <= s["last"]:  # the same frame again
            self.tell("late_frame", frame_idx=idx)
            return
        given = json.loads(text or "[]")
        seen = sorted((b for b in given if b["score"] >= rule.conf), key=lambda b: b["box_id"])
        s["tracks"], s["born"], hits = advance(s["tracks"], [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in seen], 0, s["born"], rule)
        s["last"], s["frames"], s["raw"] = idx, s["frames"] + 1, s["raw"] + len(given)
        if latency is not None:
            s["latency"], s["timed"] = s["latency"] + latency, s["timed"] + 1
        for j, no, n, _ in sorted(hits, key=lambda h: h[1]):
            if n == rule.min_hits:
                s["alerts"] += 1
                self.tell("damage_confirmed", frame_idx=idx, track_id=no, **{c: seen[j][c] for c in ("box_id", "score", "x1", "y1", "x2", "y2")})
        if self.heartbeat and s["frames"] % self.heartbeat == 0:
            self.tell("heartbeat", frame_idx=idx)

    def close(self) -> None:
        """The run is over: its summary, once."""
        s = self.s
        self.release(float("inf"))
        self.tell("run_summary", frame_idx=s["last"], raw_detections=s["raw"], mean_latency_ms=round(s["latency"] / s["timed"], 2) if s["timed"] else None,
                  throughput_fps=round(s["frames"] * 1000.0 / s["latency"], 2) if s["latency"] > 0 else None)

    def table(self) -> pd.DataFrame:
        table = pd.DataFrame(self.events, columns=COLUMNS)
        for c in ("frame_idx", "track_id", "box_id", "frames", "alerts", "raw_detections"):
            table[c] = table[c].astype("Int64")
        return table


def alert_stream(
    frames: DataFrame, rule: Confirmation = Confirmation(), heartbeat: int = 50, *,
    delay: str | None = None, grace: str = "1 minute", quiet: str = "5 minutes", buffer: int = BUFFER,
) -> DataFrame:
    """Events of a frame stream: ``damage_confirmed`` once per track, ``heartbeat``, ``late_frame``, ``run_summary``.

    One row per frame, empty frames included; a column ``latency_ms`` is taken into the summary. State
    is the live tracks, some counters and the waiting frames. A track confirms in the frame where its
    hits reach ``min_hits``, so no list of alerted tracks is kept.

    Without ``delay``, frames of a trigger are taken in frame order and all are followed at its end; a
    run has no end. With ``delay``, time is event time:

    * a frame waits until the newest frame of the stream is ``delay`` ahead, so order within that time
      does not matter, nor how frames are spread over triggers;
    * one that comes later, at or before the last followed frame, is reported as late and never fed back,
      for another ``grace``; after that Spark drops it and counts it (``numRowsDroppedByWatermark``);
    * a timer ends the run once the watermark is ``quiet`` past its newest frame: the waiting frames are
      followed, one ``run_summary`` is told and the state is freed. Frames after that are a new run.

    At most ``buffer`` frames of a clip wait; beyond it the first of them is followed before its time.
    """
    span = lambda text: int(pd.Timedelta(text).total_seconds() * 1000)
    timed = delay is not None
    late, silent = span(grace), span(quiet)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run = Run(key[0], json.loads(state.get[0]) if state.exists else json.loads(json.dumps(_FRESH)), rule, heartbeat)
        run.s["waiting"] = [tuple(w) for w in run.s["waiting"]]
        mark = state.getCurrentWatermarkMs() if timed else 0
        if timed:  # what was due before these frames came
            run.release(mark + late)
        for batch in batches if not state.hasTimedOut else ():
            for idx, at, boxes, latency in zip(batch["frame_idx"], batch["at"], batch["boxes"], batch["latency"]):
                run.admit((int(idx), int(at), boxes, None if pd.isna(latency) else float(latency)), buffer)
        if not timed:
            run.release(float("inf"))
        else:
            run.release(mark + late)
            newest = run.s["newest"]
            if newest is None or mark >= newest + silent:
                if newest is not None:
                    run.close()
                if state.exists:
                    state.remove()
                yield run.table()
                return
            due = min([newest + silent, *[w[1] - late for w in run.s["waiting"][:1]]])
            state.setTimeoutTimestamp(max(due, mark + 1))
        state.update((json.dumps(run.s),))
        yield run.table()

    latency = F.col("latency_ms").cast("double") if "latency_ms" in frames.columns else F.lit(None).cast("double")
    if timed:
        frames = frames.withWatermark("ts", f"{span(delay) + late} milliseconds")
    slim = frames.select("clip", "frame_idx", "ts", F.unix_millis("ts").alias("at"), F.to_json("boxes").alias("boxes"), latency.alias("latency"))
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return slim.groupBy("clip").applyInPandasWithState(step, OUTPUT, "state STRING", "append", timeout)


def write_alerts(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Events into a JSON-lines folder; a restart continues from the checkpoint."""
    return (
        events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start()
    )
