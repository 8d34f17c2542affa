"""Temporal confirmation: boxes followed from frame to frame, one alert per confirmed track."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import group_limit, group_sizes, ordered_columns, pin
from .ranking import carry_forward


#: Frames that a task of the tracker is dealt on average, at most.
FRAMES_PER_TASK = 250_000


@dataclass(frozen=True)
class Confirmation:
    """Fixed values of the tracker: association IoU, hits to confirm, frames survived unseen, score gate."""

    iou_match: float = 0.2
    min_hits: int = 3
    max_age: int = 2
    conf: float = 0.25


def _iou(a: Sequence[float], b: Sequence[float]) -> float:
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    inter = max(0.0, w) * max(0.0, h)
    union = max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1]) + max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def advance(tracks: list[dict], boxes: list[tuple], idle: int, born: int, rule: Confirmation):
    """One frame: returns ``(live tracks, tracks born so far, [(box, track no, hits, is new)])``.

    ``idle`` empty frames lie before this one. Tracks choose in the order they were opened,
    the later box at equal IoU; unchosen boxes open tracks.
    """
    live = [t for t in tracks if t["misses"] + idle <= rule.max_age]
    free = list(range(len(boxes)))
    out = []
    for t in live:
        scored = [(_iou(t["box"], boxes[j]), j) for j in free]
        best = max((s for s in scored if s[0] >= rule.iou_match), default=None)
        if best is None:
            t["misses"] += idle + 1
            continue
        free.remove(best[1])
        t["box"], t["misses"], t["hits"] = boxes[best[1]], 0, t["hits"] + 1
        out.append((best[1], t["no"], t["hits"], False))
    for j in free:
        live.append({"no": born, "box": boxes[j], "hits": 1, "misses": 0})
        out.append((j, born, 1, True))
        born += 1
    return [t for t in live if t["misses"] <= rule.max_age], born, out


def assign_tracks(
    frames: DataFrame, boxes: DataFrame, *, clip: str = "clip", order: str = "frame_idx", rule: Confirmation = Confirmation()
) -> DataFrame:
    """Every gated box with its track: ``clip, order, box_id, track_id, hits, is_new, confirmed``.

    ``frames`` lists every frame once, also empty ones, which age tracks; ``boxes`` has
    ``box_id, x1, y1, x2, y2, score``. After ``max_age + 1`` frames without a gated box no
    track is alive, so the clip is cut there and the pieces are followed independently, each
    as a stream of rows through one task with only the live tracks in memory. Track numbers
    count up per clip in the order tracks were opened.
    """
    gated = boxes.where(F.col("score") >= rule.conf).select(clip, order, "box_id", "x1", "y1", "x2", "y2")
    sizes = group_sizes(frames, [clip])
    spark = frames.sparkSession
    # Tasks by the number of frames, so that what one holds does not grow with the table.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(sizes[1] / FRAMES_PER_TASK))
    either = frames.select(clip, order, F.lit(1).alias("_listed"), F.lit(None).cast("int").alias("_busy")).unionByName(
        gated.select(clip, order, F.lit(None).cast("int").alias("_listed"), F.lit(1).alias("_busy")))
    if sizes[0] <= group_limit(spark):  # dealt by clip once, for this and the windows
        either = either.repartition(parts, clip)
    timeline = either.groupBy(clip, order).agg(F.max("_listed").alias("_listed"), F.max("_busy").alias("_busy")).where(
        F.col("_listed").isNotNull()).drop("_listed")
    counted = ordered_columns(
        timeline, [clip], [order], sums={"_empty": F.when(F.col("_busy").isNull(), 1).otherwise(0)}, sizes=sizes)
    active = ordered_columns(
        counted.where(F.col("_busy").isNotNull()), [clip], [order], lags={"_before": F.col("_empty")}, sizes=sizes)
    idle = F.col("_empty") - F.col("_before")
    active = active.withColumns({
        "idle": F.coalesce(idle, F.lit(0)).cast("int"),
        "_cut": F.when(idle.isNull() | (idle > rule.max_age), 1).otherwise(0),
    })
    pieces = ordered_columns(active, [clip], [order], sums={"piece": F.col("_cut")}, sizes=sizes).select(
        clip, order, "piece", "idle")
    # A fixed number of partitions: the rows are few bytes but much work, so they must not be merged.
    rows = gated.join(pieces, [clip, order]).repartition(parts, clip, "piece").sortWithinPartitions(clip, "piece", order, "box_id")

    kinds = dict(rows.dtypes)
    shape = (
        f"{clip} {kinds[clip]}, piece {kinds['piece']}, {order} {kinds[order]}, box_id {kinds['box_id']}, "
        "track_no bigint, hits bigint, is_new boolean"
    )

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tracks, born, pending = None, [], 0, []

        def close(done):
            nonlocal tracks, born
            if not done:
                return
            found = [tuple(r[5:9]) for r in done]
            tracks, born, hit = advance(tracks, found, int(done[0][3]), born, rule)
            for j, no, hits, new in sorted(hit):
                out.append((done[j][0], done[j][1], done[j][2], done[j][4], no, hits, new))

        names = [clip, "piece", order, "idle", "box_id", "x1", "y1", "x2", "y2"]
        for batch in batches:
            out = []
            for row in batch[names].itertuples(index=False, name=None):
                if pending and row[:3] != pending[0][:3]:
                    close(pending)
                    pending = []
                if row[:2] != key:
                    key, tracks, born = row[:2], [], 0
                pending.append(row)
            yield pd.DataFrame(out, columns=[clip, "piece", order, "box_id", "track_no", "hits", "is_new"])
        out = []
        close(pending)
        yield pd.DataFrame(out, columns=[clip, "piece", order, "box_id", "track_no", "hits", "is_new"])

    followed = rows.select(clip, "piece", order, "idle", "box_id", "x1", "y1", "x2", "y2").mapInPandas(follow, shape)
    followed = pin(followed)  # read by the numbering of tracks and by the result
    born_at = followed.where("is_new").select(clip, "piece", "track_no")
    births = ordered_columns(
        born_at.repartition(parts, clip) if sizes[0] <= group_limit(spark) else born_at, [clip], ["piece", "track_no"], sums={"_nth": F.lit(1)}
    ).select(clip, "piece", "track_no", (F.col("_nth") - 1).alias("track_id"))
    return followed.repartition(parts, clip, "piece", "track_no").join(births, [clip, "piece", "track_no"]).select(
        clip, order, "box_id", "track_id", "hits", "is_new", (F.col("hits") >= rule.min_hits).alias("confirmed")
    )


def confirmed_boxes(assigned: DataFrame, boxes: DataFrame, clip: str = "clip", order: str = "frame_idx") -> DataFrame:
    """The boxes shown after confirmation, frame by frame."""
    return boxes.join(assigned.where("confirmed").select(clip, order, "box_id", "track_id", "hits"), [clip, order, "box_id"])


def first_alerts(assigned: DataFrame, clip: str = "clip", order: str = "frame_idx") -> DataFrame:
    """One row per track, at the frame where it was first confirmed."""
    return assigned.where("confirmed").groupBy(clip, "track_id").agg(
        F.min_by(F.struct(order, "box_id", "hits"), F.col(order)).alias("_a")
    ).select(clip, "track_id", "_a.*")


def heartbeats(frames: DataFrame, alerts: DataFrame, every: int, clip: str = "clip", order: str = "frame_idx") -> DataFrame:
    """Frames seen and alerts raised so far, at every ``every``-th frame of a clip."""
    raised = alerts.groupBy(clip, order).agg(F.count(F.lit(1)).alias("_raised"))
    rows = frames.select(clip, order).join(raised, [clip, order], "left")
    counted = ordered_columns(
        rows, [clip], [order], sums={"frames": F.lit(1), "alerts": F.coalesce("_raised", F.lit(0))}
    )
    return counted.where(F.col("frames") % every == 0).select(clip, order, "frames", "alerts")


def run_summary(frames: DataFrame, boxes: DataFrame, alerts: DataFrame, latency_ms: str, clip: str = "clip") -> DataFrame:
    """Frames, raw detections, alerts, mean latency and throughput of every run."""
    raw = boxes.groupBy(clip).agg(F.count(F.lit(1)).alias("raw_detections"))
    told = alerts.groupBy(clip).agg(F.count(F.lit(1)).alias("confirmed_alerts"))
    per = frames.groupBy(clip).agg(
        F.count(F.lit(1)).alias("frames"), F.round(F.avg(latency_ms), 2).alias("mean_latency_ms"),
        F.round(F.try_divide(F.count(F.lit(1)) * 1000.0, F.sum(latency_ms)), 2).alias("throughput_fps"),
    )
    return per.join(raw, clip, "left").join(told, clip, "left").fillna(0, ["raw_detections", "confirmed_alerts"])


def ood_every_nth(frames: DataFrame, score: str, threshold: float, every: int, clip: str = "clip", order: str = "frame_idx") -> DataFrame:
    """Score checked on every ``every``-th frame only, its verdict carried to the frames between."""
    numbered = ordered_columns(frames, [clip], [order], sums={"_n": F.lit(1)})
    checked = F.pmod(F.col("_n") - 1, F.lit(every)) == 0
    seen = numbered.withColumn("_seen", F.when(checked, F.col(score)))
    held = carry_forward(seen, [clip], [order], "_seen", "ood_score")
    return held.withColumn("ood", F.col("ood_score") >= threshold).drop("_n", "_seen")


def alert_positions(alerts: DataFrame, positions: DataFrame, clip: str = "clip", order: str = "frame_idx") -> DataFrame:
    """Alerts with the along-track position of their frame; NULL when odometry was off."""
    return alerts.join(positions.select(clip, order, F.round("travelled_m", 3).alias("along_m")), [clip, order], "left")


def latest_per_trigger(events: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Newest row of every slot and how many older ones it superseded."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(time)).alias("_last"), (F.count(F.lit(1)) - 1).alias("dropped")
    ).select(*keys, "_last.*", "dropped")
