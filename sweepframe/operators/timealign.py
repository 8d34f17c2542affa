"""Time alignment: frames get a time from an index, then the nearest sample of every stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import frame_clip, frame_index, stem
from ..plans import ordered_columns


def asof_nearest(
    left: DataFrame,
    streams: Mapping[str, DataFrame],
    *,
    by: Sequence[str],
    time: str,
    tolerance: float,
    tiebreak: str,
    drop: Sequence[str] = ("t_header", "source_topic"),
) -> DataFrame:
    """One row per left row, with every stream's nearest sample no further than ``tolerance``.

    Stream columns come back as ``<stream>_<column>`` next to ``<stream>_<time>``, the time of
    the match. At equal distance the earlier sample wins; among samples of one instant the
    one with the largest ``tiebreak`` when it lies at or before the row, the smallest when
    after. Left rows without a time or a match stay, with NULLs.

    All streams and the left rows are ordered together, so the whole chain costs one shuffle
    on ``by`` however many streams are joined.
    """
    by = list(by)
    used = {name: [c for c in df.columns if c not in (*by, *drop)] for name, df in streams.items()}
    ties = [f"_tie_{name}" for name in streams]
    places = [time, "_side", "_stream", *ties]

    def tall(df: DataFrame, side: int, number: int) -> DataFrame:
        payloads = [
            (F.col(tiebreak) if i == number else F.lit(None)).alias(tie) for i, tie in enumerate(ties)
        ]
        for i, name in enumerate(streams):
            shape = F.struct(*[F.col(c) for c in used[name]]) if i == number else F.lit(None)
            payloads.append(shape.alias(f"_s_{name}"))
        body = F.struct(*left.columns) if side == 1 else F.lit(None)
        return df.select(
            *by, time, F.lit(side).alias("_side"), F.lit(number).alias("_stream"),
            *payloads, body.alias("_left"),
        )

    rows = tall(left, 1, -1)
    for i, (name, df) in enumerate(streams.items()):
        rows = rows.unionByName(tall(df.where(F.col(time).isNotNull()), 0, i))
    seen = {name: F.when(F.col("_stream") == i, F.col(f"_s_{name}")) for i, name in enumerate(streams)}
    placed = ordered_columns(
        rows, by, places,
        carries={f"_back_{n}": c for n, c in seen.items()},
        nexts={f"_next_{n}": c for n, c in seen.items()},
    ).where(F.col("_side") == 1)

    out = [F.col("_left")[c].alias(c) for c in left.columns]
    for name in streams:
        back, ahead = F.col(f"_back_{name}"), F.col(f"_next_{name}")
        to_back, to_ahead = F.col(time) - back[time], ahead[time] - F.col(time)
        nearest = F.when(to_back <= F.coalesce(to_ahead, to_back), back).otherwise(ahead)
        near = F.when(F.least(to_back, to_ahead) <= F.lit(tolerance), nearest)
        out += [near[c].alias(f"{name}_{c}") for c in used[name]]
    return placed.select(*out)


def index_times(index: DataFrame) -> DataFrame:
    """``clip, msg_index, t`` from index documents holding ``clip`` and ``times ARRAY<DOUBLE>``."""
    return index.select("clip", F.posexplode("times").alias("msg_index", "t")).withColumn(
        "msg_index", F.col("msg_index").cast("bigint")
    )


def frame_records(paths: DataFrame, times: DataFrame) -> DataFrame:
    """``frame, path, clip, msg_index, t`` for every path that follows the naming convention.

    A frame whose clip has no index, or whose number lies outside it, keeps ``t`` NULL. ``paths`` may
    have a ``msg_index``, the number a frame was written under, which counts instead of the one in its
    name: names of a fixed width lose the last digits of longer numbers.
    """
    name = stem(F.col("path"))
    number = F.coalesce("msg_index", frame_index(name)) if "msg_index" in paths.columns else frame_index(name)
    named = paths.select(
        F.substring_index("path", "/", -1).alias("frame"), "path",
        frame_clip(name).alias("clip"), number.alias("msg_index"),
    ).where(F.col("clip").isNotNull())
    return named.join(times.select("clip", "msg_index", "t"), ["clip", "msg_index"], "left").select(
        "frame", "path", "clip", "msg_index", "t"
    )


def join_frames(
    paths: DataFrame, times: DataFrame, streams: Mapping[str, DataFrame], tolerance: float = 0.5
) -> DataFrame:
    """Frame records with the nearest sample of every stream of the same clip, in clip order."""
    records = frame_records(paths, times)
    joined = asof_nearest(
        records, streams, by=["clip"], time="t", tolerance=tolerance, tiebreak="source_topic"
    )
    return joined.drop(*[f"{name}_t" for name in streams]).orderBy("clip", "msg_index", "frame")


def join_coverage(joined: DataFrame, match: str, keys: Sequence[str] = (), time: str = "t") -> DataFrame:
    """How many rows got a time, and how many a match; an empty table yields zero and NULL shares."""
    frames = F.count(F.lit(1))
    timed, matched = F.count(time), F.count(match)

    def share(part: Column) -> Column:
        return F.round(F.try_divide(part * 100.0, frames), 2)

    return joined.groupBy(*keys).agg(
        frames.alias("frames"), timed.alias("timestamped"), share(timed).alias("timestamped_pct"),
        matched.alias("matched"), share(matched).alias("matched_pct"),
    )


def stream_summary(samples: DataFrame, keys: Sequence[str], time: str = "t", source: str = "source_topic") -> DataFrame:
    """Rows, source, first and last time, duration and rate of every stream."""
    span = F.max(time) - F.min(time)
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by(source, time).alias("source_topic"),
        F.min(time).alias("t_start"), F.max(time).alias("t_end"),
        F.round(span, 3).alias("duration_s"),
        F.round(F.try_divide(F.count(F.lit(1)), span), 2).alias("rate_hz"),
    )


def frame_table(joined: DataFrame) -> DataFrame:
    """Derived capture conditions; a stream that was never recorded gives NULL columns."""

    def have(name: str) -> Column:
        return F.col(name) if name in joined.columns else F.lit(None).cast("double")

    return joined.withColumns({
        "day": F.substring("clip", 1, 10),
        "standoff": have("net_plane_net_distance"),
        "net_speed": F.hypot(have("net_plane_net_vel_u"), have("net_plane_net_vel_v")),
        "locked": F.coalesce(have("net_plane_net_lock") > 0.5, F.lit(False)),
        "depth": have("depth_temp_depth"),
        "temperature": have("depth_temp_temperature"),
    })


def usable_frames(frames: DataFrame) -> DataFrame:
    """Frames with a measured standoff under a locked estimate."""
    return frames.where(F.col("standoff").isNotNull() & F.col("locked"))
