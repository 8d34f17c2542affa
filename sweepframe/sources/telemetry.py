"""Canonical sensor streams from landed message tables.

A message row is ``clip, topic, msgtype, ts_ns, payload`` with the payload as JSON text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import mean_of, mean_positive, safe_double, stamp_seconds, vector_columns
from ..plans import pin

#: Clips whose choice of topic is sent to every task, a name and a topic each.
SENT_CLIPS = 1_000_000

# The sentinel of an absent thruster channel and the neutral pulse width.
ABSENT_CHANNEL = 65535.0
NEUTRAL_PWM = 1500.0
CHANNELS = 8

VEC3 = "STRUCT<x: STRING, y: STRING, z: STRING>"
HEADER = "header STRUCT<stamp: STRUCT<sec: STRING, nanosec: STRING>>"


@dataclass(frozen=True)
class Stream:
    """A canonical stream: topics in order of preference and the fields it carries.

    ``scalars`` maps output columns to message fields, ``vectors`` prefixes to vector fields,
    ``flags`` boolean fields kept as 1.0/0.0. ``special`` names extra array handling.
    """

    name: str
    topics: tuple[str, ...]
    scalars: dict[str, str] = field(default_factory=dict)
    vectors: dict[str, str] = field(default_factory=dict)
    flags: dict[str, str] = field(default_factory=dict)
    units: dict[str, str] = field(default_factory=dict)
    special: str | None = None


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


# Topics, message fields and units of the thirteen streams.
STREAMS: tuple[Stream, ...] = (
    Stream("net_plane", ("/navigation/plane_approximation",), {
        "net_distance": "NetDistance", "net_heading": "NetHeading", "net_pitch": "NetPitch", "net_lock": "NetLock",
        "net_vel_u": "NetVelocity_u", "net_vel_v": "NetVelocity_v", "net_vel_w": "NetVelocity_w", "dvl_altitude": "Altitude",
    }, units={
        "net_distance": "m", "net_heading": "rad", "net_pitch": "rad", "net_lock": "bool", "net_vel_u": "m/s",
        "net_vel_v": "m/s", "net_vel_w": "m/s", "dvl_altitude": "m",
    }, special="normal"),
    Stream("net_pose", ("/navigation/plane_approximation_position",), _same("x", "y", "z", "roll", "pitch", "yaw", "t_last_reset"),
           units={"x": "m", "y": "m", "z": "m", "roll": "deg", "pitch": "deg", "yaw": "deg"}),
    Stream("dvl", ("/sensor/dvl_velocity", "/nucleus1000dvl/bottomtrack"),
           units={"vel_x": "m/s", "vel_y": "m/s", "vel_z": "m/s", "altitude": "m", "fom": "m/s", "valid": "bool"}, special="dvl"),
    Stream("depth_temp", ("/sensor/depth_temperature",), _same("depth", "temperature", "pressure"),
           units={"depth": "m", "temperature": "degC", "pressure": "mbar"}),
    Stream("ins", ("/nucleus1000dvl/ins",), {
        "depth": "depth", "temperature": "temperature", "pressure_bar": "pressure", "speed_over_ground": "speedOverGround",
        "course_over_ground": "courseOverGround", "fom_ins": "fomIns", "fom_ahrs": "fomAhrs",
    }, {"pos": "positionFrame", "vel_ned": "velocityNed"}, units={
        "depth": "m", "temperature": "degC", "pressure_bar": "bar", "speed_over_ground": "m/s", "course_over_ground": "deg"}),
    Stream("attitude", ("/sensor/attitude",), _same("roll", "pitch", "yaw", "rollspeed", "pitchspeed", "yawspeed"), units={
        "roll": "rad", "pitch": "rad", "yaw": "rad", "rollspeed": "rad/s", "pitchspeed": "rad/s", "yawspeed": "rad/s"}),
    Stream("imu_counts", ("/sensor/imu",), _same(
        "acc_x", "acc_y", "acc_z", "gyro_x", "gyro_y", "gyro_z", "mag_x", "mag_y", "mag_z"),
        units={"acc_x": "counts", "gyro_x": "counts"}),
    Stream("imu_si", ("/nucleus1000dvl/imu",), vectors={"acc": "accelerometer", "gyro": "gyroscope"},
           units={"acc_x": "m/s2", "gyro_x": "rad/s"}),
    Stream("setpoint", ("/gui/netFollowing_manager",), _same(
        "d_depth", "d_net_distance", "d_net_velocity_horizontal", "d_net_velocity_vertical", "offset_net_heading"), units={
        "d_net_distance": "m", "d_net_velocity_horizontal": "m/s", "d_net_velocity_vertical": "m/s", "d_depth": "m",
        "offset_net_heading": "rad"}),
    Stream("guidance", ("/guidance",), _same(
        "error_x", "error_y", "error_z", "error_net_distance", "error_surge", "error_sway", "error_heave", "error_depth",
        "error_yaw", "desired_surge", "desired_sway", "desired_heave", "desired_yaw", "desired_net_distance", "gamma_p"), units={
        "error_net_distance": "m", "desired_net_distance": "m", "error_surge": "m/s", "error_sway": "m/s", "error_yaw": "deg"}),
    Stream("battery", ("/bluerov2/battery",), {
        "voltage_mv": "voltage", "current_battery": "current_battery", "current_consumed": "current_consumed"},
        units={"voltage_mv": "mV", "current_consumed": "mAh"}),
    Stream("usbl", ("/sensor/usbl",), _same("east", "north", "depth", "heading", "roll", "pitch", "sigma"),
           flags={"connected": "connected"}, units={"east": "m", "north": "m", "depth": "m", "heading": "deg", "sigma": "m"}),
    Stream("thrust", ("/commanded_thrust",), units={"thrust_0": "PWM us", "thrust_effort": "PWM us from neutral"}, special="thrust"),
)
BY_NAME = {s.name: s for s in STREAMS}


def stream_catalogue(spark: SparkSession) -> DataFrame:
    """``name, topics, units`` of every canonical stream."""
    return spark.createDataFrame(
        [(s.name, list(s.topics), s.units) for s in STREAMS], "name STRING, topics ARRAY<STRING>, units MAP<STRING, STRING>"
    )


def topic_counts(messages: DataFrame, topic: str = "topic", msgtype: str = "msgtype") -> DataFrame:
    return messages.groupBy(topic, msgtype).agg(F.count(F.lit(1)).alias("count")).orderBy(F.col("count").desc(), topic)


def preferred_topic(messages: DataFrame, topics: Sequence[str], by: Sequence[str] = ("clip",), topic: str = "topic") -> DataFrame:
    """Messages of the first topic in the preference list that a clip has, stamped in ``source_topic``.

    A single topic needs no choice. Otherwise which topic a clip has is a stored aggregate, a row per clip, sent to
    every task up to ``SENT_CLIPS`` of them, so that messages stay where they are; beyond, they are joined by shuffle.
    """
    if len(topics) == 1:
        known = messages.where(F.col(topic) == topics[0])
        for c in by:
            known = known.where(F.col(c).isNotNull())
        return known.withColumn("source_topic", F.col(topic))
    order = F.create_map(*[F.lit(v) for i, t in enumerate(topics) for v in (t, i)])
    known = messages.where(F.col(topic).isin(list(topics)))
    chosen = pin(known.groupBy(*by).agg(F.min_by(topic, order[F.col(topic)]).alias(topic)))
    if chosen.count() <= SENT_CLIPS:
        chosen = F.broadcast(chosen)
    return known.join(chosen, [*by, topic]).withColumn("source_topic", F.col(topic))


def thrust_columns(pwm: Column) -> list[Column]:
    """``thrust_0 … thrust_7`` with absent channels NULL, and mean effort over the present ones."""
    first = F.transform(F.slice(pwm, 1, CHANNELS), lambda v: v.try_cast("double"))
    numbers = F.transform(first, lambda v: F.nullif(v, F.lit(ABSENT_CHANNEL)))
    efforts = F.transform(F.filter(numbers, lambda v: v.isNotNull()), lambda v: F.abs(v - NEUTRAL_PWM))
    return [F.get(numbers, i).alias(f"thrust_{i}") for i in range(CHANNELS)] + [mean_of(efforts).alias("thrust_effort")]


def _flag(value: Column) -> Column:
    return F.when(F.lower(value).isin("true", "1", "1.0"), 1.0).otherwise(0.0)


def extract_stream(messages: DataFrame, name: str) -> DataFrame:
    """``clip, ts_ns, t, t_header, <fields>, source_topic`` of one canonical stream.

    Fields a message lacks, or that hold no number, are NULL. Clips without any of the
    topics contribute no row.
    """
    spec = BY_NAME[name]
    rows = preferred_topic(messages, spec.topics)
    parts = [HEADER, *[f"`{f}` STRING" for f in {*spec.scalars.values(), *spec.flags.values()}], *[f"`{f}` {VEC3}" for f in spec.vectors.values()]]
    if spec.special == "normal":
        parts.append("NormalDVL ARRAY<STRING>")
    elif spec.special == "thrust":
        parts.append("data ARRAY<STRING>")
    elif spec.special == "dvl":
        parts += [
            f"velocity {VEC3}", "altitude STRING", "fom STRING", "velocity_valid STRING", f"dvl_velocity_xyz {VEC3}",
            "beam_distance ARRAY<STRING>", f"dvl_fom_xyz {VEC3}", "data_valid STRING",
        ]
    rows = rows.withColumn("m", F.from_json("payload", ", ".join(parts)))
    m = F.col("m")
    fields = [safe_double(m[f]).alias(c) for c, f in spec.scalars.items()]
    for prefix, f in spec.vectors.items():
        fields += vector_columns(m[f], prefix)
    fields += [_flag(m[f]).alias(c) for c, f in spec.flags.items()]
    if spec.special == "normal":
        fields += [safe_double(F.get(m["NormalDVL"], i)).alias(f"net_normal_{a}") for i, a in enumerate("xyz")]
    elif spec.special == "thrust":
        fields += thrust_columns(m["data"])
    elif spec.special == "dvl":
        fields += _dvl_columns(m, F.col("source_topic") == spec.topics[1])
    stamp = m["header"]["stamp"]
    return rows.select(
        "clip", "ts_ns", (F.col("ts_ns") * F.lit(1e-9)).alias("t"),
        F.when(stamp.isNotNull(), stamp_seconds(F.coalesce(stamp["sec"], F.lit("0")).try_cast("double"),
                                                F.coalesce(stamp["nanosec"], F.lit("0")).try_cast("double"))).alias("t_header"),
        *fields, "source_topic",
    )


def _dvl_columns(m: Column, beams: Column) -> list[Column]:
    """Two instruments on one set of columns; the beam instrument's altitude is a mean of beams."""
    velocity = [
        F.when(beams, safe_double(m["dvl_velocity_xyz"][a])).otherwise(safe_double(m["velocity"][a])).alias(f"vel_{a}") for a in "xyz"
    ]
    numbers = F.transform(m["beam_distance"], lambda b: b.try_cast("double"))
    altitude = F.when(beams, mean_positive(numbers)).otherwise(safe_double(m["altitude"]))
    fom = F.when(beams, safe_double(m["dvl_fom_xyz"]["x"])).otherwise(safe_double(m["fom"]))
    valid = F.when(beams, _flag(m["data_valid"])).otherwise(_flag(m["velocity_valid"]))
    return [*velocity, altitude.alias("altitude"), fom.alias("fom"), valid.alias("valid")]


def extract_telemetry(messages: DataFrame, streams: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every canonical stream, or those asked for; a stream nobody recorded is an empty table."""
    return {name: extract_stream(messages, name) for name in (streams or [s.name for s in STREAMS])}


def flight_profile(plane: DataFrame, setpoint: DataFrame | None = None, depth: DataFrame | None = None) -> DataFrame:
    """One row per clip: lock share, achieved flight under lock, commanded medians, tracking error, water."""
    from ..plans import group_quantiles

    locked = F.coalesce(F.col("net_lock") > 0.5, F.lit(False))
    when = lambda c: F.when(locked, c)
    d, speed = F.col("net_distance"), F.hypot("net_vel_u", "net_vel_v")
    rows = plane
    if setpoint is not None:
        middles = None
        for column, out in (("d_net_distance", "commanded_standoff_m"), ("d_net_velocity_horizontal", "commanded_speed_ms"),
                            ("d_net_velocity_vertical", "commanded_vertical_ms")):
            one = group_quantiles(setpoint, ["clip"], column, [0.5], "_q").select("clip", F.col("_q")[0].alias(out))
            middles = one if middles is None else middles.join(one, "clip", "full")
        rows = rows.join(middles, "clip", "left")
    else:
        none = F.lit(None).cast("double")
        rows = rows.withColumns({"commanded_standoff_m": none, "commanded_speed_ms": none, "commanded_vertical_ms": none})
    error = d - F.col("commanded_standoff_m")
    out = rows.groupBy("clip").agg(
        F.count(F.lit(1)).alias("samples"), F.round(100.0 * F.avg(locked.cast("double")), 2).alias("net_lock_pct"),
        F.round(F.avg(when(d)), 3).alias("standoff_m_mean"), F.round(F.stddev_samp(when(d)), 3).alias("standoff_m_sd"),
        F.round(F.min(when(d)), 3).alias("standoff_m_min"), F.round(F.max(when(d)), 3).alias("standoff_m_max"),
        F.round(F.avg(when(speed)), 3).alias("net_speed_ms_mean"),
        F.round(F.stddev_samp(when(F.col("net_pitch"))), 4).alias("net_pitch_sd"),
        F.round(F.stddev_samp(when(F.col("net_heading"))), 4).alias("net_heading_sd"),
        *[F.round(F.max(c), 3).alias(c) for c in ("commanded_standoff_m", "commanded_speed_ms", "commanded_vertical_ms")],
        F.round(F.avg(when(error)), 3).alias("standoff_error_m_mean"),
        F.round(F.avg(when(F.abs(error))), 3).alias("standoff_error_m_abs_mean"),
    )
    if depth is not None:
        water = depth.groupBy("clip").agg(
            F.round(F.avg("depth"), 3).alias("depth_m_mean"), F.round(F.max("depth"), 3).alias("depth_m_max"),
            F.round(F.avg("temperature"), 3).alias("temperature_c_mean"))
        out = out.join(water, "clip", "left")
    return out
