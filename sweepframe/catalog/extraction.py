"""All thirteen canonical streams out of raw messages, and the frame table from messages end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import timealign
from ..sources import telemetry
from .bindings import events
from .registry import query
from .statistics import rounded

#: A number of the message, or text that is none: number j fails on every (j + 5)-th event.
NUMBER = "CASE WHEN event_id % {m} = 0 THEN 'n/a' ELSE CAST(value + {j} * 0.5 AS STRING) END"
VALUE = "CASE WHEN event_id % {m} = 0 THEN NULL ELSE value + {j} * 0.5 END"


def number(j: int, form: str = NUMBER) -> str:
    return form.format(j=j, m=j + 5)


def payload(spec: telemetry.Stream) -> list[tuple[str, str]]:
    """``(field, SQL)`` of a stream's message, number j for its j-th field."""
    fields, j = [], 0
    for f in spec.scalars.values():
        fields.append((f, number(j)))
        j += 1
    for f in spec.vectors.values():
        fields.append((f, "named_struct(" + ", ".join(f"'{a}', {number(j + i)}" for i, a in enumerate("xyz")) + ")"))
        j += 3
    fields += [(f, "CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'False' END") for f in spec.flags.values()]
    if spec.special == "normal":
        fields.append(("NormalDVL", f"array({', '.join(number(j + i) for i in range(3))})"))
    elif spec.special == "thrust":
        fields.append(("data", "transform(sequence(0, 9), c -> CAST(CASE WHEN (event_id + c) % 4 = 0 THEN 65535.0 ELSE 1400 + c * 10 + value END AS STRING))"))
    elif spec.special == "dvl":
        xyz = lambda k: "named_struct(" + ", ".join(f"'{a}', {number(k + i)}" for i, a in enumerate("xyz")) + ")"
        fields += [("velocity", xyz(0)), ("altitude", number(3)), ("fom", number(4)), ("velocity_valid", "CASE WHEN event_id % 3 = 0 THEN '1' ELSE '0' END"), ("dvl_velocity_xyz", xyz(5)),
                   ("beam_distance", "array(CAST(value - 20 AS STRING), CAST(value AS STRING), '-1', 'x')"), ("dvl_fom_xyz", xyz(8)), ("data_valid", "CASE WHEN event_id % 3 = 1 THEN 'TRUE' ELSE '0' END")]
    return fields


def messages(spark, sf):
    """Every event is a message of every stream; a user is a clip, and two instruments report velocity."""
    e = events(spark, sf).withColumn("clip", F.concat(F.lit("2024-01-01_"), F.col("user_id").cast("string")))
    stamp = "CASE WHEN event_id % 4 <> 0 THEN named_struct('stamp', named_struct('sec', CAST(t_us div 1000000 AS STRING), 'nanosec', CAST(t_us % 1000000 * 1000 AS STRING))) END"
    out = None
    for s in telemetry.STREAMS:
        body = ", ".join(f"'{f}', {sql}" for f, sql in [("header", stamp), *payload(s)])
        topic = F.lit(s.topics[0]) if len(s.topics) == 1 else F.when((F.col("user_id") % 5 == 0) | (F.col("event_id") % 2 == 1), s.topics[1]).otherwise(s.topics[0])
        part = e.select("clip", topic.alias("topic"), F.lit(s.name).alias("msgtype"), (F.col("t_us") * 1000).alias("ts_ns"), F.expr(f"to_json(named_struct({body}))").alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


def columns_sql() -> str:
    """``(stream, column, SQL of the value)`` of everything the extractors give, as a union over ``ev``."""
    rows: list[tuple[str, str, str]] = []
    for s in telemetry.STREAMS:
        j = 0
        for c in s.scalars:
            rows.append((s.name, c, number(j, VALUE)))
            j += 1
        for prefix in s.vectors:
            for a in "xyz":
                rows.append((s.name, f"{prefix}_{a}", number(j, VALUE)))
                j += 1
        rows += [(s.name, c, "CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.0 END") for c in s.flags]
        if s.special == "normal":
            rows += [(s.name, f"net_normal_{a}", number(j + i, VALUE)) for i, a in enumerate("xyz")]
        elif s.special == "thrust":
            one = lambda c: f"CASE WHEN (event_id + {c}) % 4 = 0 THEN NULL ELSE 1400 + {c} * 10 + value END"
            rows += [(s.name, f"thrust_{c}", one(c)) for c in range(8)]
            rows.append((s.name, "thrust_effort", "list_avg(list_filter([" + ", ".join(f"abs({one(c)} - 1500)" for c in range(8)) + "], lambda x: x IS NOT NULL))"))
        elif s.special == "dvl":
            both = lambda x, y: f"CASE WHEN beams THEN {y} ELSE {x} END"
            rows += [(s.name, f"vel_{a}", both(number(i, VALUE), number(5 + i, VALUE))) for i, a in enumerate("xyz")]
            rows += [(s.name, "altitude", both(number(3, VALUE), "list_avg(list_filter([value - 20, value], lambda x: x > 0))")), (s.name, "fom", both(number(4, VALUE), number(8, VALUE))),
                     (s.name, "valid", both("CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 0.0 END", "CASE WHEN event_id % 3 = 1 THEN 1.0 ELSE 0.0 END"))]
    return " UNION ALL ".join(
        f"""SELECT clip, '{s}' AS stream, '{c}' AS "column", ({sql})::DOUBLE AS v, t_header FROM {'dv' if s == 'dvl' else 'ev'}""" for s, c, sql in rows)


EVENTS = """
WITH ev AS (SELECT *, '2024-01-01_' || user_id AS clip, epoch_us(ts) AS t_us, CASE WHEN event_id % 4 <> 0 THEN epoch_us(ts) / 1e6 END AS t_header FROM events),
dv AS (SELECT *, beam AS beams FROM (SELECT *, user_id % 5 = 0 OR event_id % 2 = 1 AS beam FROM ev) QUALIFY beam = bool_and(beam) OVER (PARTITION BY clip))
"""


@query(EVENTS + f""", al AS ({columns_sql()})
SELECT clip, stream, "column", count(*) AS rows, count(v) AS read, round(sum(v), 4) AS total, count(t_header) AS stamped, round(sum(t_header - 1704067200), 2) AS stamps FROM al GROUP BY ALL""")
def telemetry_extractors(spark, sf):
    """Every field of the thirteen extractors per clip: rows, readings and their sum, header stamps."""
    raw, out = messages(spark, sf), None
    for name, rows in telemetry.extract_telemetry(raw).items():
        fields = [c for c in rows.columns if c not in ("clip", "ts_ns", "t", "t_header", "source_topic")]
        sums = [v for c in fields for v in (F.count(c).alias(f"n_{c}"), F.sum(c).alias(f"s_{c}"))]
        per = rows.groupBy("clip").agg(F.count(F.lit(1)).alias("rows"), F.count("t_header").alias("stamped"), F.sum(F.col("t_header") - 1704067200).alias("stamps"), *sums)
        stack = ", ".join(f"'{c}', `n_{c}`, `s_{c}`" for c in fields)
        part = per.select("clip", F.lit(name).alias("stream"), "rows", "stamped", F.round("stamps", 2).alias("stamps"), F.expr(f"stack({len(fields)}, {stack}) AS (column, read, total)"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("total", F.round("total", 4))


#: Seconds within which a frame takes a sample.
TOLERANCE = 1800.0
TABLE = EVENTS + f""", fr AS (SELECT clip, t_us / 1e6 + event_id % 50 AS t, (row_number() OVER (PARTITION BY clip ORDER BY t_us, event_id) - 1)::BIGINT AS msg_index FROM ev WHERE event_type = 'view'),
np AS (SELECT clip, t_us / 1e6 AS t, {number(0, VALUE)} AS dist, {number(3, VALUE)} AS lck, {number(4, VALUE)} AS u, {number(5, VALUE)} AS v FROM ev WHERE event_type = 'click'),
dt AS (SELECT clip, t_us / 1e6 AS t, {number(0, VALUE)} AS depth, {number(1, VALUE)} AS temperature FROM ev WHERE event_type = 'signup'),
a AS (SELECT fr.clip, msg_index, fr.t, np.dist, np.lck, np.u, np.v, np.t AS nt FROM fr LEFT JOIN np ON np.clip = fr.clip AND abs(np.t - fr.t) <= {TOLERANCE}
  QUALIFY row_number() OVER (PARTITION BY fr.clip, msg_index ORDER BY abs(np.t - fr.t), np.t) = 1),
b AS (SELECT a.*, dt.depth, dt.temperature FROM a LEFT JOIN dt ON dt.clip = a.clip AND abs(dt.t - a.t) <= {TOLERANCE} QUALIFY row_number() OVER (PARTITION BY a.clip, msg_index ORDER BY abs(dt.t - a.t), dt.t) = 1),
tb AS (SELECT clip || '_video_' || lpad(msg_index::VARCHAR, 6, '0') || '.png' AS frame, clip, msg_index, '2024-01-01' AS day, dist AS standoff, sqrt(u * u + v * v) AS net_speed, coalesce(lck > 0.5, false) AS locked, depth, temperature, nt FROM b)
"""


def frame_table(spark, sf):
    """View events as frames; their index, net and water samples all come out of messages, through names, index, as-of join and derived columns."""
    e = events(spark, sf).withColumn("clip", F.concat(F.lit("2024-01-01_"), F.col("user_id").cast("string")))
    seen = e.where("event_type = 'view'").withColumn("t", F.col("t_us") / 1e6 + F.col("event_id") % 50)
    index = seen.groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_us", "event_id", "t"))), lambda s: s["t"]).alias("times"))
    times = timealign.index_times(index)
    # One frame more than the index knows: it stays, without a time.
    paths = times.unionByName(index.select("clip", F.size("times").cast("bigint").alias("msg_index"), F.lit(None).cast("double").alias("t"))).select(
        F.concat(F.lit("/data/"), "clip", F.lit("_video_"), F.lpad(F.col("msg_index").cast("string"), 6, "0"), F.lit(".png")).alias("path"))
    raw = messages(spark, sf).join(e.select("clip", (F.col("t_us") * 1000).alias("ts_ns"), "event_type").distinct(), ["clip", "ts_ns"])
    streams = {"net_plane": telemetry.extract_stream(raw.where("event_type = 'click'"), "net_plane"), "depth_temp": telemetry.extract_stream(raw.where("event_type = 'signup'"), "depth_temp")}
    return timealign.frame_table(timealign.join_frames(paths, times, streams, TOLERANCE))


@query(TABLE + """SELECT frame, clip, msg_index, day, round(standoff, 6) AS standoff, round(net_speed, 6) AS net_speed, locked, round(depth, 6) AS depth, round(temperature, 6) AS temperature FROM tb
UNION ALL SELECT clip || '_video_' || lpad((max(msg_index) + 1)::VARCHAR, 6, '0') || '.png', clip, max(msg_index) + 1, '2024-01-01', NULL, NULL, false, NULL, NULL FROM tb GROUP BY clip""")
def frame_table_from_messages(spark, sf):
    return rounded(frame_table(spark, sf).select("frame", "clip", "msg_index", "day", "standoff", "net_speed", "locked", "depth", "temperature"))


@query(TABLE + """SELECT clip, count(*) AS frames, round(avg(standoff), 4) AS standoff, round(avg(net_speed), 4) AS net_speed, round(avg(depth), 4) AS depth FROM tb WHERE standoff IS NOT NULL AND locked GROUP BY 1""")
def usable_frames_per_clip(spark, sf):
    usable = timealign.usable_frames(frame_table(spark, sf))
    return usable.groupBy("clip").agg(F.count(F.lit(1)).alias("frames"), *[F.round(F.avg(c), 4).alias(c) for c in ("standoff", "net_speed", "depth")])
