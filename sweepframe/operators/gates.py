"""Gates and verdicts: capture conditions per frame, passes, releases."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import group_sizes, ordered_columns
from .ranking import top_per_group

# Statuses, verdict texts and their bounds.
IN_ENVELOPE, OUT_OF_ENVELOPE, UNKNOWN = "in_envelope", "out_of_envelope", "unknown"
ACCEPT_AT, NOTE_AT = 0.95, 0.80
VERDICTS = (
    "accept — inspection flown inside validated conditions",
    "accept with note — a minority of frames fell outside validated conditions",
    "re-fly recommended — most frames fell outside validated conditions",
)


@dataclass(frozen=True)
class Envelope:
    """Validated capture conditions. ``fitted=False`` means no range was ever found."""

    standoff_min: float = 0.0
    standoff_max: float | None = None
    speed_max: float | None = None
    require_lock: bool = True
    fitted: bool = True


@dataclass(frozen=True)
class Band:
    """Validated image-quality range; a side left None is open."""

    sharpness_min: float | None = None
    sharpness_max: float | None = None
    contrast_min: float | None = None
    contrast_max: float | None = None


# The range of conditions present in the evaluated frames (fixed values).
OBSERVED_ENVELOPE = Envelope(0.19, 1.54, 0.35)


def _texts(*reasons: Column) -> Column:
    return F.filter(F.array(*reasons), lambda r: r.isNotNull())


# The sentences below are outputs that must match the published ones word for word.
def _sentence(template: str, *args: Column | float) -> Column:
    return F.format_string(template, *[a if isinstance(a, Column) else F.lit(float(a)) for a in args])


def envelope_gate(
    frames: DataFrame, spec: Envelope, standoff: str = "standoff", speed: str = "net_speed", locked: str = "locked"
) -> DataFrame:
    """Adds ``status`` and ``reasons``. What cannot be verified is unknown, never inside."""
    distance, pace = F.col(standoff), F.col(speed)
    over = [
        F.when(distance < spec.standoff_min, _sentence(
            "standoff %.2f m below validated minimum %.2f m", distance, spec.standoff_min))
    ]
    if spec.standoff_max is not None:
        over.append(F.when(distance > spec.standoff_max, _sentence(
            "standoff %.2f m above validated maximum %.2f m", distance, spec.standoff_max)))
    if spec.speed_max is not None:
        over.append(F.when(pace > spec.speed_max, _sentence(
            "sweep speed %.2f m/s above validated maximum %.2f m/s", pace, spec.speed_max)))
    blocked = F.when(F.lit(not spec.fitted), "no validated operating envelope for this model")
    if spec.require_lock:
        blocked = blocked.when(~F.coalesce(F.col(locked), F.lit(False)), "net-plane estimate not locked")
    blocked = blocked.when(distance.isNull(), "no standoff telemetry for this frame")
    return (
        frames.withColumn("_blocked", blocked).withColumn("_over", _texts(*over))
        .withColumn("status", F.when(F.col("_blocked").isNotNull(), UNKNOWN)
                    .when(F.size("_over") > 0, OUT_OF_ENVELOPE).otherwise(IN_ENVELOPE))
        .withColumn("reasons", F.when(F.col("_blocked").isNotNull(), F.array("_blocked")).otherwise(F.col("_over")))
        .drop("_blocked", "_over")
    )


def check_conditions(frames: DataFrame) -> DataFrame:
    """Gate against the observed conditions: similarity to the evaluated sample, not accuracy."""
    return envelope_gate(frames, OBSERVED_ENVELOPE)


def band_check(frames: DataFrame, band: Band, sharpness: str = "sharpness", contrast: str = "contrast") -> DataFrame:
    """Adds ``in_band`` and ``band_reasons``."""
    s, c = F.col(sharpness), F.col(contrast)
    tests = []
    if band.sharpness_min is not None:
        tests.append(F.when(s < band.sharpness_min, _sentence(
            "sharpness %.0f below validated minimum %.0f (blur / light loss)", s, band.sharpness_min)))
    if band.sharpness_max is not None:
        tests.append(F.when(s > band.sharpness_max, _sentence(
            "sharpness %.0f above validated maximum %.0f (fine structure resolved)", s, band.sharpness_max)))
    if band.contrast_min is not None:
        tests.append(F.when(c < band.contrast_min, _sentence(
            "contrast %.1f below validated minimum %.1f", c, band.contrast_min)))
    if band.contrast_max is not None:
        tests.append(F.when(c > band.contrast_max, _sentence(
            "contrast %.1f above validated maximum %.1f", c, band.contrast_max)))
    reasons = _texts(*tests) if tests else F.array().cast("array<string>")
    return frames.withColumn("band_reasons", reasons).withColumn("in_band", F.size("band_reasons") == 0)


def pass_verdict(compliance: Column) -> Column:
    return (
        F.when(compliance >= ACCEPT_AT, VERDICTS[0]).when(compliance >= NOTE_AT, VERDICTS[1]).otherwise(VERDICTS[2])
    )


def validity(gated: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Frames per status, compliance (unknown counts against it) and the verdict of a pass."""
    frames = F.count(F.lit(1))
    inside = F.count_if(F.col("status") == IN_ENVELOPE)
    share = F.try_divide(inside, frames)
    return gated.groupBy(*keys).agg(
        frames.alias("frames"), inside.alias(IN_ENVELOPE),
        F.count_if(F.col("status") == OUT_OF_ENVELOPE).alias(OUT_OF_ENVELOPE),
        F.count_if(F.col("status") == UNKNOWN).alias(UNKNOWN),
        _rounded(share, 4).alias("compliance"), pass_verdict(F.coalesce(share, F.lit(0.0))).alias("verdict"),
    )


def top_reasons(gated: DataFrame, keys: Sequence[str] = (), k: int = 5) -> DataFrame:
    """The most frequent kinds of reason, a kind being the first two words."""
    kinds = gated.select(*keys, F.explode("reasons").alias("_r")).withColumn(
        "reason", F.substring_index("_r", " ", 2)
    ).groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"))
    return top_per_group(kinds, keys, [F.col("n").desc(), F.col("reason")], k)


def not_inspected(gated: DataFrame, keys: Sequence[str] = (), k: int = 3) -> DataFrame:
    """For every status that is not trusted: frames, share, and its most frequent full reasons."""
    keys = list(keys)
    lost = gated.where(F.col("status") != IN_ENVELOPE)
    totals = gated.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"))
    per_status = lost.groupBy(*keys, "status").agg(F.count(F.lit(1)).alias("frames"))
    per_status = per_status.join(totals, keys) if keys else per_status.withColumn("_all", totals.scalar())
    given = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("unspecified")))
    counted = lost.select(*keys, "status", F.explode(given).alias("reason")).groupBy(
        *keys, "status", "reason").agg(F.count(F.lit(1)).alias("n"))
    best = top_per_group(counted, [*keys, "status"], [F.col("n").desc(), F.col("reason")], k)
    return per_status.join(best, [*keys, "status"]).select(
        *keys, "status", "frames", F.round(F.col("frames") / F.col("_all"), 4).alias("share"), "reason", "n"
    )


# Runs of detecting frames ----------------------------------------------------------------


def event_runs(
    frames: DataFrame, keys: Sequence[str], order: Sequence[str], hit: Column, max_index_gap: int | None = None
) -> DataFrame:
    """One row per run of consecutive hits: ``keys, run, frames, first, last`` (of ``order[0]``).

    With ``max_index_gap`` a run also ends where ``order[0]`` jumps by more than that.
    """
    keys, order = list(keys), list(order)
    rows = frames.select(*keys, *order, F.coalesce(hit, F.lit(False)).alias("_hit"))
    sizes = group_sizes(rows, keys)
    cut = F.when(F.col("_hit"), 0).otherwise(1)
    if max_index_gap is not None:
        rows = ordered_columns(rows, keys, order, lags={"_before": F.col(order[0])}, sizes=sizes)
        cut = F.when(F.col("_hit") & ~(F.col(order[0]) - F.col("_before") > max_index_gap), 0).otherwise(1)
    rows = ordered_columns(rows, keys, order, sums={"run": cut}, sizes=sizes)
    # Misses count up, so hits between two misses share a number.
    return rows.where("_hit").groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("frames"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last")
    )


def run_summary(runs: DataFrame, keys: Sequence[str] = (), min_frames: int = 3) -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_events"),
        F.count_if(F.col("frames") >= min_frames).alias("confirmed_events"),
        F.max("frames").alias("longest_event"),
    )


def pass_report(
    frames: DataFrame, spec: Envelope, *, clip: str = "clip", order: Sequence[str], ndet: str,
    band: tuple[float | None, float | None] | None = None, sharpness: str = "sharpness",
) -> DataFrame:
    """One row per clip: capture means, validity, detections, events, rates in and out of the envelope.

    Frames are gated before any filter, so unverifiable ones count against compliance.
    """
    gated = envelope_gate(frames, spec).withColumn("_n", F.coalesce(F.col(ndet), F.lit(0)))
    flag = (F.col("_n") > 0).cast("double")
    trusted = F.col("status") == IN_ENVELOPE
    capture = gated.groupBy(clip).agg(
        _mean("standoff", 3).alias("standoff_mean"),
        _rounded(F.min("standoff"), 2).alias("standoff_min"), _rounded(F.max("standoff"), 2).alias("standoff_max"),
        _mean("net_speed", 3).alias("net_speed_mean"),
        _mean(sharpness, 1).alias("sharpness_mean"),
        F.count_if(F.col("_n") > 0).alias("frames_with_detection"), F.sum("_n").alias("total_detections"),
        _rounded(F.avg(F.when(trusted, flag)), 4).alias("rate_in_envelope"),
        _rounded(F.avg(F.when(~trusted, flag)), 4).alias("rate_outside_envelope"),
        *([] if band is None else [_rounded(F.avg(_within(F.col(sharpness), band).cast("double")), 4).alias("share_in_band")]),
    )
    events = run_summary(event_runs(gated, [clip], order, F.col("_n") > 0), [clip])
    report = validity(gated, [clip]).join(capture, clip).join(events, clip, "left")
    return report.fillna(0, ["candidate_events", "confirmed_events", "longest_event"])


def _rounded(value: Column, digits: int) -> Column:
    """A double rounded as SQL engines do, by its product: 0.285 lies below the half and gives 0.28; F.round reads its shortest decimal, 0.29."""
    scaled = value.cast("double") * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / F.lit(10.0**digits)).otherwise(value.cast("double"))


def _mean(column: str, digits: int) -> Column:
    """Rounded mean from an exact sum, so that halves are rounded alike in every order of rows.

    Values count to ten decimals. Where one has no such decimal (NaN, infinite, beyond 1e18) it is the mean of doubles.
    """
    value, decimal = F.col(column), F.col(column).try_cast("decimal(28,10)")
    exact = F.round(F.avg(decimal), digits).cast("double")
    return F.when(F.count(decimal) == F.count(value), exact).otherwise(F.round(F.avg(value.cast("double")), digits))


def _within(value: Column, band: tuple[float | None, float | None]) -> Column:
    lo, hi = band
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (value >= lo)
    if hi is not None:
        inside = inside & (value <= hi)
    return inside


# Release gate ----------------------------------------------------------------------------

# Thresholds of the sweep, .05 to .90.
SWEEP = tuple(round(0.05 * i, 2) for i in range(1, 19))


@dataclass(frozen=True)
class OperatingPoint:
    """The contract a model has to meet; written down before anything is measured."""

    conf: float = 0.25
    max_false_alarm_rate: float = 0.05
    min_recall: float = 0.80
    min_precision: float | None = None
    min_clean_frames: int = 50
    min_damaged_frames: int = 50


def image_scores(images: DataFrame, gt_boxes: DataFrame, predictions: DataFrame, image: str = "image") -> DataFrame:
    """``image, damaged, top_score`` for every image of the universe, clean and silent ones included."""
    damaged = gt_boxes.groupBy(image).agg(F.lit(True).alias("damaged"))
    top = predictions.groupBy(image).agg(F.max("score").alias("top_score"))
    return (
        images.select(image).distinct().join(damaged, image, "left").join(top, image, "left")
        .withColumn("damaged", F.coalesce("damaged", F.lit(False)))
    )


def threshold_sweep(scores: DataFrame, thresholds: Sequence[float] = SWEEP, keys: Sequence[str] = ()) -> DataFrame:
    """Frame-level behaviour at every threshold, from one pass over the images.

    Each image is reduced to how many thresholds it reaches; only those counts, a few dozen
    rows, are spread over the thresholds. Rates without a denominator are NULL.
    """
    levels = sorted(thresholds)
    reached = F.size(F.filter(F.array(*[F.lit(float(t)) for t in levels]), lambda t: t <= F.col("top_score")))
    counts = scores.groupBy(*keys, "damaged", F.greatest(reached, F.lit(0)).alias("_level")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    steps = F.array(*[F.struct(F.lit(i + 1).alias("no"), F.lit(float(t)).alias("conf")) for i, t in enumerate(levels)])
    spread = counts.withColumn("_s", F.explode(steps))
    fires = F.col("_level") >= F.col("_s")["no"]

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    tallies = spread.groupBy(*keys, F.col("_s")["conf"].alias("conf")).agg(
        total(~F.col("damaged")).alias("clean_frames"), total(F.col("damaged")).alias("damaged_frames"),
        total(~F.col("damaged") & fires).alias("false_alarm_frames"),
        total(F.col("damaged") & fires).alias("detected_frames"),
    )
    return tallies.withColumns({
        "false_alarm_rate": F.try_divide("false_alarm_frames", "clean_frames"),
        "recall": F.try_divide("detected_frames", "damaged_frames"),
        "precision": F.try_divide("detected_frames", F.col("detected_frames") + F.col("false_alarm_frames")),
    })


def release_measure(scores: DataFrame, conf: float = 0.25, keys: Sequence[str] = ()) -> DataFrame:
    """:func:`threshold_sweep` at a single threshold."""
    return threshold_sweep(scores, [conf], keys)


def choose_threshold(sweep: DataFrame, target: float = 0.05, keys: Sequence[str] = ()) -> DataFrame:
    """Per key, the smallest confidence at which false alarms were counted and stay at or below ``target``."""
    feasible = F.col("false_alarm_rate") <= target
    pick = F.min_by(
        F.struct("conf", "false_alarm_rate", "recall", "precision"), F.when(feasible, F.col("conf"))
    )
    return sweep.groupBy(*keys).agg(pick.alias("_c")).select(
        *keys, F.lit(float(target)).alias("target_false_alarm_rate"), F.col("_c").isNotNull().alias("achievable"), "_c.*"
    )


def release_gate(measured: DataFrame, op: OperatingPoint = OperatingPoint(), keys: Sequence[str] = ()) -> DataFrame:
    """One row per check, in order, with the verdict over all of them; what is not measurable fails."""
    checks = [
        ("clean frames", F.col("clean_frames"), op.min_clean_frames, ">="),
        ("damaged frames", F.col("damaged_frames"), op.min_damaged_frames, ">="),
        ("false alarm rate", F.col("false_alarm_rate"), op.max_false_alarm_rate, "<="),
        ("recall", F.col("recall"), op.min_recall, ">="),
    ]
    if op.min_precision is not None:
        checks.append(("precision", F.col("precision"), op.min_precision, ">="))
    rows = []
    for i, (name, value, bound, rule) in enumerate(checks):
        number = value.cast("double")
        ok = number <= float(bound) if rule == "<=" else number >= float(bound)
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("check"), number.alias("value"),
            F.lit(float(bound)).alias("bound"), F.lit(rule).alias("rule"), F.coalesce(ok, F.lit(False)).alias("passed"),
        ))
    listed = measured.withColumn("_checks", F.array(*rows)).withColumn(
        "verdict", F.when(F.forall("_checks", lambda c: c["passed"]), "PASS").otherwise("FAIL")
    )
    return listed.select(*keys, F.inline("_checks"), "verdict").select(
        *keys, "position", "check", "value", "bound", "rule", "passed", "verdict"
    )
