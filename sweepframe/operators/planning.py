"""Site planning: register, forecast hours, thermal state, growth."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import ordered_columns

# Sweep speeds, wave bounds, thermal-optimum coefficients, register vocabulary.
SLOW_SWEEP_MS, FAST_SWEEP_MS = 0.10, 0.30
WAVE_GOOD_M, WAVE_MARGINAL_M = 0.5, 1.0
OPTIMUM_A, OPTIMUM_B = 15.57, 0.8426
FALLOFF_C = 6.0
TONNES, INDIVIDUALS = "TN", "STK"
ACTIVE, SEA_PREFIX = "AKTIV", "SJ"
RANKS = ("good", "marginal", "poor", "unknown")


# Forecast --------------------------------------------------------------------------------
# The sentences below are outputs that must match the published ones word for word.


def rate_hours(forecast: DataFrame) -> DataFrame:
    """Adds ``rating, reasons, current_vs_sweep``; the worse of wave and current decides."""
    wave, current = F.col("sea_surface_wave_height_m"), F.col("sea_water_speed_ms")
    by_wave = F.when(wave > WAVE_MARGINAL_M, 2).when(wave > WAVE_GOOD_M, 1).otherwise(0)
    by_current = F.when(current >= FAST_SWEEP_MS, 2).when(current >= SLOW_SWEEP_MS, 1).otherwise(0)
    worst = F.greatest(by_wave, by_current)
    blind = wave.isNull() & current.isNull()
    rating = F.when(blind, "unknown").when(worst == 2, "poor").when(worst == 1, "marginal").otherwise("good")
    reasons = F.filter(F.array(
        F.when(wave > WAVE_MARGINAL_M, F.format_string(
            f"wave height %.1f m above {WAVE_MARGINAL_M} m — launch and recovery difficult", wave))
        .when(wave > WAVE_GOOD_M, F.format_string("wave height %.1f m — workable but degraded", wave)),
        F.when(current >= FAST_SWEEP_MS, F.format_string(
            f"current %.2f m/s at or above the fastest commanded sweep ({FAST_SWEEP_MS} m/s) — net-following degraded", current))
        .when(current >= SLOW_SWEEP_MS, F.format_string(
            f"current %.2f m/s comparable to the slowest commanded sweep ({SLOW_SWEEP_MS:.1f} m/s) — expect station-keeping effort", current)),
    ), lambda r: r.isNotNull())
    fine = F.array(F.lit("wave and current both inside the range this system was characterised in"))
    return forecast.withColumns({
        "rating": rating,
        "reasons": F.when(blind, F.array(F.lit("no forecast values for this hour"))).when(F.size(reasons) == 0, fine).otherwise(reasons),
        "current_vs_sweep": F.round(current / SLOW_SWEEP_MS, 2),
    })


def best_window(hours: DataFrame, keys: Sequence[str] = (), time: str = "time") -> DataFrame:
    """Earliest good hour per key, else the earliest marginal one, else NULL."""
    rank = F.when(F.col("rating") == "good", 0).when(F.col("rating") == "marginal", 1)
    pick = F.min_by(F.struct(F.col(time).alias("best_time"), F.col("rating").alias("best_rating")), F.when(rank.isNotNull(), F.struct(rank, time)))
    return hours.groupBy(*keys).agg(pick.alias("_b")).select(*keys, "_b.*")


def forecast_summary(hours: DataFrame, keys: Sequence[str] = (), time: str = "time") -> DataFrame:
    """Hours, span, ratings, good share and best window per key."""
    keys = list(keys)
    counts = hours.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("hours"), F.min(time).alias("from"), F.max(time).alias("to"),
        *[F.count_if(F.col("rating") == r).alias(r) for r in RANKS],
        F.round(F.avg(F.when(F.col("rating") == "good", 1.0).otherwise(0.0)), 3).alias("good_fraction"),
    )
    best = best_window(hours, keys, time)
    if keys:
        return counts.join(best, keys, "left")
    return counts.withColumn("_b", best.select(F.struct("*")).scalar()).select("*", "_b.*").drop("_b")


# Thermal state and growth ----------------------------------------------------------------


def thermal_optimum(weight_g: Column) -> Column:
    """Temperature of fastest growth for a weight; a weight that is not positive is an error."""
    return F.when(weight_g <= 0, F.raise_error(F.lit("weight must be positive"))).otherwise(OPTIMUM_A - OPTIMUM_B * F.log(weight_g))


def thermal_state(rows: DataFrame, weight: str = "weight_g", temperature: str = "temperature_c") -> DataFrame:
    optimum = thermal_optimum(F.col(weight))
    delta = F.col(temperature) - optimum
    state = (
        F.when(delta > 3, "above optimum — growth suppressed, oxygen demand elevated").when(delta > 1, "slightly above optimum")
        .when(delta < -3, "well below optimum — growth slowed").when(delta < -1, "slightly below optimum")
        .when(delta.isNotNull(), "near optimum")
    )
    return rows.withColumns({"thermal_optimum_c": optimum, "delta_c": delta, "state": state})


def _warmth(temperature: str) -> Column:
    """Degrees above zero. A missing temperature is unknown, not zero: it adds nothing and shows as NULL."""
    return F.when(F.col(temperature).isNotNull(), F.greatest(F.col(temperature), F.lit(0.0)))


def degree_days(temps: DataFrame, keys: Sequence[str], temperature: str = "temperature_c", days_per_step: float = 1.0) -> DataFrame:
    """Degree days of the steps that were measured; NULL for a cohort without any measurement."""
    return temps.groupBy(*keys).agg((F.sum(_warmth(temperature)) * days_per_step).alias("degree_days"))


def tgc_growth(
    temps: DataFrame, keys: Sequence[str], order: Sequence[str], *, initial: str = "initial_weight_g",
    temperature: str = "temperature_c", tgc: float = 2.0, days_per_step: float = 1.0,
) -> DataFrame:
    """Weight after every step by the thermal growth coefficient: a running sum under a cube.

    A step without a temperature has no weight; the next step goes on from the last known one.
    """
    step = _warmth(temperature) * F.lit(tgc / 1000.0 * days_per_step)
    summed = ordered_columns(temps, keys, order, sums={"_grown": F.coalesce(step, F.lit(0.0))})
    start = F.when(F.col(initial) <= 0, F.raise_error(F.lit("initial weight must be positive"))).otherwise(F.cbrt(initial))
    weight = F.when(F.col(temperature).isNotNull(), F.pow(start + F.col("_grown"), F.lit(3.0)))
    return summed.withColumn("weight_g", weight).drop("_grown")


def tgc_growth_corrected(
    temps: DataFrame, keys: Sequence[str], order: Sequence[str], *, initial: str = "initial_weight_g",
    temperature: str = "temperature_c", tgc: float = 2.0, days_per_step: float = 1.0,
) -> DataFrame:
    """As :func:`tgc_growth`, each increment scaled by how near the temperature is to the current optimum.

    The optimum depends on the weight just reached, so a cohort is a true recurrence. Rows are
    shuffled by cohort, sorted, and streamed through the task with one number of state per
    cohort; no cohort is ever held. Missing temperatures are treated as in :func:`tgc_growth`.
    """
    import math

    keys, order = list(keys), list(order)
    kinds = dict(temps.dtypes)
    names = [*keys, *order, temperature, initial]
    shape = ", ".join(f"{c} {kinds[c]}" for c in names) + ", weight_g double"
    parts = int(temps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = temps.select(*names).repartition(parts, *keys).sortWithinPartitions(*keys, *order)
    nk = len(keys)

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, weight = None, 0.0
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[:nk] != key:
                    key, weight = row[:nk], float(row[-1])
                    if weight <= 0:
                        raise ValueError("initial weight must be positive")
                if row[-2] is None or row[-2] != row[-2]:
                    out.append(None)
                    continue
                t = float(row[-2])
                gain = max(0.0, 1.0 - abs(t - (OPTIMUM_A - OPTIMUM_B * math.log(weight))) / FALLOFF_C)
                weight = (weight ** (1 / 3) + tgc / 1000.0 * max(0.0, t) * gain * days_per_step) ** 3
                out.append(weight)
            yield batch.assign(weight_g=pd.Series(out, index=batch.index, dtype="float64"))

    return rows.mapInPandas(grow, shape)


# Register --------------------------------------------------------------------------------


def site_flags(sites: DataFrame) -> DataFrame:
    """Adds sea site, active, has coordinates and capacity in tonnes (NULL when counted in fish)."""
    return sites.withColumns({
        "is_sea_site": F.upper("placement").startswith(SEA_PREFIX), "is_active": F.upper("status") == ACTIVE,
        "has_coordinates": F.col("lat").isNotNull() & F.col("lon").isNotNull(),
        "capacity_tonnes": F.when(F.col("capacity_unit") == TONNES, F.col("capacity")),
    })


def by_operator(sites: DataFrame, name: str) -> DataFrame:
    """Rows of ``sites`` in whose operators ``name`` occurs; letter case and outer blanks don't count."""
    return sites.where(F.contains(F.lower("operators"), F.lit(name.strip().lower())))


def register_summary(sites: DataFrame) -> DataFrame:
    """One row of totals: tonnes at sea and individuals on land are never added up."""
    s = site_flags(sites)
    sea = F.col("is_sea_site")
    return s.agg(
        F.count(F.lit(1)).alias("sites"), F.count_if("is_active").alias("active"), F.count_if(sea).alias("sea_sites"),
        F.count_if(~sea).alias("land_sites"),
        F.round(F.coalesce(F.sum(F.when(sea, F.col("capacity_tonnes"))), F.lit(0.0)), 1).alias("licensed_tonnes_total"),
        F.coalesce(F.sum(F.when(~sea & (F.col("capacity_unit") == INDIVIDUALS), F.col("capacity"))), F.lit(0.0)).cast("bigint").alias("licensed_individuals_total"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("production_form") != "", F.col("production_form")))), ", ").alias("production_forms"),
    )


def sites_per_county(sites: DataFrame) -> DataFrame:
    return sites.groupBy("county").agg(F.count(F.lit(1)).alias("sites")).orderBy(F.col("sites").desc(), "county")


def operator_counts(sites: DataFrame) -> DataFrame:
    """Licences per operator; the register lists several in one comma-separated field."""
    names = F.transform(F.split("operators", ","), lambda n: F.trim(n))
    each = sites.select(F.explode(F.filter(names, lambda n: n != "")).alias("operator"))
    return each.groupBy("operator").agg(F.count(F.lit(1)).alias("licences")).orderBy(F.col("licences").desc(), "operator")


def planning_order(sites: DataFrame) -> DataFrame:
    """Sea sites first, then by capacity."""
    return site_flags(sites).orderBy(F.col("is_sea_site").desc(), F.col("capacity").desc(), "loknr")


def site_windows(sites: DataFrame, forecast: DataFrame, max_sites: int = 8) -> DataFrame:
    """Rated forecast hours of the first active sea sites with coordinates (a top-k report)."""
    s = site_flags(sites).where(F.col("is_sea_site") & F.col("is_active") & F.col("has_coordinates"))
    chosen = s.orderBy("loknr").limit(max_sites).select("loknr", "name")
    return rate_hours(forecast).join(F.broadcast(chosen), "loknr")
