"""Intervals for proportions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96  # fixed value: normal quantile of the published 95 % intervals


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score bounds clamped to [0, 1]; NULL without trials, an error if k is not in [0, n]."""
    trials = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / trials
    z2 = F.lit(z * z)
    scale = 1.0 + z2 / trials
    centre = (p + z2 / (2.0 * trials)) / scale
    half = z * F.sqrt(p * (1.0 - p) / trials + z2 / (4.0 * trials * trials)) / scale
    broken = (trials > 0) & ((k < 0) | (k > n))
    message = F.concat(F.lit("successes out of range: "), k.cast("string"), F.lit(" of "), n.cast("string"))

    def guarded(bound: Column) -> Column:
        return F.when(broken, F.raise_error(message)).otherwise(bound)

    return (
        guarded(F.when(trials.isNotNull(), F.greatest(F.lit(0.0), centre - half))),
        guarded(F.when(trials.isNotNull(), F.least(F.lit(1.0), centre + half))),
    )


def overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """True when two intervals meet, or when either is missing."""
    return F.coalesce((hi_a >= lo_b) & (hi_b >= lo_a), F.lit(True))
