"""Positions of a pass expressed on declared pens; a whole fleet of pens is one job."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A pen nobody declared otherwise.
DEFAULT_PEN = {
    "circumference_m": 160.0, "cylinder_depth_m": 15.0, "cone_depth_m": 10.0, "barge_bearing_deg": 0.0,
    "barge_offset_m": 18.0, "start_bearing_deg": 0.0,
}


def pen_geometry(pens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pens with derived sizes, rejected pens with the reason)``; absent dimensions take defaults."""
    filled = pens
    for name, value in DEFAULT_PEN.items():
        have = F.col(name).cast("double") if name in pens.columns else F.lit(None).cast("double")
        filled = filled.withColumn(name, F.coalesce(have, F.lit(value)))
    cw = F.col("clockwise") if "clockwise" in pens.columns else F.lit(None).cast("boolean")
    filled = filled.withColumn("clockwise", F.coalesce(cw, F.lit(True)))
    # The sentences below are outputs that must match the published ones word for word.
    problem = (
        F.when(F.col("circumference_m") <= 0, "circumference must be positive")
        .when((F.col("cylinder_depth_m") < 0) | (F.col("cone_depth_m") < 0), "depths must be non-negative")
        .when(F.col("cylinder_depth_m") + F.col("cone_depth_m") <= 0, "a pen needs some depth")
    )
    checked = filled.withColumn("problem", problem)
    radius = F.col("circumference_m") / (2.0 * math.pi)
    slant = F.hypot(radius, F.col("cone_depth_m"))
    good = checked.where(F.col("problem").isNull()).drop("problem").withColumns({
        "radius_m": radius, "total_depth_m": F.col("cylinder_depth_m") + F.col("cone_depth_m"), "cone_slant_m": slant,
        "net_area_m2": F.col("circumference_m") * F.col("cylinder_depth_m") + F.lit(math.pi) * radius * slant,
    })
    return good, checked.where(F.col("problem").isNotNull())


def bearing_at(along: Column) -> Column:
    """Compass bearing of a point of the pass, on columns of a geometry table."""
    sweep = 360.0 * along / F.col("circumference_m")
    turned = F.col("start_bearing_deg") + F.when(F.col("clockwise"), sweep).otherwise(-sweep)
    return F.pmod(turned, F.lit(360.0))


def radius_at(depth: Column) -> Column:
    """Net radius at a depth: the wall's, shrinking linearly through the cone."""
    into = F.least(depth - F.col("cylinder_depth_m"), F.col("cone_depth_m"))
    in_cone = (depth > F.col("cylinder_depth_m")) & (F.col("cone_depth_m") > 0)
    return F.when(in_cone, F.col("radius_m") * (1.0 - F.try_divide(into, "cone_depth_m"))).otherwise(F.col("radius_m"))


def place_on_pen(positions: DataFrame, pens: DataFrame, on: str = "pen_id") -> DataFrame:
    """``along_m, depth_m`` placed on their pen: bearing, x/y/z, section, arc from the barge, side.

    A position without depth is taken at the surface.
    """
    rows = positions.withColumn("depth_m", F.coalesce("depth_m", F.lit(0.0))).join(pens, on)
    bearing, radius = bearing_at(F.col("along_m")), radius_at(F.col("depth_m"))
    angle = F.radians(bearing)
    delta = F.pmod(bearing - F.col("barge_bearing_deg") + 540.0, F.lit(360.0)) - 180.0
    arc = F.abs(delta) / 360.0 * F.col("circumference_m")
    in_cone = (F.col("depth_m") > F.col("cylinder_depth_m")) & (F.col("cone_depth_m") > 0)
    zero = F.lit(0.0)
    return rows.select(
        *positions.columns,
        F.round(bearing, 1).alias("bearing_deg"), (F.round(radius * F.sin(angle), 3) + zero).alias("x_m"),
        (F.round(radius * F.cos(angle), 3) + zero).alias("y_m"), (F.round(-F.col("depth_m"), 3) + zero).alias("z_m"),
        F.when(in_cone, "cone").otherwise("wall").alias("section"), F.round(arc, 1).alias("arc_from_barge_m"),
        F.when(arc < 0.5, "at the barge").when(delta > 0, "clockwise").otherwise("anticlockwise").alias("side"),
    )


def coverage_of_net(coverage: DataFrame, pens: DataFrame, on: str = "pen_id") -> DataFrame:
    """Share of the net area and of the ring that a pass saw, and passes needed for the ring."""
    rows = coverage.join(pens, on)
    area = F.coalesce(F.try_divide("swept_area_m2", "net_area_m2"), F.lit(0.0))
    ring = F.coalesce(F.try_divide("along_extent_m", "circumference_m"), F.lit(0.0))
    return rows.select(
        *coverage.columns, F.round("net_area_m2", 1).alias("net_area_m2"), F.round(area, 6).alias("area_fraction"),
        F.round(100.0 * area, 3).alias("area_percent"), F.round(ring, 4).alias("ring_fraction"),
        F.round(100.0 * ring, 2).alias("ring_percent"),
        F.greatest(F.lit(1), F.ceil(F.try_divide(F.lit(1.0), ring))).alias("_passes"), ring.alias("_ring"),
    ).withColumn("passes_to_cover_ring", F.when(F.col("_ring") > 0, F.col("_passes"))).drop("_passes", "_ring")


def barge_anchor(pens: DataFrame) -> DataFrame:
    """Where the feed barge of every pen lies."""
    angle = F.radians("barge_bearing_deg")
    distance = F.col("radius_m") + F.col("barge_offset_m")
    zero = F.lit(0.0)
    return pens.select(
        "pen_id", F.round(F.pmod(F.col("barge_bearing_deg"), F.lit(360.0)), 1).alias("bearing_deg"),
        (F.round(distance * F.sin(angle), 2) + zero).alias("x_m"), (F.round(distance * F.cos(angle), 2) + zero).alias("y_m"),
        F.round(distance, 2).alias("distance_from_centre_m"),
    )


def scene_band(track: DataFrame, pens: DataFrame, image_width_px: float = 1280.0, on: str = "pen_id") -> DataFrame:
    """Track points with their bearing on the pen and the footprint of their frame."""
    rows = track.join(pens, on)
    return rows.select(
        *track.columns, F.round(bearing_at(F.col("along_m")), 2).alias("bearing_deg"),
        F.round(F.coalesce("mm_per_px", F.lit(0.0)) * image_width_px / 1000.0, 3).alias("footprint_m"),
    )
