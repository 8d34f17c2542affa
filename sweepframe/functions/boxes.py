"""Box geometry on columns or on struct fields."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def _overlap(a, b) -> tuple[Column, Column]:
    """``(intersection, sum of both areas)``; ``a`` and ``b`` map a field name to a column."""
    zero = F.lit(0.0)
    wide = F.greatest(zero, F.least(a("x2"), b("x2")) - F.greatest(a("x1"), b("x1")))
    high = F.greatest(zero, F.least(a("y2"), b("y2")) - F.greatest(a("y1"), b("y1")))
    areas = [
        F.greatest(zero, box("x2") - box("x1")) * F.greatest(zero, box("y2") - box("y1"))
        for box in (a, b)
    ]
    return wide * high, areas[0] + areas[1]


def fields(struct: Column):
    """Accessor for boxes held in a struct column."""
    return lambda name: struct[name]


def named(prefix: str = ""):
    """Accessor for boxes spread over four columns with a common prefix."""
    return lambda name: F.col(prefix + name)


def iou(a, b) -> Column:
    """Intersection over union, 0 where the union is empty."""
    inter, areas = _overlap(a, b)
    return F.coalesce(F.try_divide(inter, areas - inter), F.lit(0.0))


def iou_eps(a, b, eps: float = 1e-9) -> Column:
    """Intersection over (union + eps), the form suppression is defined with."""
    inter, areas = _overlap(a, b)
    return inter / (areas - inter + F.lit(eps))


def register_sql_functions(spark: SparkSession) -> None:
    """Make ``iou`` and the Wilson bounds callable from SQL text as SQL scalar functions."""
    from .intervals import Z95

    args = ", ".join(f"{side}{c} DOUBLE" for side in "ab" for c in BOX)
    inter = (
        "greatest(0D, least(ax2, bx2) - greatest(ax1, bx1))"
        " * greatest(0D, least(ay2, by2) - greatest(ay1, by1))"
    )
    areas = (
        "greatest(0D, ax2 - ax1) * greatest(0D, ay2 - ay1)"
        " + greatest(0D, bx2 - bx1) * greatest(0D, by2 - by1)"
    )
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION iou({args}) RETURNS DOUBLE "
        f"RETURN coalesce(try_divide({inter}, {areas} - {inter}), 0D)"
    )
    half = f"{Z95}D * sqrt(k / n * (1 - k / n) / n + {Z95 * Z95}D / (4D * n * n))"
    centre = f"k / n + {Z95 * Z95}D / (2D * n)"
    for name, bound in (
        ("wilson_lo", f"greatest(0D, ({centre} - {half}) / (1 + {Z95 * Z95}D / n))"),
        ("wilson_hi", f"least(1D, ({centre} + {half}) / (1 + {Z95 * Z95}D / n))"),
    ):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(k DOUBLE, n DOUBLE) RETURNS DOUBLE "
            f"RETURN CASE WHEN n > 0 THEN {bound} END"
        )
