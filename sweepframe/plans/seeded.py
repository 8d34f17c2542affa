"""Draws that any engine can repeat: numbers from an md5 of a seed and a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Draws are whole numbers below this.
RANGE = 1 << 48


def draw(seed: int, key: Column | str) -> Column:
    """A number below ``RANGE`` for each key as text; null draws like an empty text."""
    column = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(column.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def draw_sql(seed: int, key: str) -> str:
    """The same number in DuckDB."""
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', coalesce(CAST({key} AS VARCHAR), ''))), 1, 12) AS BIGINT)"
