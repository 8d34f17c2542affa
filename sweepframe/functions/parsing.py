"""Names, numbers and times as they arrive from recordings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Naming conventions of recordings and extracted frames.
FRAME_NAME = r"^(.+?)_(video|sonar)_(\d+)$"
GROUP_NAME = r"^(.+?)[_-]?\d{3,}$"
RECORDING_SUFFIX = r"_(data|video)$"
IMAGE_SUFFIX = r"\.(jpg|jpeg|png|bmp|tif|tiff|webp)$"


def safe_double(value: Column) -> Column:
    """Number or NULL: text that is no number and NaN both become NULL."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def stem(path: Column) -> Column:
    """File name without folders and without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def clip_id(path: Column) -> Column:
    """Recording identifier shared by the data and the video file of one pass."""
    return F.regexp_replace(stem(path), RECORDING_SUFFIX, "")


def frame_clip(frame_stem: Column) -> Column:
    return F.nullif(F.regexp_extract(frame_stem, FRAME_NAME, 1), F.lit(""))


def frame_index(frame_stem: Column) -> Column:
    return F.nullif(F.regexp_extract(frame_stem, FRAME_NAME, 3), F.lit("")).cast("bigint")


def group_of(name: Column) -> Column:
    """Clip a frame belongs to, read from its name; the whole stem when nothing can be read."""
    return F.coalesce(F.nullif(F.regexp_extract(name, GROUP_NAME, 1), F.lit("")), name)


def stamp_seconds(sec: Column, nanosec: Column) -> Column:
    return sec.cast("double") + nanosec.cast("double") * F.lit(1e-9)


def vector_columns(vector: Column, prefix: str) -> list[Column]:
    """A three-component struct as ``prefix_x, prefix_y, prefix_z``."""
    return [safe_double(vector[axis]).alias(f"{prefix}_{axis}") for axis in "xyz"]


def micros(timestamp: str) -> Column:
    """Microseconds since 1970 of a zone-less timestamp column, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({timestamp} AS TIMESTAMP_NTZ))")


def mean_of(values: Column) -> Column:
    """Mean of a numeric array, NULL when it is empty or NULL."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(values))


def mean_positive(beams: Column) -> Column:
    """Altitude from a beam array: mean of the beams that returned something."""
    doubles = F.transform(beams, lambda b: b.cast("double"))
    return mean_of(F.filter(doubles, lambda b: b > 0))
