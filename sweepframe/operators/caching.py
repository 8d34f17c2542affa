"""Incremental scoring: a user's model sees only frames it has not scored before."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def missing_frames(frames: DataFrame, cache: DataFrame, model: str, conf: float, key: str = "frame") -> DataFrame:
    """Frames without a cached entry of this model at this confidence."""
    known = cache.where((F.col("model") == model) & (F.col("conf") == conf)).select(key)
    return frames.join(known, key, "left_anti")


def score_missing(
    frames: DataFrame, cache: DataFrame, model: str, conf: float, scorer: Scorer, key: str = "frame"
) -> DataFrame:
    """New cache rows ``key, model, conf, ndet, score``, to be appended to the cached table.

    ``scorer`` is the user's batch function from frame rows to ``key, ndet, score``; what it
    loads it loads once per task.
    """
    todo = missing_frames(frames, cache, model, conf, key)
    kind = dict(frames.dtypes)[key]
    scored = todo.mapInPandas(scorer, f"{key} {kind}, ndet int, score double")
    return scored.select(key, F.lit(model).alias("model"), F.lit(float(conf)).alias("conf"), "ndet", "score")


def pivot_models(scores: DataFrame, models: list[str], key: str = "frame") -> DataFrame:
    """Long scores as ``ndet_<m>, score_<m>, fp_<m>`` columns for the wide frame table."""
    wide = scores.groupBy(key).pivot("model", models).agg(F.max("ndet").alias("ndet"), F.max("score").alias("score"))
    out = [key]
    for m in models:
        n = F.coalesce(F.col(f"{m}_ndet"), F.lit(0))
        out += [n.alias(f"ndet_{m}"), F.col(f"{m}_score").alias(f"score_{m}"), (n > 0).cast("int").alias(f"fp_{m}")]
    return wide.select(*out)
