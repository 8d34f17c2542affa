"""Feature vectors: Gaussian anomaly model, memory banks, nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..plans import group_quantiles, pin
from ..plans.seeded import draw

BANK_ROWS = 50_000
BANK_CONF = "spark.sweepframe.bankRows"
#: Bytes of bank vectors that a task holds.
BLOCK_BYTES = 32 << 20
BLOCK_CONF = "spark.sweepframe.blockBytes"
MOST_PIVOTS = 1024
#: Rows and bank vectors, or pivots, that are compared at a time: a matrix of 8 MB.
TILE = 1024
#: Most rows that a worker sends on at a time.
SENT_ROWS = 10_000
#: Vectors that a task of the k-center pick holds.
HELD_VECTORS = 8192
MOST_TASKS = 4096


@dataclass(frozen=True)
class GaussianModel:
    """Mean, spread and inverse covariance of normal features; F numbers and F x F numbers."""

    mean: np.ndarray
    spread: np.ndarray
    precision: np.ndarray
    centre: np.ndarray


def fit_gaussian(features: DataFrame, vector: str, shrinkage: float = 0.1) -> GaussianModel:
    """Standardised Gaussian with covariance shrunk towards the identity.

    Two passes: means and spreads, then one matrix of centred products per partition, summed
    by Spark. Only the F x F result reaches the driver, where it is inverted.
    """
    rows = features.where(F.col(vector).isNotNull())
    if rows.isEmpty():
        raise ValueError("a Gaussian needs at least one normal feature row")
    stats = rows.select(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vector).cast("array<double>"))).alias("s")
    ).first()["s"]
    n = stats["count"]
    mean = stats["mean"].toArray()
    spread = np.sqrt(stats["variance"].toArray() * (n - 1) / n) + 1e-6

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(mean), len(mean)))
        for batch in batches:
            if len(batch):
                z = (np.stack(batch[vector].to_numpy()).astype(float) - mean) / spread
                total += z.T @ z
        yield pd.DataFrame({"m": [total.ravel().tolist()]})

    cells = rows.select(vector).mapInPandas(products, "m array<double>").select(F.posexplode("m").alias("i", "v"))
    summed = cells.groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    cov = np.array([r["v"] for r in summed]).reshape(len(mean), len(mean)) / max(n - 1, 1)
    cov = (1 - shrinkage) * cov + shrinkage * np.eye(len(mean))
    return GaussianModel(mean, spread, np.linalg.inv(cov), np.zeros(len(mean)))


def mahalanobis(features: DataFrame, vector: str, model: GaussianModel, out: str = "distance") -> DataFrame:
    """Distance of every row from normal, Arrow batch by Arrow batch."""
    mean, spread, precision, centre = model.mean, model.spread, model.precision, model.centre

    @F.pandas_udf(DoubleType())
    def score(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=float)
        d = (np.stack(v.to_numpy()).astype(float) - mean) / spread - centre
        return pd.Series(np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", d, precision, d), 0.0)))

    return features.withColumn(out, score(F.col(vector)))


def distance_threshold(scored: DataFrame, distance: str = "distance", percentile: float = 99.0) -> DataFrame:
    """One-row table holding the percentile of the distances."""
    return group_quantiles(scored, [], distance, [percentile / 100.0], "_q").select(F.col("_q")[0].alias("threshold"))


def random_bank(features: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows drawn by seeded hash of their key: a sampling operator, the same rows every time."""
    return features.orderBy(draw(seed, key), key).limit(size)


def _gaps(x: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Distances to one vector, added up in the order of the dimensions, so that rounding is the same everywhere."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        apart = x[:, j] - one[j]
        total += apart * apart
    return np.sqrt(total)


def _farthest(ids: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Positions of at most ``size`` picks; it ends early when every vector equals a pick."""
    chosen = [int(np.argmin(ids))]
    gap = _gaps(x, x[chosen[0]])
    while len(chosen) < min(size, len(ids)) and gap.max() > 0:
        chosen.append(int(np.argmax(gap)))
        gap = np.minimum(gap, _gaps(x, x[chosen[-1]]))
    return np.array(chosen)


def _farthest_by_passes(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """The picks of :func:`_farthest` from a stored table of any size: one pass a pick, which sends the driver one row."""
    named = F.struct(F.col(key), F.col(vector))
    picks = [rows.agg(F.min_by(named, F.col(key)).alias("p")).first()["p"]]
    while len(picks) < size:
        taken = [np.array(p[vector], float) for p in picks]

        def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x = np.stack(batch[vector].to_numpy()).astype(float)
                    gap = np.minimum.reduce([_gaps(x, one) for one in taken])
                    # A batch's farthest row, the smallest key among equals.
                    best = batch.assign(_gap=gap)[gap == gap.max()].sort_values(key, kind="stable")
                    yield best.iloc[:1][[key, vector, "_gap"]]

        far = rows.mapInPandas(measure, f"{', '.join(f'`{c}` {t}' for c, t in rows.select(key, vector).dtypes)}, _gap double")
        found = far.agg(F.min_by(F.struct(key, vector, "_gap"), F.struct(-F.col("_gap"), F.col(key))).alias("p")).first()["p"]
        if not found["_gap"] > 0:
            break
        picks.append(found)
    return rows.sparkSession.createDataFrame([(p[key], p[vector]) for p in picks], rows.select(key, vector).schema)


def kcenter_bank(features: DataFrame, key: str, vector: str, size: int, seed: int = 0, held: int = HELD_VECTORS) -> DataFrame:
    """Diverse bank of ``size`` rows by farthest-point picks in two steps.

    Rows are dealt by seeded hash of their key to the fewest groups, a power of two, of at most half of
    ``held`` on average. A group is read in key order, ``held`` rows at a time; each time the picks so far and the
    new rows are reduced to ``size`` picks, so a task never holds more than ``held + size`` vectors, also
    where keys repeat. The picks of all groups, ``2 * size / held`` to ``4 * size / held`` of the rows, are then one set of rows to
    pick from: in one task while they are at most ``held``, else in ``size`` passes over the stored picks, with the same result. With
    ``held`` at twice the rows this is the sequential pick; the step before adds at most the radius of
    its own picks (composable coresets, Indyk et al., 2014). ``held`` must be at least four times ``size``.
    Ties in distance go to the smaller key; with fewer different vectors than ``size`` the bank is shorter.
    """
    if held < 4 * size:
        raise ValueError("held must be at least four times size, or the groups never narrow")
    chosen = features.select(key, vector).where(F.col(vector).isNotNull())
    shape, rows = chosen.schema, chosen.count()

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, picks, waiting = None, None, []

        def settle() -> None:
            nonlocal picks, waiting
            some = pd.concat([*([] if picks is None else [picks]), *waiting]).sort_values(key, kind="stable")
            x = np.stack(some[vector].to_numpy()).astype(float)
            picks, waiting = some.iloc[_farthest(some[key].to_numpy(), x, size)], []

        for batch in batches:
            for g, part in batch.groupby("_g", sort=False):
                if group is not None and g != group:
                    settle()
                    yield picks[[key, vector]]
                    picks = None
                group = g
                while len(part):
                    room = held - sum(map(len, waiting))
                    waiting.append(part.iloc[:room])
                    part = part.iloc[room:]
                    if sum(map(len, waiting)) >= held:
                        settle()
        if group is not None:
            if waiting:
                settle()
            yield picks[[key, vector]]

    groups = 1 << max(0, math.ceil(math.log2(max(1, 2 * rows / held))))
    dealt = lambda some, n: some.withColumn("_g", F.pmod(draw(seed, key), F.lit(n))).repartition(min(n, MOST_TASKS), "_g").sortWithinPartitions("_g", key).mapInPandas(reduce, shape)
    chosen = dealt(chosen, groups)
    if groups == 1:
        return chosen
    chosen = pin(chosen)
    return dealt(chosen, 1) if chosen.count() <= held else _farthest_by_passes(chosen, key, vector, size)


def nearest_in_bank(features: DataFrame, bank: DataFrame, key: str, vector: str, out: str = "distance", compared: str | None = None) -> DataFrame:
    """``key, out``: exact Euclidean distance of every row to its nearest bank vector; ``compared`` adds the pairs measured.

    The bank is cut into blocks of at most about ``spark.sweepframe.blockBytes``. Each block gathers the
    vectors nearest to one pivot, a bank vector drawn by hash; pivots and the radii of their cells are all
    that the workers are sent, at most ``MOST_PIVOTS`` of them. A row's distance to the nearest pivot bounds
    its answer, so by the triangle inequality it visits only cells with ``d(row, pivot) - radius`` up to
    that bound. A crowded cell is several blocks. Rows travel in chunks of ``spark.sweepframe.bankRows``; a
    task holds one chunk and one block, compared in tiles of fixed size. Rows without a vector give no row; against an empty bank the distance is null.
    """
    spark = features.sparkSession
    limit, most = int(spark.conf.get(BANK_CONF, str(BANK_ROWS))), int(spark.conf.get(BLOCK_CONF, str(BLOCK_BYTES)))
    kind = dict(features.dtypes)[key]
    shape = f"{key} {kind}, {out} double, _n bigint"
    held = pin(bank.select(F.col(vector).cast("array<double>").alias("b")).where("b IS NOT NULL").distinct())
    size, width = held.agg(F.count(F.lit(1)), F.max(F.size("b"))).first()
    keep = [key, out, *([F.col("_n").alias(compared)] if compared else [])]
    if not size:
        return features.where(F.col(vector).isNotNull()).select(key, F.lit(None).cast("double").alias(out), F.lit(0).cast("bigint").alias("_n")).select(*keep)
    per_block = max(1, most // (8 * width))
    count = min(MOST_PIVOTS, math.ceil(size / per_block))
    pivots = np.array([r["b"] for r in held.orderBy(F.md5(F.array_join(F.transform("b", lambda v: v.cast("string")), ",")), "b").limit(count).collect()], float)  # at most MOST_PIVOTS
    shared = spark.sparkContext.broadcast(pivots)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            gaps = _distances(_matrix(part.column(0)), shared.value)
            near = gaps.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(gaps[np.arange(len(near)), near]), part.column(0)], names=["cell", "gap", "b"])

    cells = pin(held.mapInArrow(settle, "cell int, gap double, b array<double>"))
    about = cells.groupBy("cell").agg(F.max("gap").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # at most MOST_PIVOTS rows
    radius, blocks = np.full(count, -np.inf), np.zeros(count, np.int64)
    for r in about:
        radius[r["cell"]], blocks[r["cell"]] = r["radius"], math.ceil(r["n"] / per_block)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            gaps = _distances(_matrix(part.column(1)), shared.value)
            bound = gaps.min(axis=1, keepdims=True)
            # A hair is added, or rounding might close the cell that holds the answer.
            row, cell = np.nonzero(gaps - radius[None, :] <= bound * (1 + 1e-9) + 1e-9)
            for start in range(0, len(row), SENT_ROWS):
                at, to = row[start:start + SENT_ROWS], cell[start:start + SENT_ROWS]
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in part.columns), pa.array(to.astype(np.int32)), pa.array(blocks[to])], names=[key, "v", "cell", "parts"])

    given = features.select(key, F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    asked = pin(given.mapInArrow(route, f"{key} {kind}, v array<double>, cell int, parts bigint"))
    chunks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(limit)).alias("chunks"))
    numbers = cells.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(per_block)).alias("parts"))
    left = asked.join(chunks, "cell").select(
        "cell", F.pmod(F.xxhash64(key), F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), key, "v")
    right = cells.join(chunks, "cell").join(numbers, "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), "b")

    def meet(rows: pa.Table, block: pa.Table) -> pa.Table:
        n = rows.num_rows if block.num_rows else 0
        parts = lambda t, c: [_matrix(b.column(c)) for b in t.select([c]).to_batches() if b.num_rows]
        gaps = np.concatenate([_nearest(x, parts(block, "b")) for x in parts(rows, "v")]) if n else np.zeros(0)
        return pa.table({key: rows.column(key).slice(0, n), out: pa.array(gaps, pa.float64()), "_n": pa.array(np.full(n, block.num_rows), pa.int64())})

    met = left.groupBy("cell", "chunk", "part").cogroup(right.groupBy("cell", "chunk", "part")).applyInArrow(meet, shape)
    return met.groupBy(key).agg(F.min(out).alias(out), F.sum("_n").alias("_n")).select(*keep)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between two small sets of vectors, measured directly."""
    out = np.empty((len(x), len(y)))
    for j, one in enumerate(y):
        out[:, j] = np.linalg.norm(x - one, axis=1)
    return out


def _nearest(x: np.ndarray, bank: Sequence[np.ndarray]) -> np.ndarray:
    """Distance of every row to the nearest vector of a bank in parts, tile by tile; the closest candidate is re-measured directly."""
    out = np.empty(len(x))
    for start in range(0, len(x), TILE):
        part = x[start:start + TILE]
        least, best = np.full(len(part), np.inf), np.tile(bank[0][0], (len(part), 1))
        for some in bank:
            for first in range(0, len(some), TILE):
                tile = some[first:first + TILE]
                gaps = part @ tile.T
                gaps *= -2.0
                gaps += (tile * tile).sum(axis=1)
                near = gaps.argmin(axis=1)
                found = gaps[np.arange(len(part)), near]
                closer = found < least
                least[closer], best[closer] = found[closer], tile[near[closer]]
        out[start:start + TILE] = np.linalg.norm(part - best, axis=1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``TILE`` rows, none empty."""
    for batch in batches:
        for start in range(0, batch.num_rows, TILE):
            yield batch.slice(start, TILE)


def frame_scores(distances: DataFrame, frame: str, distance: str = "distance") -> DataFrame:
    """Largest patch distance of every frame."""
    return distances.groupBy(frame).agg(F.max(distance).alias("score"))


def bank_threshold(distances: DataFrame, distance: str = "distance", factor: float = 2.0) -> DataFrame:
    """``median, p99, threshold`` of nearest-neighbour distances; the threshold is ``factor`` medians."""
    q = group_quantiles(distances, [], distance, [0.5, 0.99], "_q")
    return q.select(F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p99"), (F.col("_q")[0] * factor).alias("threshold"))
