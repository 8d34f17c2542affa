"""Statistics on frame tables: proportions, bins, fits, clustering, correlation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.intervals import overlap, wilson
from ..plans import group_quantiles, ordered_columns, pin


def proportion(df: DataFrame, keys: Sequence[str], event: str) -> DataFrame:
    """``keys, n, k, rate, ci_lo, ci_hi`` of a 0/1 column; an empty group has NULL rate and bounds."""
    counts = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col(event).cast("bigint")), F.lit(0)).alias("k")
    )
    return with_rate(counts)


def with_rate(counts: DataFrame) -> DataFrame:
    """Rate and Wilson bounds next to ``n`` and ``k``."""
    lo, hi = wilson(F.col("k"), F.col("n"))
    return counts.withColumns({"rate": F.try_divide("k", "n"), "ci_lo": lo, "ci_hi": hi})


# Bins and fits ---------------------------------------------------------------------------


def bin_index(value: Column, edges: Column) -> Column:
    """Number of the ``[edge, next edge)`` bin of a value, NULL outside; ``edges`` ascending array."""
    below = F.size(F.filter(edges, lambda e: e <= value))
    return F.when(value.isNotNull() & (below >= 1) & (below < F.size(edges)), below - 1)


def dose_response(
    df: DataFrame, value: str, event: str, edges: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Event proportion per half-open bin; bins without rows do not appear."""
    array = F.array(*[F.lit(float(e)) for e in edges])
    binned = df.withColumn("bin", bin_index(F.col(value), array)).where(F.col("bin").isNotNull())
    return proportion(binned, [*keys, "bin"], event).withColumns({
        "lo": F.element_at(array, F.col("bin") + 1), "hi": F.element_at(array, F.col("bin") + 2),
    })


def longest_run(bins: DataFrame, keys: Sequence[str], ok: Column, strict: bool = True) -> DataFrame:
    """Per key the longest run of consecutive bins satisfying ``ok``, the earliest among equals.

    ``strict`` breaks a run at a bin that has no row; otherwise such bins are skipped over.
    Bins are an aggregate, a few rows per key, so plain windows over the key are fine.
    """
    keys = list(keys)
    position = F.col("bin") if strict else F.row_number().over(Window.partitionBy(*keys).orderBy("bin"))
    placed = bins.withColumn("_pos", position).where(ok)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_pos"))
    runs = (
        placed.withColumn("_run", F.col("_pos") - rank)
        .groupBy(*keys, "_run")
        .agg(
            F.count(F.lit(1)).alias("bins"), F.min("bin").alias("first_bin"), F.max("bin").alias("last_bin"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"), F.sum("k").alias("k"),
        )
    )
    best = F.min_by(
        F.struct("bins", "first_bin", "last_bin", "lo", "hi", "n", "k"), F.struct(-F.col("bins"), "first_bin")
    )
    return runs.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def fit_envelope(bins: DataFrame, target_rate: float, keys: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Widest contiguous range whose bins all keep their upper bound at or below the target.

    One row per key; ``fitted`` is false and the range NULL when no bin qualifies.
    """
    keys = list(keys) or ["_all"]
    source = bins if "_all" not in keys else bins.withColumn("_all", F.lit("all"))
    run = longest_run(source, keys, F.col("ci_hi") <= target_rate, strict)
    fit = with_rate(source.select(*keys).distinct().join(run, keys, "left"))
    return fit.select(
        *[k for k in keys if k != "_all"], F.col("bins").isNotNull().alias("fitted"),
        F.col("lo").alias("range_lo"), F.col("hi").alias("range_hi"),
        "bins", F.col("n").alias("frames"), F.col("k").alias("events"), "rate", "ci_lo", "ci_hi",
    )


def fit_quality_band(
    df: DataFrame, value: str, event: str, target_rate: float = 0.05, n_bins: int = 8,
    keys: Sequence[str] = (),
) -> DataFrame:
    """As :func:`fit_envelope` on quantile bins; a run touching an outer bin is open on that side."""
    keys = list(keys) or ["_all"]
    rows = df.select(
        *[F.lit("all").alias(k) if k == "_all" else F.col(k) for k in keys],
        F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("_x"),
        F.col(event).cast("bigint").alias("_e"),
    )
    usable = rows.where(F.col("_x").isNotNull())
    probs = [i / n_bins for i in range(n_bins + 1)]
    # One row per key, read three times below.
    cuts = pin(group_quantiles(usable, keys, "_x", probs, "_edges").withColumn("_edges", F.array_distinct("_edges")))
    top = F.element_at("_edges", -1)
    spot = F.when(F.col("_x") == top, F.size("_edges") - 2).otherwise(bin_index(F.col("_x"), F.col("_edges")))
    binned = usable.join(cuts, keys).where(F.size("_edges") >= 2).withColumn("bin", spot)
    bins = proportion(binned, [*keys, "bin"], "_e").join(cuts, keys).withColumns({
        "lo": F.element_at("_edges", F.col("bin") + 1), "hi": F.element_at("_edges", F.col("bin") + 2),
    })
    run = longest_run(bins, keys, F.col("ci_hi") <= target_rate, strict=False)
    ends = bins.groupBy(*keys).agg(F.min("bin").alias("_lowest"), F.max("bin").alias("_highest"))
    fit = with_rate(
        rows.select(*keys).distinct().join(cuts, keys, "left").join(ends, keys, "left").join(run, keys, "left")
    )
    note = (
        F.when(F.col("_edges").isNull(), "no data")
        .when(F.size("_edges") < 2, "metric is constant")
        .when(F.col("bins").isNull(), "no contiguous range meets the target")
    )
    return fit.select(
        *[k for k in keys if k != "_all"], F.col("bins").isNotNull().alias("fitted"), note.alias("note"),
        F.when(F.col("first_bin") > F.col("_lowest"), F.col("lo")).alias("band_min"),
        F.when(F.col("last_bin") < F.col("_highest"), F.col("hi")).alias("band_max"),
        "bins", F.col("n").alias("frames"), F.col("k").alias("events"), "rate",
    )


def quantile_curve(
    df: DataFrame, value: str, event: str, series: str, n_bins: int = 5, min_rows: int = 20
) -> DataFrame:
    """Event rate and mean covariate per quantile bin and series; bins closed on both sides."""
    usable = df.where(F.col(value).isNotNull())
    probs = [i / n_bins for i in range(n_bins + 1)]
    cuts = group_quantiles(usable, [], value, probs, "edges").scalar()
    inside = F.filter(
        F.sequence(F.lit(1), F.lit(n_bins)),
        lambda i: (F.element_at("_edges", i) <= F.col(value)) & (F.element_at("_edges", i + 1) >= F.col(value)),
    )
    placed = usable.withColumn("_edges", cuts).withColumn("bin", F.explode(inside)).withColumn("bin", F.col("bin") - 1)
    # A value on an inner edge belongs to both neighbours, as both bounds are closed.
    return placed.groupBy(series, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(event).cast("double")).alias("rate"),
        F.avg(value).alias("centre"),
    ).where(F.col("n") >= min_rows)


# Comparison of groups --------------------------------------------------------------------


def _stirling_error(n: Column) -> Column:
    """ln(n!) minus Stirling's formula; a short table below 16, a series above."""
    k = np.arange(1, 16)
    exact = np.cumsum(np.log(k)) - ((k + 0.5) * np.log(k) - k + 0.5 * np.log(2 * np.pi))
    table = F.array(*[F.lit(float(v)) for v in (0.0, *exact)])
    z = n.cast("double")
    square = z * z
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - (1 / 1188) / square) / square) / square) / square) / z
    return F.when(n < 16, F.get(table, n.cast("int"))).otherwise(series)


def _deviance(x: Column, m: Column) -> Column:
    """x ln(x / m) + m - x, as a series where the terms nearly cancel."""
    v = (x - m) / (x + m)
    square = v * v
    tail = F.lit(0.0)
    for k in range(9, 0, -1):
        tail = (tail + 1.0 / (2 * k + 1)) * square
    near = (x - m) * v + 2.0 * x * v * tail
    return F.when(F.abs(x - m) < 0.1 * (x + m), near).otherwise(F.when(x > 0, x * F.log(x / m)).otherwise(F.lit(0.0)) + m - x)


def _ln_binomial(x: Column, n: Column, p: Column) -> Column:
    """ln of the binomial probability in saddle-point form (Loader, 2000): full precision at any n."""
    q = 1.0 - p
    inside = (
        _stirling_error(n) - _stirling_error(x) - _stirling_error(n - x) - _deviance(x.cast("double"), n * p) - _deviance((n - x).cast("double"), n * q)
        - 0.5 * (F.lit(float(np.log(2 * np.pi))) + F.log(x.cast("double")) + F.log1p(-x / n))
    )
    ends = lambda share: F.when(share < 0.1, -_deviance(n.cast("double"), n * (1.0 - share)) - n * share).otherwise(n * F.log(1.0 - share))
    return F.when(n == 0, 0.0).when(x == 0, ends(p)).when(x == n, ends(q)).otherwise(inside)


def fisher_p(k_a: Column, n_a: Column, k_b: Column, n_b: Column) -> Column:
    """Two-sided Fisher exact p of a 2×2 table of counts.

    Tables as likely as the observed one or less are summed. On its own side they start at the
    observed table; on the other side at the point bisection finds, the probabilities falling away
    from the mode. Both sums run outward. The probabilities are log-concave, so terms fall at least
    as fast as they do from the mode, and 40 standard deviations outward from each start, not from
    the mean, leave nothing a double could show beside the first term.
    """
    hits, total = k_a + k_b, n_a + n_b
    first, last = F.greatest(F.lit(0).cast("bigint"), hits - n_b), F.least(hits, n_a)
    mode = F.least(last, F.greatest(first, F.floor((n_a + 1.0) * (hits + 1.0) / (total + 2.0)).cast("bigint")))
    given = F.struct(
        k_a.alias("k"), n_a.alias("n_a"), n_b.alias("n_b"), hits.alias("hits"), total.alias("total"), (hits / total).alias("share"),
        first.alias("first"), last.alias("last"), mode.alias("mode"),
    )
    p = _let(given, _both_tails)
    return F.when((n_a > 0) & (n_b > 0), p)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _both_tails(g: Column) -> Column:
    def ln_p(x: Column) -> Column:
        return _let(x, lambda v: _ln_binomial(v, g["n_a"], g["share"]) + _ln_binomial(g["hits"] - v, g["n_b"], g["share"])) - certain

    certain = _ln_binomial(g["hits"], g["total"], g["share"])
    spread = F.sqrt(g["n_a"] * g["share"] * (1 - g["share"]) * g["n_b"] / F.greatest(g["total"] - 1, F.lit(1)))
    above = g["k"] >= g["mode"]
    far = F.when(above, g["first"]).otherwise(g["last"])
    start = F.struct(ln_p(g["k"]).alias("seen"), (F.ceil(40.0 * spread) + 64).cast("bigint").alias("reach"), above.alias("above"), far.alias("far"))

    def tails(b: Column) -> Column:
        likely = lambda x: ln_p(x) > b["seen"] + 1e-7

        def halve(s: Column, _: Column) -> Column:
            middle = s["inner"] + F.floor((s["outer"] - s["inner"]) / 2).cast("bigint")
            step = _let(middle, lambda m: F.when(likely(m), F.struct(m.alias("inner"), s["outer"].alias("outer")))
                        .otherwise(F.struct(s["inner"].alias("inner"), m.alias("outer"))))
            return F.when(F.abs(s["outer"] - s["inner"]) <= 1, s).otherwise(step)

        found = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.struct(g["mode"].alias("inner"), b["far"].alias("outer")), halve, lambda s: s["outer"])
        outer = F.when(likely(b["far"]), b["far"] + F.when(b["above"], F.lit(-1)).otherwise(F.lit(1))).otherwise(found)

        def outward(x: Column, up: Column) -> Column:
            end = F.when(up, F.least(g["last"], x + b["reach"])).otherwise(F.greatest(g["first"], x - b["reach"]))
            inside = F.when(up, x <= g["last"]).otherwise(x >= g["first"])
            terms = F.when(inside, F.sequence(x, end)).otherwise(F.array().cast("array<bigint>"))
            return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + F.exp(ln_p(t)))

        p = outward(g["k"], b["above"]) + _let(outer.cast("bigint"), lambda x: outward(x, ~b["above"]))
        # A mode no likelier than the observed table belongs to the sum, and then everything does.
        everything = ~likely(g["mode"]) | (g["first"] == g["last"])
        return F.when(everything, F.lit(1.0)).otherwise(F.least(F.lit(1.0), p))

    return _let(start, tails)


def matched_band(
    df: DataFrame, group: str, value: str, event: str, band: tuple[float, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Groups compared inside ``[lo, hi)`` of the matched condition, one row per key.

    Overlap, reading and Fisher p are given when exactly two groups have rows there.
    """
    inside = df.where((F.col(value) >= band[0]) & (F.col(value) < band[1]))
    per = proportion(inside, [*keys, group], event)
    ordered = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("groups"),
        F.min_by(F.struct(group, "n", "k", "rate", "ci_lo", "ci_hi"), group).alias("a"),
        F.max_by(F.struct(group, "n", "k", "rate", "ci_lo", "ci_hi"), group).alias("b"),
    )
    two = F.col("groups") == 2
    a, b = F.col("a"), F.col("b")
    meets = overlap(a["ci_lo"], a["ci_hi"], b["ci_lo"], b["ci_hi"])
    flat = [side[c].alias(f"{c}_{tag}") for side, tag in ((a, "a"), (b, "b")) for c in (group, "n", "k", "rate")]
    return ordered.select(
        *keys, "groups", *flat,
        F.when(two, meets).alias("intervals_overlap"),
        F.when(two & meets, "rates overlap").when(two, "rates separate").alias("reading"),
        F.when(two, fisher_p(a["k"], a["n"], b["k"], b["n"])).alias("fisher_p"),
    )


# Clustered data --------------------------------------------------------------------------


def icc(df: DataFrame, cluster: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """ICC(1), design effect and effective sample size; NULL with fewer than two clusters."""
    x = F.col(value).cast("double")
    per = df.where(x.isNotNull()).groupBy(*keys, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), (F.var_pop(x) * F.count(F.lit(1))).alias("ss")
    )
    n = F.col("n").cast("double")
    sums = per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("naive_n"), F.sum(n * n).alias("_n2"),
        F.sum("ss").alias("_within"),
        (F.sum(n * F.col("m") * F.col("m")) - F.try_divide(F.sum(n * F.col("m")) * F.sum(n * F.col("m")), F.sum(n))).alias("_between"),
    )
    k, total = F.col("clusters").cast("double"), F.col("naive_n").cast("double")
    usable = (k >= 2) & (total > k)
    ms_b = F.try_divide(F.col("_between"), k - 1)
    ms_w = F.try_divide(F.col("_within"), total - k)
    n0 = F.try_divide(total - F.col("_n2") / total, k - 1)
    spread = ms_b + (n0 - 1) * ms_w
    raw = F.when(spread > 0, (ms_b - ms_w) / spread).otherwise(0.0)
    out = sums.withColumn("icc", F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))))
    deff = 1.0 + (total / k - 1.0) * F.col("icc")
    return out.select(
        *keys, "clusters", "naive_n", (total / k).alias("mean_cluster_size"), "icc",
        deff.alias("design_effect"), (total / deff).alias("effective_n"),
    )


#: Draws are values of a cubic over this prime, so that any engine can repeat them with whole numbers.
DRAW_PRIME = (1 << 31) - 1
#: Clusters of one key that a task holds; 16 bytes each.
HELD_CLUSTERS = 100_000
_CHUNK = 125


def draw_coefficients(seed: int, replicates: int) -> list[tuple[int, ...]]:
    """Four coefficients for each replicate, from md5 as in :func:`plans.seeded.draw`."""
    word = lambda r, j: int(hashlib.md5(f"{seed}|{r}/{j}".encode()).hexdigest()[:12], 16) % DRAW_PRIME
    return [tuple(word(r, j) for j in range(4)) for r in range(replicates)]


def _drawn(coefficients, draw):
    """Value of the cubic at a draw, below the prime; for columns and for arrays of whole numbers."""
    a, b, c, d = coefficients
    return (((a * draw + b) % DRAW_PRIME * draw + c) % DRAW_PRIME * draw + d) % DRAW_PRIME


def cluster_bootstrap(
    df: DataFrame, cluster: str, event: str, replicates: int = 2000, seed: int = 0, keys: Sequence[str] = (), held: int = HELD_CLUSTERS
) -> DataFrame:
    """``keys, point, ci_lo, ci_hi, clusters``: interval of the event rate when whole clusters are drawn with replacement.

    Only per-cluster sums are resampled. A replicate makes as many draws as there are clusters. Draw
    ``i`` is the value at ``i`` of a cubic with coefficients from md5 of seed and replicate, scaled to a
    cluster's place in ascending order. Where every key has at most ``held`` clusters, their sums travel
    as one array and a task adds up a run of replicates; beyond it draws meet clusters in a join, with the same result.
    """
    keys = list(keys)
    per = df.groupBy(*keys, cluster).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(event).cast("double")).alias("s")
    )
    numbered = pin(ordered_columns(per, keys, [cluster], sums={"_rank": F.lit(1)}).select(
        *keys, (F.col("_rank") - 1).alias("_no"), "n", "s"
    ))
    whole = numbered.groupBy(*keys).agg(
        (F.sum("s") / F.sum("n")).alias("point"), F.count(F.lit(1)).alias("clusters"),
    )
    most = whole.agg(F.max("clusters")).first()[0] or 0
    drawn = draw_coefficients(seed, replicates)
    rates = _held_rates if most <= held else _joined_rates
    bounds = rates(numbered, whole, keys, drawn).groupBy(*keys).agg(F.expr("percentile(rate, array(0.025, 0.975))").alias("_q"))
    out = whole.join(bounds, keys) if keys else whole.withColumn("_q", bounds.scalar())
    return out.select(
        *keys, "point", F.when(F.col("clusters") >= 2, F.col("_q")[0]).alias("ci_lo"),
        F.when(F.col("clusters") >= 2, F.col("_q")[1]).alias("ci_hi"), "clusters",
    )


def _held_rates(numbered: DataFrame, whole: DataFrame, keys: list[str], drawn: list[tuple[int, ...]]) -> DataFrame:
    """``keys, rate`` of every replicate; a row holds the sums of all clusters of a key."""
    held = numbered.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_no", "n", "s"))).alias("_c"))
    starts = F.explode(F.sequence(F.lit(0), F.lit(len(drawn) - 1), F.lit(_CHUNK)))
    runs = held.select(*keys, F.col("_c.n").alias("_n"), F.col("_c.s").alias("_s"), starts.alias("_from"))
    kinds = dict(numbered.dtypes)

    def add(batches):
        for batch in batches:
            at, rates = [], []
            for i, (n, s, start) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("_n", "_s", "_from")])):
                n, s, draws = np.array(n, np.float64), np.array([0.0 if v is None else v for v in s]), np.arange(len(n), dtype=np.int64)
                for coefficients in drawn[start:start + _CHUNK]:
                    pick = _drawn(coefficients, draws) * len(n) // DRAW_PRIME
                    at.append(i)
                    rates.append(s[pick].sum() / n[pick].sum())
            few = batch.select(keys).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*few.columns, pa.array(rates, pa.float64())], names=[*keys, "rate"])

    return runs.repartition(*keys, "_from").mapInArrow(add, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "rate double"]))


def _joined_rates(numbered: DataFrame, whole: DataFrame, keys: list[str], drawn: list[tuple[int, ...]]) -> DataFrame:
    """The same rates by joining every draw with the cluster it picks.

    Draws are the clusters times the replicates, but to the plan they look as small as the clusters, so every join says its way:
    draws are never sent whole, they are dealt over tasks before they are spread, and meet the clusters of a task.
    """
    spark = numbered.sparkSession
    table = spark.createDataFrame([(r, *c) for r, c in enumerate(drawn)], "replicate int, _a long, _b long, _c long, _d long")
    sizes = whole.select(*keys, "clusters")
    sized = numbered.join(sizes.hint("merge"), keys) if keys else numbered.withColumn("clusters", sizes.select("clusters").scalar())
    dealt = sized.select(*keys, F.col("_no").alias("_draw"), "clusters").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_draw")
    draws = dealt.crossJoin(F.broadcast(table))
    value = _drawn([F.col(c) for c in ("_a", "_b", "_c", "_d")], F.col("_draw"))
    picked = draws.select(*keys, "replicate", F.call_function("div", value * F.col("clusters"), F.lit(DRAW_PRIME)).alias("_no"))
    return picked.join(numbered.hint("shuffle_hash"), [*keys, "_no"]).groupBy(*keys, "replicate").agg((F.sum("s") / F.sum("n")).alias("rate"))


def rate_spread(rates: DataFrame, rate: str = "rate", subset: Column | None = None) -> DataFrame:
    """Lowest, highest and difference of per-cluster rates, over all and over a subset."""
    out = [
        F.min(rate).alias("min_rate"), F.max(rate).alias("max_rate"), (F.max(rate) - F.min(rate)).alias("spread"),
    ]
    if subset is not None:
        inside = F.when(subset, F.col(rate))
        out.append((F.max(inside) - F.min(inside)).alias("subset_spread"))
    return rates.agg(*out)


# Correlation -----------------------------------------------------------------------------


def _two_sided_t_tail(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|) by the continued fraction of the incomplete beta function."""
    from math import lgamma

    def tail(tv: float, d: float) -> float:
        if not (np.isfinite(tv) and d > 0):
            return float("nan") if np.isnan(tv) else 0.0
        x, a, b = d / (d + tv * tv), d / 2.0, 0.5
        flip = x > (a + 1) / (a + b + 2)
        if flip:
            x, a, b = 1 - x, b, a
        if x <= 0:
            return 1.0 if flip else 0.0
        front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
        c, dd = 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
        value = dd
        for m in range(1, 1000):
            for num in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                dd = 1.0 / ((1 + num * dd) or 1e-300)
                c = (1 + num / c) or 1e-300
                step = dd * c
                value *= step
            if abs(step - 1) < 1e-15:
                break
        part = front * value
        return 1 - part if flip else part

    return np.array([tail(float(a), float(b)) for a, b in zip(t, dof)])


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation; runs on finished (group, condition) rows only."""
    r, dof = r.to_numpy(float), n.to_numpy(float) - 2
    with np.errstate(divide="ignore", invalid="ignore"):
        t = r * np.sqrt(dof / ((1 - r) * (1 + r)))
    p = pd.Series(_two_sided_t_tail(t, dof), index=n.index)
    return p.astype(object).where(~np.isnan(r), None)


def point_biserial(df: DataFrame, event: str, conditions: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, condition, n, r, mean_when_event, mean_when_clean``: all conditions in one aggregate.

    ``r`` is NULL for a single-class outcome, a constant condition or fewer than 3 rows.
    Add p-values with :func:`correlation_p` on the result.
    """
    y = F.col(event).cast("double")
    entries = []
    for c in conditions:
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        outcome = F.when(x.isNotNull(), y)
        r = F.try_divide(F.covar_pop(outcome, x), F.stddev_pop(F.when(outcome.isNotNull(), x)) * F.stddev_pop(outcome))
        entries.append(F.struct(
            F.lit(c).alias("condition"), F.count(x).alias("n"),
            F.when(
                (F.min(outcome) < F.max(outcome)) & (F.min(x) < F.max(x)) & (F.count(x) >= 3), r
            ).alias("r"),
            F.avg(F.when(y == 1, x)).alias("mean_when_event"),
            F.avg(F.when(y == 0, x)).alias("mean_when_clean"),
        ))
    return df.groupBy(*keys).agg(F.array(*entries).alias("_e")).select(*keys, F.inline("_e"))


def within_cluster_tests(df: DataFrame, cluster: str, event: str, conditions: Sequence[str]) -> DataFrame:
    """Correlations inside each cluster; a cluster without events says nothing and is labelled so."""
    events = df.groupBy(cluster).agg(F.sum(F.col(event).cast("bigint")).alias("events"))
    tests = point_biserial(df, event, conditions, [cluster]).join(events, cluster)
    return tests.withColumns({
        "r": F.when(F.col("events") > 0, F.col("r")),
        "verdict": F.when(F.col("events") == 0, "no events, uninformative").otherwise("tested"),
    })


def opposed_pairs(correlations: DataFrame, model: str = "model", r: str = "r", condition: str = "condition") -> DataFrame:
    """Pairs of models whose correlations with the same condition have opposite sign.

    Only models of opposite sign meet: the positive side joins the negative side of its condition.
    """
    up = correlations.where(F.col(r) > 0).select(condition, F.col(model).alias("p"), F.col(r).alias("rp"))
    down = correlations.where(F.col(r) < 0).select(condition, F.col(model).alias("q"), F.col(r).alias("rq"))
    pairs = up.join(down, condition)
    first = F.col("p") < F.col("q")
    return pairs.select(
        condition, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"),
        F.when(first, F.col("rp")).otherwise(F.col("rq")).alias("r_a"),
        F.when(first, F.col("rq")).otherwise(F.col("rp")).alias("r_b"),
    )


def mediation(df: DataFrame, predictors: Sequence[str], targets: Sequence[str], min_rows: int = 30) -> DataFrame:
    """Least squares of each target on the predictors: ``target, n, r2, coef_<predictor>``.

    The fit is MLlib's normal-equation solver, one pass of partial sums per target. Fewer
    complete rows than ``min_rows`` give a row without estimates.
    """
    spark = df.sparkSession
    complete = df.select(*[F.col(c).cast("double").alias(c) for c in (*predictors, *targets)]).dropna()
    rows = []
    assembled = VectorAssembler(inputCols=list(predictors), outputCol="_x").transform(complete)
    n = complete.count()
    for target in targets:
        if n < min_rows:
            rows.append((target, n, None, *[None] * len(predictors)))
            continue
        model = LinearRegression(featuresCol="_x", labelCol=target, solver="normal").fit(assembled)
        rows.append((target, n, float(model.summary.r2), *[float(c) for c in model.coefficients]))
    shape = "target STRING, n BIGINT, r2 DOUBLE, " + ", ".join(f"coef_{p} DOUBLE" for p in predictors)
    return spark.createDataFrame(rows, shape)


# Descriptive -----------------------------------------------------------------------------

STATISTICS = ("mean", "min", "max", "std", "median", "count")


def column_stats(df: DataFrame, column: str, keys: Sequence[str] = (), statistic: str = "all") -> DataFrame:
    """Mean, min, max, std, median and count of one column, or one of them.

    An unknown column or statistic gives a one-row ``error`` table naming the choices.
    """
    def error(text: str, choices: Sequence[str]) -> DataFrame:
        return df.sparkSession.createDataFrame([(text, list(choices))], "error STRING, choices ARRAY<STRING>")

    if column not in df.columns:
        return error(f"unknown column {column}", df.columns)
    if statistic != "all" and statistic not in STATISTICS:
        return error(f"unknown statistic {statistic}", STATISTICS)
    wanted = STATISTICS if statistic == "all" else (statistic,)
    x = F.col(column)
    built = {
        "mean": F.avg(x), "min": F.min(x), "max": F.max(x), "std": F.stddev_samp(x), "count": F.count(x),
    }
    aggs = [built[s].alias(s) for s in wanted if s in built]
    keys = list(keys)
    out = df.groupBy(*keys).agg(*(aggs or [F.count(x).alias("_n")]))
    if "median" in wanted:
        middle = group_quantiles(df, keys, column, [0.5], "_m")
        if keys:
            out = out.join(middle, keys, "left").withColumn("median", F.col("_m")[0])
        else:
            out = out.withColumn("median", middle.scalar()[0])
    return out.select(*keys, *wanted)


def extreme_clusters(df: DataFrame, cluster: str, day: str, event: str) -> DataFrame:
    """Cluster with the highest event rate, and the cleanest other cluster of the same day."""
    per = df.groupBy(day, cluster).agg(F.avg(F.col(event).cast("double")).alias("rate"))
    worst = per.agg(F.min_by(F.struct(day, cluster, "rate"), F.struct(-F.col("rate"), cluster)).alias("w"))
    pool = per.join(worst.select(F.col("w")[day].alias(day), F.col("w")[cluster].alias("_worst")), day)
    clean = pool.where(F.col(cluster) != F.col("_worst")).agg(
        F.min_by(F.struct(cluster, "rate"), F.struct("rate", cluster)).alias("c")
    )
    return worst.withColumn("c", clean.scalar()).select(
        F.col("w")[day].alias(day), F.col("w")[cluster].alias("worst"), F.col("w")["rate"].alias("worst_rate"),
        F.col("c")[cluster].alias("cleanest"), F.col("c")["rate"].alias("cleanest_rate"),
    )


def evenly_spaced(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """``n`` rows at equal steps from the first to the last in the given order."""
    numbered = ordered_columns(df, [], order, sums={"_rank": F.lit(1)})
    total = df.agg(F.count(F.lit(1)))
    step = F.floor(F.col("i") * (total.scalar() - 1) / F.lit(max(n - 1, 1)))
    spots = df.sparkSession.range(n).withColumnRenamed("id", "i").select(
        "i", (step + 1).cast("bigint").alias("_rank")
    )
    return numbered.join(F.broadcast(spots), "_rank").drop("_rank")
