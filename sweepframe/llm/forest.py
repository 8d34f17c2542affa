"""Operator 11: near duplicates by MinHash signatures in an LSH forest, links confirmed on full sets.

Each set of shingles has ``TREES`` signature orders of ``DEPTH`` MinHash values. Sets that agree in the
first ``LEAST`` values of an order are a region. Two sets at similarity 0.8 meet in no region with
probability 6e-7, whatever the size of the table. Texts with equal sets are one node throughout.

1. A region of at most ``CROWD`` sets compares them all. In a larger one, every set is compared with one
   hub, so output stays linear in rows. Confirmed links give components.
2. Regions that still hold several components go deeper: their sets are sorted by the whole signature, and
   neighbours in that order, those with the longest common prefix, are compared. So the depth that
   decides adapts to how crowded a region is.
3. What such a region has not linked then is compared exactly: the sets outside its largest component
   against all its sets, in blocks of bounded size, each block pair in a task of its own. A task returns
   one link for each set and foreign component, never all pairs. Nothing is capped: this step is
   quadratic in the sets of a crowd that are alike but below the threshold, and in nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import connected_components
from .common import AT, located, on_files, store

SHINGLE = 4
SIMILAR = 0.8
TREES = 20
DEPTH = 8
LEAST = 3
CROWD = 8
NEIGHBOURS = 2
#: Shingles, and sets, of a block in step 3.
BLOCK = 300_000
BLOCK_SETS = 1_500
SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 10
_DRAWN = np.random.default_rng(SEED)
_MIX = _DRAWN.integers(0, 1 << 32, (2, TREES * DEPTH, 1), np.uint32)
_MIX[0] |= np.uint32(1)
_NAMED = _DRAWN.integers(0, 1 << 64, (2, TREES), np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends, k = np.cumsum(sizes + 1), min(shingle, len(words)) - 1
    starts, stops = (ends - sizes - 1)[: len(words) - k].tolist(), (ends[k:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, len(starts)))


def values(hashes: np.ndarray) -> np.ndarray:
    """``TREES x DEPTH`` MinHash values of a set."""
    least = np.full(TREES * DEPTH, (1 << 32) - 1, np.uint32)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for lo in range(0, len(folded), _CHUNK):
        np.minimum(least, (folded[lo:lo + _CHUNK] * _MIX[0] + _MIX[1]).min(axis=1), out=least)
    return least.reshape(TREES, DEPTH)


def regions_of(signature: np.ndarray) -> np.ndarray:
    """A name for each tree's prefix of ``LEAST`` values (longs)."""
    name = _NAMED[0].copy()
    for v in signature[:, :LEAST].T:
        name = (name ^ v) * _NAMED[1]
        name ^= name >> np.uint64(29)
    return name.view(np.int64)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set, a long; the near stage asks for it."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        total += np.unpackbits(hashes[lo:lo + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def _marks(shingle: int, prints: bool):
    kind = T.StructType([T.StructField(c, T.LongType()) for c in ("f", "n", "print")] + [T.StructField("keys", T.ArrayType(T.LongType()))])

    @F.arrow_udf(kind)
    def made(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            h = shingles(t.as_py(), shingle)
            name = int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))
            rows.append({"f": name, "n": len(h), "print": fingerprint(h) if prints else 0, "keys": regions_of(values(h)) if len(h) else []})
        return pa.array(rows, pa.struct([("f", pa.int64()), ("n", pa.int64()), ("print", pa.int64()), ("keys", pa.list_(pa.int64()))]))

    return made


def _sets(shingle: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def made(texts: pa.Array) -> pa.Array:
        return pa.array([shingles(t.as_py(), shingle).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return made


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("k", T.LongType()), T.StructField("path", T.BinaryType())])))
def _paths(sets: pa.Array) -> pa.Array:
    """For each tree the region's name, and the tree with its whole signature as sortable bytes."""
    out = []
    for h in sets:
        signature = values(h.values.to_numpy().view(np.uint64))
        ordered = signature.astype(">u4")
        out.append([{"k": k, "path": bytes([t]) + ordered[t].tobytes()} for t, k in enumerate(regions_of(signature).tolist())])
    return pa.array(out, pa.list_(pa.struct([("k", pa.int64()), ("path", pa.binary())])))


def _alike(x: Column, y: Column, similar: float) -> Column:
    """Sizes that allow the similarity; in whole hundredths, so that 0.8 is exact."""
    return 100 * F.least(x, y) >= round(100 * similar) * F.greatest(x, y)


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def verified(pairs: DataFrame, held: DataFrame, similar: float) -> DataFrame:
    """Pairs ``a, b`` of sets that are similar by their full sets in ``held`` (``f, h``).

    The hub of a crowd is the smaller name, ``a``: its pairs meet its set as short rows and are then
    spread by ``b``, so only one set travels with a pair.
    """
    side = lambda end, out: held.select(F.col("f").alias(end), F.col("h").alias(out))
    both = pairs.distinct().join(side("a", "ha"), "a").join(side("b", "hb"), "b")
    both = both.withColumn("common", F.size(F.array_intersect("ha", "hb")))
    return both.where(100 * F.col("common") >= round(100 * similar) * (F.size("ha") + F.size("hb") - F.col("common"))).select("a", "b")


def _components(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``f, c`` for every set: its component, or itself."""
    named = connected_components(links).select(F.col("node").alias("f"), F.col("component").alias("c"))
    return sets.select("f").join(named, "f", "left").select("f", F.coalesce("c", "f").alias("c"))


def _neighbours(rows: DataFrame, similar: float) -> DataFrame:
    """Pairs ``a, b`` of neighbours in the order of ``path`` that share a region but no component."""
    least, head = round(100 * similar), 1 + 4 * LEAST

    def walk(batches):
        past: list[tuple] = []
        for batch in batches:
            a, b = [], []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                f, n, c, path = row
                for g, m, d, other in past:
                    if path[:head] == other[:head] and c != d and 100 * min(n, m) >= least * max(n, m):
                        a.append(min(f, g))
                        b.append(max(f, g))
                past = [*past[1 - NEIGHBOURS:], row] if NEIGHBOURS > 1 else [row]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.select("f", "n", "c", "path").repartitionByRange(parts, "path", "f").sortWithinPartitions("path", "f")
    return ordered.mapInArrow(walk, "a bigint, b bigint")


def _common(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right."""
    (x, xs), (y, ys) = left, right
    names = np.intersect1d(x, y)
    spot = lambda v: np.minimum(np.searchsorted(names, v), max(0, len(names) - 1))
    total = np.zeros((len(xs) - 1, len(ys) - 1), np.float32)
    if not len(names):
        return total
    places = []
    for v, s in ((x, xs), (y, ys)):
        at = spot(v)
        real = names[at] == v
        row = np.repeat(np.arange(len(s) - 1), np.diff(s))[real]
        order = np.argsort(at[real], kind="stable")
        places.append((at[real][order], row[order]))
    for lo in range(0, len(names), 1024):
        dense = []
        for (at, row), s in zip(places, (xs, ys)):
            i, j = np.searchsorted(at, [lo, lo + 1024])
            one = np.zeros((len(s) - 1, min(1024, len(names) - lo)), np.float32)
            one[row[i:j], at[i:j] - lo] = 1
            dense.append(one)
        total += dense[0] @ dense[1].T
    return total


def _compare(similar: float):
    least = round(100 * similar)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 2
        if left.num_rows and right.num_rows:
            flat = lambda t: (lambda h: (h.values.to_numpy()[h.offsets[0].as_py():], h.offsets.to_numpy() - h.offsets[0].as_py()))(t.column("h").combine_chunks())
            (x, xs), (y, ys) = flat(left), flat(right)
            f, c, g, d = (t.column(k).to_numpy() for t in (left, right) for k in ("f", "c"))
            n, m, common = np.diff(xs)[:, None], np.diff(ys)[None, :], _common((x[: xs[-1]], xs), (y[: ys[-1]], ys))
            i, j = np.nonzero((100 * common >= least * (n + m - common)) & (c[:, None] != d[None, :]))
            # One link for each set and foreign component.
            _, first = np.unique(np.stack([i, d[j]]), axis=1, return_index=True)
            i, j = i[first], j[first]
            out = [np.minimum(f[i], g[j]), np.maximum(f[i], g[j])]
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return run


def _rest(rows: DataFrame, held: DataFrame, similar: float) -> DataFrame:
    """Links ``a, b`` in regions of ``rows`` (``k, f, n, c``) that hold several components, by comparing all their sets."""
    sizes = rows.groupBy("k", "c").agg(F.count(F.lit(1)).alias("s"), F.sum("n").alias("n"))
    parts = lambda s, n: F.ceil(F.greatest(s / BLOCK_SETS, n / BLOCK, F.lit(1)))
    main = sizes.groupBy("k").agg(F.max(F.struct("s", "c")).alias("main"), F.sum("s").alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    main = main.where("kinds > 1").select("k", F.col("main.c").alias("main"), "s", "n")
    outside = sizes.join(main.select("k", "main"), "k").where("c != main").groupBy("k").agg(F.sum("s").alias("os"), F.sum("n").alias("on"))
    plan = main.join(outside, "k").select("k", "main", parts(F.col("s"), F.col("n")).alias("right"), parts(F.col("os"), F.col("on")).alias("left"))
    full = rows.join(plan, "k").join(held.select("f", "h"), "f")
    dealt = lambda name: F.pmod(F.xxhash64("f", F.lit(name)), F.col(name))
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = full.where("c != main").select("k", "f", "c", "h", dealt("left").alias("i"), every("right").alias("j"))
    # Aliased, or the two sides of the cogroup would share their columns.
    right = full.select(*[F.col(c).alias(c) for c in ("k", "f", "c", "h")], every("left").alias("i"), dealt("right").alias("j"))
    found = left.groupBy("k", "i", "j").cogroup(right.groupBy("k", "i", "j"))
    return found.applyInArrow(_compare(similar), "a bigint, b bigint").distinct()


def jaccard_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR, more=None) -> DataFrame:
    """``__at, doc_id, n, component, best`` for every row of ``docs``.

    ``component`` names the rows that links of ``similar`` or more reach; ``best`` is its row with the
    smallest identifier (null last), then the first place, a struct with ``doc_id`` and ``__at``. Null,
    empty and wordless texts have the empty set, ``n`` is 0, and share a component of their own.
    Repeated rows are one set. An empty table gives no rows; other columns are ignored.
    ``more(sets)`` may add candidates ``a, b`` from ``f, print``, the sets' SimHash fingerprints.
    """
    docs = on_files(docs)
    rows = located(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked = store(rows.select(AT, "doc_id", _marks(shingle, more is not None)("text").alias("s")).select(AT, "doc_id", "s.*"), "signatures")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", AT))
    sets = store(marked.groupBy("f").agg(*[F.first(c).alias(c) for c in ("n", "print", "keys")], least.alias("best")), "sets")

    spread = sets.select("f", "n", F.explode("keys").alias("k"))
    met = store(spread.groupBy("k").agg(F.count(F.lit(1)).alias("m"), *[g(F.struct("f", "n")).alias(c) for c, g in (("hub", F.min), ("end", F.max))]).where("m > 1"), "regions")
    shared = store(spread.join(met.where("m > 2"), "k").select("k", "f", "n", "m", "hub"), "shared")
    calm = shared.where(F.col("m") <= CROWD)
    mates = calm.select("k", F.col("f").alias("g"), F.col("n").alias("o"))
    crowded = shared.where(F.col("m") > CROWD).select("k", "f", "n", "hub")
    pairs = met.where("m = 2").where(_alike(F.col("hub.n"), F.col("end.n"), similar)).select(F.col("hub.f").alias("a"), F.col("end.f").alias("b"))
    pairs = pairs.unionByName(calm.join(mates, (calm["k"] == mates["k"]) & (F.col("f") < F.col("g")) & _alike(F.col("n"), F.col("o"), similar))
                              .select(F.col("f").alias("a"), F.col("g").alias("b")))
    pairs = pairs.unionByName(crowded.where((F.col("f") != F.col("hub.f")) & _alike(F.col("n"), F.col("hub.n"), similar)).select(F.col("hub.f").alias("a"), F.col("f").alias("b")))
    if more is not None:
        pairs = pairs.unionByName(more(sets.select("f", "print")).select(*_pair(F.col("a"), F.col("b"))))
    pairs = store(pairs.distinct(), "candidates")

    # The full set of every node that is compared, from one row of it.
    ends = pairs.select(F.col("a").alias("f")).unionByName(pairs.select(F.col("b").alias("f"))).unionByName(crowded.select("f")).distinct()
    heads = sets.join(ends, "f", "left_semi").select("f", F.col(f"best.{AT}").alias(AT))
    held = store(located(docs, F.col(text).cast("string").alias("text")).join(heads, AT).select("f", _sets(shingle)("text").alias("h")), "shingles")
    links = store(verified(pairs, held, similar), "links")
    parts = store(_components(sets, links), "components")

    for step in ("neighbours", "rest"):
        within = crowded.select("k", "f", "n").join(parts, "f")
        still = within.groupBy("k").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x != y").select("k")
        open_rows = store(within.join(still, "k", "left_semi"), "open")
        if open_rows.isEmpty():
            break
        if step == "neighbours":
            whole = held.join(open_rows.select("f", "n", "c").distinct(), "f").select("f", "n", "c", F.explode(_paths("h")).alias("p"))
            ordered = whole.select("f", "n", "c", "p.k", "p.path").join(open_rows.select("k").distinct(), "k", "left_semi")
            new = store(verified(_neighbours(ordered, similar), held, similar), "links")
        else:
            new = store(_rest(open_rows, held, similar), "links")
        if not new.isEmpty():
            links = links.unionByName(new)
            parts = store(_components(sets, links), "components")

    placed = store(sets.select("f", "best").join(parts, "f"), "placed")
    best = placed.groupBy("c").agg(F.min("best").alias("best"))
    classes = placed.select("f", "c").join(best, "c")
    return marked.select(AT, "doc_id", "f", "n").join(classes, "f").select(AT, "doc_id", "n", F.col("c").alias("component"), "best")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Texts without words are linked with nothing: ``component_id`` is their own identifier. A row
    without identifier has that of its component, null if no member has one, and is kept only then.
    """
    own = F.col("n") == 0
    named = F.when(own, F.col("doc_id")).otherwise(F.col("best.doc_id"))
    found = jaccard_groups(docs, doc_id, text, shingle, similar)
    return found.select("doc_id", F.col("n").alias("n_shingles"), named.alias("component_id"), F.col("doc_id").eqNullSafe(named).alias("kept"))


def op11_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
