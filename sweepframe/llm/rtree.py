"""Operator 12: hard negatives by a sort-tile-recursive R-tree over quantised vectors.

Index, over every row: label, then the first coordinates, cut the table into tiles by quantiles of what
lies in the tile before (partial aggregates, nothing is sorted as a whole). A tile is a page of about
``PAGE`` rows; rows that tie in all of these coordinates are dealt to as many pages as they fill. Within
its task a page is tiled on by further coordinates into leaves of ``LEAF`` rows, and nodes of ``FAN``
leaves. Every node has a minimum bounding box, in which the label is one more side.

Search: for a query vector and a box, the sum over coordinates of the larger (smaller) of both products
bounds the inner product from above (below). A query asks for the best rows within score windows. It is
answered from its own page first, which gives a first k-th score for each window. Then a directory of at
most ``DIRECTORY`` boxes, the only thing that is sent to all workers, names the pages that can still add
to it. In a page a best-first queue takes the node with the highest score its windows leave possible, and
drops boxes of the wrong label, outside every window, or strictly below its k-th score, so ties stay.

Queries travel to pages in blocks of ``QUERIES``; a task holds one page and one block.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
PAGE = 8192
LEAF = 128
FAN = 8
LEVELS = 3
DIRECTORY = 4096
QUERIES = 2048
#: Scaled components reach less than this, so that inner products are exact in 64 bits.
LARGEST = 1 << 25
_FAR = 1 << 62
_QUERY = "qid bigint, home bigint, label bigint, dims int, q array<int>, tops array<struct<w:int,low:bigint,high:bigint,floor:bigint>>"


def quantised(vectors: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> DataFrame:
    """``row, vec_id, label, dims, q`` of the rows that take part, stored; ``row`` names a row."""
    x = F.transform(F.col(vector), lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    whole = F.forall(F.col(vector), lambda v: v.isNotNull() & (F.abs(F.lit(float(scale)) * v.cast("double")) < LARGEST))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.when(whole, x).cast("array<int>").alias("q"))
    rows = rows.where(F.col("label").isNotNull() & F.col("q").isNotNull())
    return store(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.size("q").alias("dims"), "q"), "vectors")


def tiled(rows: DataFrame, page: int = PAGE) -> DataFrame:
    """``rows`` with ``t0, t1, ...``, the slabs of each level, and ``page``, which names their tile, stored."""
    slabs = max(1, int(np.ceil(np.ceil(max(1, rows.count()) / page) ** (1 / LEVELS))))
    keys = ["dims"]
    for level in range(LEVELS if slabs > 1 else 0):
        side = F.col("label") if level == 0 else F.coalesce(F.get("q", F.lit(level - 1)).cast("bigint"), F.lit(0))
        marks = F.percentile_approx(side, F.array(*[F.lit(i / slabs) for i in range(1, slabs)]), F.lit(1000))
        edges = rows.groupBy(*keys).agg(marks.alias("edges"))
        rows = rows.join(edges, keys).withColumn(f"t{level}", F.size(F.filter("edges", lambda e, s=side: e < s))).drop("edges")
        keys.append(f"t{level}")
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / page).alias("parts"))
    rows = rows.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    return store(rows.withColumn("page", F.xxhash64(*keys, "part")), "tiles")


def tiles(keys: list[np.ndarray], leaf: int) -> list[np.ndarray]:
    """Rows of each leaf: sorted by the first key and cut into slabs, each of them by the next, and so on."""
    def cut(some: np.ndarray, level: int) -> list[np.ndarray]:
        need = -(-len(some) // leaf)
        if need <= 1:
            return [some] if len(some) else []
        some = some[np.argsort(keys[level][some], kind="stable")]
        slabs = need if level == len(keys) - 1 else int(np.ceil(need ** (1 / (len(keys) - level))))
        size = -(-need // slabs) * leaf
        return [x for lo in range(0, len(some), size) for x in ([some[lo:lo + size]] if level == len(keys) - 1 else cut(some[lo:lo + size], level + 1))]

    return cut(np.arange(len(keys[0])), 0)


_PAGE = ("page bigint, dims int, rows array<bigint>, ids array<bigint>, labels array<bigint>, q binary, leaves array<int>, "
         "low array<int>, high array<int>, label_low bigint, label_high bigint")


def _packed(leaf: int):
    def build(table: pa.Table) -> pa.Table:
        n, dims = table.num_rows, table.column("dims")[0].as_py()
        q = table.column("q").combine_chunks().flatten().to_numpy().reshape(n, dims)
        labels = table.column("label").to_numpy()
        more = [q[:, min(c, dims - 1)] for c in (LEVELS - 1, LEVELS)] if dims else []
        parts = tiles([labels, *more], leaf)
        order = np.concatenate(parts)
        q = q[order]
        take = lambda c: table.column(c).take(pa.array(order))
        row = {"page": table.column("page")[0].as_py(), "dims": dims, "rows": take("row").to_pylist(), "ids": take("vec_id").to_pylist(), "labels": labels[order].tolist(),
               "q": q.astype("<i4").tobytes(), "leaves": np.cumsum([0, *map(len, parts)]).tolist(), "low": q.min(axis=0), "high": q.max(axis=0),
               "label_low": int(labels.min()), "label_high": int(labels.max())}
        kinds = [("page", pa.int64()), ("dims", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("rows", "ids", "labels")], ("q", pa.binary()),
                 *[(c, pa.list_(pa.int32())) for c in ("leaves", "low", "high")], ("label_low", pa.int64()), ("label_high", pa.int64())]
        return pa.Table.from_pylist([row], pa.schema(kinds))

    return build


def index(rows: DataFrame, page: int = PAGE, leaf: int = LEAF) -> DataFrame:
    """One row per page of ``tiled`` rows: its vectors in leaf order, where leaves begin, and its box."""
    found = rows.select("page", "dims", "row", "vec_id", "label", "q").groupBy("page", "dims").applyInArrow(_packed(leaf), _PAGE)
    return store(found, "pages")


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each query (rows) with any vector of each box (columns)."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Tree:
    """The nodes of one page: its leaves, then the nodes above them."""

    def __init__(self, page: dict, fan: int = FAN):
        n, d = len(page["rows"]), page["dims"]
        q = np.frombuffer(page["q"], "<i4").reshape(n, d)
        # Doubles are exact while sums stay below 2**53.
        self.kind = np.float64 if d * int(np.abs(q).max(initial=0)) ** 2 < 1 << 53 else np.int64
        self.q, self.labels, self.rows, self.ids = q.astype(self.kind), np.array(page["labels"], np.int64), np.array(page["rows"], np.int64), page["ids"]
        self.order = np.lexsort([self.rows, [0 if i is None else i for i in self.ids], [i is None for i in self.ids]]).argsort()
        starts = np.array(page["leaves"][:-1])
        self.leaves = list(zip(page["leaves"], page["leaves"][1:]))
        low, high = np.minimum.reduceat(self.q, starts), np.maximum.reduceat(self.q, starts)
        lab = np.minimum.reduceat(self.labels, starts), np.maximum.reduceat(self.labels, starts)
        groups = np.arange(0, len(starts), fan)
        self.children = [range(g, min(g + fan, len(starts))) for g in groups]
        over = lambda f, v: np.concatenate([v, f.reduceat(v, groups)])
        self.low, self.high = over(np.minimum, low), over(np.maximum, high)
        self.label_low, self.label_high = over(np.minimum, lab[0]), over(np.maximum, lab[1])

    def search(self, queries: list[dict], same: bool, k: int) -> list[tuple]:
        """``(qid, w, row, id, score)`` of the best ``k`` rows of this page in every window of every query."""
        found = []
        vectors = np.array([x["q"] for x in queries], self.kind).reshape(len(queries), self.q.shape[1])
        if self.kind is np.float64 and self.q.shape[1] * int(np.abs(self.q).max(initial=0)) * int(np.abs(vectors).max(initial=0)) >= 1 << 53:
            self.kind, self.q, self.low, self.high, vectors = np.int64, *(v.astype(np.int64) for v in (self.q, self.low, self.high, vectors))
        least, most = bounds(vectors, self.low, self.high)
        for query, vector, lo, up in zip(queries, vectors, least, most):
            found += self._one(query, vector, lo, up, same, k)
        return found

    def _one(self, query: dict, vector: np.ndarray, lo: np.ndarray, up: np.ndarray, same: bool, k: int) -> list[tuple]:
        label, tops = query["label"], query["tops"]
        high = np.array([t["high"] for t in tops])
        # Scores from here on may still enter a window: its lower end, or its k-th score.
        floor = np.array([max(t["low"], t["floor"]) for t in tops])
        fits = (self.label_low <= label) & (label <= self.label_high) if same else ~((self.label_low == label) & (label == self.label_high))
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, self.kind), np.zeros(0, np.int64))] * len(tops)
        queue: list[tuple] = []

        def offer(nodes) -> None:
            for node in nodes:
                if fits[node]:
                    could = np.minimum(up[node], high)[(up[node] >= floor) & (lo[node] <= high)]
                    if len(could):
                        heapq.heappush(queue, (-could.max(), node))

        leaves = len(self.leaves)
        offer(range(leaves, leaves + len(self.children)))
        while queue:
            _, node = heapq.heappop(queue)
            if not ((up[node] >= floor) & (lo[node] <= high)).any():
                continue
            if node >= leaves:
                offer(self.children[node - leaves])
                continue
            i, j = self.leaves[node]
            scores = self.q[i:j] @ vector
            mine = self.labels[i:j] == label
            mine = mine & (self.rows[i:j] != query["qid"]) if same else ~mine
            fit = mine & (scores >= floor[:, None]) & (scores <= high[:, None])
            for w in np.flatnonzero(fit.any(axis=1)):
                at = np.flatnonzero(fit[w])
                s, r = np.concatenate([best[w][0], scores[at]]), np.concatenate([best[w][1], at + i])
                top = np.lexsort([self.order[r], -s])[:k]
                best[w] = s[top], r[top]
                if len(top) == k:
                    floor[w] = max(floor[w], int(s[top[-1]]))
        return [(query["qid"], t["w"], int(self.rows[r]), self.ids[r], int(s)) for t, (ss, rs) in zip(tops, best) for s, r in zip(ss, rs)]


_HIT = "qid bigint, w int, row bigint, id bigint, score bigint"


def _searched(routed: DataFrame, pages: DataFrame, blocks: int, same: bool, k: int) -> DataFrame:
    """Hits ``qid, w, row, id, score`` of queries at the pages named by their column ``page``."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        hits = Tree(left.to_pylist()[0]).search(right.to_pylist(), same, k) if left.num_rows and right.num_rows else []
        cols = list(zip(*hits)) or [()] * 5
        return pa.table({c: pa.array(v, pa.int32() if c == "w" else pa.int64()) for c, v in zip(("qid", "w", "row", "id", "score"), cols)})

    held = pages.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumnRenamed("page", "at")
    asked = routed.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int"))
    return held.groupBy("at", "block").cogroup(asked.groupBy("page", "block")).applyInArrow(run, _HIT)


def _directory(rows: DataFrame, pages: DataFrame, most: int) -> tuple[DataFrame, list]:
    """``node, page`` of all pages, and the boxes of the finest nodes of which there are at most ``most``."""
    keys = ["dims", *[c for c in rows.columns if c[0] == "t" and c[1:].isdigit()]]
    names = store(rows.select(*keys, "page").distinct(), "page-names")
    for cut in (["page"], *[keys[:i] for i in range(len(keys), 0, -1)]):
        if names.select(*cut).distinct().limit(most + 1).count() <= most:
            break
    named = names.select(F.xxhash64(*cut).alias("node"), "page")
    sides = pages.join(named, "page").select("node", "dims", "label_low", "label_high", F.posexplode_outer(F.arrays_zip("low", "high")).alias("at", "side"))
    sides = sides.groupBy("node", "dims", "at").agg(F.min("side.low").alias("low"), F.max("side.high").alias("high"), F.min("label_low").alias("a"), F.max("label_high").alias("b"))
    boxes = sides.groupBy("node", "dims").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.array_sort(F.collect_list(F.struct("at", "low", "high"))).alias("sides"))
    return named, boxes.collect()  # at most `most` rows


def _routed(queries: DataFrame, named: DataFrame, boxes: list, same: bool) -> DataFrame:
    """``queries`` with ``page``: every page but their own that the directory leaves possible."""
    sets: dict[int, tuple] = {}
    for dims in {b["dims"] for b in boxes}:
        mine = [b for b in boxes if b["dims"] == dims]
        box = lambda c: np.array([[s[c] for s in b["sides"]][:dims] for b in mine], np.int64).reshape(len(mine), dims)  # noqa: B023, E731
        sets[dims] = np.array([b["node"] for b in mine]), box("low"), box("high"), np.array([b["a"] for b in mine]), np.array([b["b"] for b in mine])
    shared = queries.sparkSession.sparkContext.broadcast(sets)

    def route(batches):
        for batch in batches:
            at, nodes = [], []
            for i, x in enumerate(batch.to_pylist()):
                names, low, high, first, last = shared.value[x["dims"]]
                least, most = (v[0] for v in bounds(np.array([x["q"]], np.int64).reshape(1, x["dims"]), low, high))
                fits = (first <= x["label"]) & (x["label"] <= last) if same else ~((first == x["label"]) & (last == x["label"]))
                windows = [(most >= max(t["low"], t["floor"])) & (least <= t["high"]) for t in x["tops"]]
                go = names[fits & np.any(windows, axis=0)]
                at += [i] * len(go)
                nodes += go.tolist()
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at, pa.int64())).columns, pa.array(nodes, pa.int64())], names=[*batch.schema.names, "node"])

    return queries.mapInArrow(route, _QUERY + ", node bigint").join(named, "node").where(F.col("page") != F.col("home")).drop("node")


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` hits of every window with their ``rank``; highest score first, then the smallest identifier, null last."""
    order = Window.partitionBy("qid", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top(queries: DataFrame, pages: DataFrame, directory: tuple[DataFrame, list], blocks: int, same: bool, k: int) -> DataFrame:
    """The best ``k`` rows ``qid, w, row, id, score, rank`` in every window of ``queries``, over all pages."""
    queries = store(queries, "queries")
    own = store(_searched(queries.withColumn("page", F.col("home")), pages, blocks, same, k), "own-page")
    full = own.groupBy("qid", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    floors = full.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("floors"))  # a few windows each
    raised = F.transform("tops", lambda t: F.struct(t["w"].alias("w"), t["low"].alias("low"), t["high"].alias("high"), F.coalesce(F.col("floors")[t["w"]], t["floor"]).alias("floor")))
    asked = queries.join(floors, "qid", "left").select("qid", "home", "label", "dims", "q", raised.alias("tops"))
    others = _searched(_routed(asked, *directory, same), pages, blocks, same, k)
    return store(_best(own.unionByName(others), k), "top")


def hard_negatives(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, page: int = PAGE, leaf: int = LEAF, directory: int = DIRECTORY) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Anchors are rows that satisfy ``anchor``, a condition on ``vec_id``. Components are scaled and
    rounded down; a score is the integer inner product with the anchor. The first ``positives`` other
    rows of its label are its positives; for each, the first ``negatives`` rows of other labels with
    ``low`` to ``high`` percent of the positive's score. Higher scores come first, then smaller
    identifiers (null last), then the earlier row.

    Rows with a null label or vector, or with a component that is null, not finite or at least 2**25
    once scaled, take no part. Vectors of another length than the anchor's aren't compared with it.
    Repeated rows count each, and repeated anchors give rows each. An empty table, or anchors without
    positives or negatives, give no rows; other columns are ignored.
    """
    rows = tiled(quantised(vectors, vec_id, vector, label, scale), page)
    pages = index(rows, page, leaf)
    nodes = _directory(rows, pages, directory)
    anchors = store(rows.withColumnRenamed("vec_id", vec_id).where(anchor).withColumnRenamed(vec_id, "vec_id"), "anchors")
    blocks = max(1, -(-anchors.count() // QUERIES))
    window = lambda w, lo, hi: F.struct(w.cast("int").alias("w"), lo.cast("bigint").alias("low"), hi.cast("bigint").alias("high"), F.lit(-_FAR).alias("floor"))
    asked = anchors.select(F.col("row").alias("qid"), F.col("page").alias("home"), "label", "dims", "q")
    near = _top(asked.withColumn("tops", F.array(window(F.lit(0), F.lit(-_FAR), F.lit(_FAR)))), pages, nodes, blocks, True, positives)
    near = near.select("qid", F.col("rank").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    # Whole scores: s is in the window if 100 s lies between both multiples.
    s = F.col("positive_score")
    floor100 = lambda v: F.call_function("div", v - F.pmod(v, F.lit(100)), F.lit(100))
    windows = near.select("qid", "w", (-floor100(-low * s)).alias("low"), floor100(high * s).alias("high")).where("low <= high")
    tops = windows.groupBy("qid").agg(F.collect_list(window(F.col("w"), F.col("low"), F.col("high"))).alias("tops"))  # at most `positives` each
    hard = _top(asked.join(tops, "qid").select("qid", "home", "label", "dims", "q", "tops"), pages, nodes, blocks, False, negatives)
    named = anchors.select(F.col("row").alias("qid"), F.col("vec_id").alias("anchor_id"))
    return hard.join(near, ["qid", "w"]).join(named, "qid").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH given AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id AS other, a.label = b.label AS same,
         list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM given a JOIN given b ON a.r <> b.r AND len(a.q) = len(b.q)
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other, b) <= 5
), hard AS (
  SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.other, n.b)::INTEGER AS rank
  FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM hard WHERE rank <= 10
"""
