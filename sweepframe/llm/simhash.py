"""Operator 1: near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint of 64 bits is cut into two segments of 32. If two fingerprints differ in at most two
bits, either their first segments differ in at most one bit, or their second segments are equal.
So each fingerprint looks itself up under its first segment, under every neighbour of it at one bit,
and under its second segment; what the tables return is verified by the complete distance. A pair at
one bit is enough to be looked up from the side whose bit is set.

Fingerprints are counted once each, so copies cost nothing. A segment shared by more than ``crowd``
fingerprints would return a number of pairs that grows with its square. In such a bucket, the same
lookup goes on in the other segment: fingerprints that agree in one segment and differ in at most two
bits of the other share a point at one bit from both, so each sends its 33 points and joins the
smallest fingerprint at each; lookups from a neighbouring bucket compare full fingerprints. That
links the same components with a bounded number of rows per fingerprint.
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

SHINGLE = 3
SEED = 42
MOST_BITS = 2
SEGMENT = 32
CROWD = 32
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of word shingles, an unsigned integer; 0 for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1)[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, len(starts), _CHUNK):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[lo:lo + _CHUNK], stops[lo:lo + _CHUNK])], np.dtype("<u8"))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * total > len(starts)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    found = np.array([fingerprint(t.as_py()) for t in texts], np.uint64)
    return pa.array(found.view(np.int64))


def _points(value: Column, bits: int = SEGMENT) -> Column:
    """``value`` and its neighbours at one bit (of a segment held in a long)."""
    return F.concat(F.array(value), F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: value.bitwiseXOR(F.expr("1L") * F.pow(F.lit(2.0), i).cast("long"))))


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a, b``: pairs of fingerprints (longs) at two bits or fewer that connect all such pairs.

    Without crowded segments these are all pairs, verified; within them, links through shared points.
    """
    table = store(prints.select("f").distinct().select(
        "f", F.shiftrightunsigned("f", SEGMENT).alias("s1"), F.col("f").bitwiseAND(F.lit((1 << SEGMENT) - 1)).alias("s2")), "prints")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MOST_BITS
    busy = {s: store(table.groupBy(s).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select(s), f"busy-{s}") for s in ("s1", "s2")}
    calm = {s: table.join(busy[s], s, "left_anti") for s in busy}

    # Equal segments, both tables: each pair once.
    found = []
    for s in busy:
        found.append(calm[s].select(s, F.col("f").alias("a")).join(calm[s].select(s, F.col("f").alias("b")), s)
                     .where((F.col("a") < F.col("b")) & close).select("a", "b"))
    # First segments at one bit: the side with the bit set clears it and looks there.
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(SEGMENT - 1)), lambda i: F.getbit(F.col("s1"), i) == 1)
    probes = table.select(F.col("f").alias("a"), "s1", "s2", F.explode(set_bits).alias("bit"))
    power = F.pow(F.lit(2.0), F.col("bit")).cast("long")
    probes = probes.select("a", "s2", F.col("s1").bitwiseXOR(power).alias("s1"))
    found.append(probes.join(calm["s1"].select("s1", F.col("f").alias("b")), "s1").where(close).select("a", "b"))

    # Crowded segments. Neighbours looked up from any side, since only one of the two may be crowded.
    for s, other in (("s1", "s2"), ("s2", "s1")):
        dense = table.join(busy[s], s, "left_semi")
        points = dense.select("f", s, F.explode(_points(F.col(other))).alias("point"))
        found.append(_star(points, s))
    dense = table.join(busy["s1"], "s1", "left_semi")
    into = probes.join(busy["s1"], "s1", "left_semi").select("a", "s1", F.explode(_points(F.col("s2"))).alias("s2"))
    found.append(into.join(dense.select("s1", "s2", F.col("f").alias("b")), ["s1", "s2"]).select("a", "b"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _star(points: DataFrame, segment: str) -> DataFrame:
    """Each fingerprint with the smallest one at each of its points."""
    hub = points.groupBy(segment, "point").agg(F.min("f").alias("b"))
    return points.join(hub, [segment, "point"]).where(F.col("f") != F.col("b")).select(F.col("f").alias("a"), "b").distinct()


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", crowd: int = CROWD) -> DataFrame:
    """``__at, doc_id, fingerprint, component, component_id, first`` for every row.

    ``component_id`` is the smallest identifier that links reach; ``first`` marks one row of each
    component: the smallest identifier (null last), then the first place. Null, empty and wordless
    texts have fingerprint zero and form one group. An empty table gives no rows; other columns are
    ignored.
    """
    rows = located(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked = store(rows.select(AT, "doc_id", fingerprints("text").alias("f")), "fingerprints")
    pairs = store(links(marked, crowd), "links")
    named = connected_components(pairs).select(F.col("node").alias("f"), "component")
    # A row per fingerprint, so groups of copies don't move; then a row per component.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", AT))
    per_print = marked.groupBy("f").agg(least.alias("best"))
    per_print = per_print.join(named, "f", "left").withColumn("component", F.coalesce("component", "f"))
    per_print = store(per_print, "classes")
    best = per_print.groupBy("component").agg(F.min("best").alias("best"))
    classes = per_print.select("f", "component").join(best, "component")
    return marked.join(classes, "f").select(
        AT, "doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component", F.col("best.doc_id").alias("component_id"),
        (F.col(AT) == F.col(f"best.{AT}")).alias("first"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their component, with their own columns."""
    docs = on_files(docs)
    stay = near_groups(docs, doc_id, text).where("first").select(AT)
    return located(docs).join(stay, AT, "left_semi").drop(AT)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "fingerprint", "component_id")
