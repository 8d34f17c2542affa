"""Near duplicates for stages that remove them: SimHash lookups as in operator 1, verified by exact Jaccard similarity.

At similarity 0.8 two SimHash fingerprints of 64 bits differ in about ten bits, a radius that no cut into
segments can look up in a large table. So fingerprints at two bits or fewer, found through the segment
tables of operator 1, are one source of candidates, and the signature orders of :mod:`forest` are the
other, which meet every pair at 0.8 but for a share of 6e-7. Every candidate is verified by its full sets
of shingles, and crowds are finished exactly. Nothing depends on the size of the table or of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import AT, located, on_files, store
from .forest import SIMILAR, jaccard_groups
from .simhash import links

SHINGLE = 5


def close_prints(sets: DataFrame) -> DataFrame:
    """Candidates ``a, b`` among sets ``f, print`` whose fingerprints differ in two bits or fewer.

    Sets with one fingerprint meet the smallest of them, which also stands for it in longer links.
    """
    heads = store(sets.groupBy("print").agg(F.min("f").alias("head"), F.count(F.lit(1)).alias("m")), "heads")
    same = sets.join(heads.where("m > 1"), "print").where("f != head").select(F.col("head").alias("a"), F.col("f").alias("b"))
    at = lambda end, out: heads.select(F.col("print").alias(end), F.col("head").alias(out))
    near = links(heads.select(F.col("print").alias("f"))).join(at("a", "x"), "a").join(at("b", "y"), "b")
    return same.unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b")))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """``__at, doc_id, component, first`` for every row.

    Components are of verified pairs; ``first`` marks one row of each: the smallest identifier (null
    last), then the first place. Null, empty and wordless texts have the empty set and form one group.
    Repeated rows are one set, so one of them is first at most. An empty table gives no rows; other
    columns are ignored.
    """
    found = jaccard_groups(docs, doc_id, text, shingle, similar, more=close_prints)
    return found.select(AT, "doc_id", "component", (F.col(AT) == F.col(f"best.{AT}")).alias("first"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that stand for their component, with their own columns."""
    docs = on_files(docs)
    stay = similar_groups(docs, doc_id, text, shingle, similar).where("first").select(AT)
    return located(docs).join(stay, AT, "left_semi").drop(AT)
