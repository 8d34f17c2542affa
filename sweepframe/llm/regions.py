"""Finding repeated windows of a fixed length without moving every window.

A window of ``length`` units (bytes or words) has an anchor: its leftmost smallest k-gram hash. Equal
windows have equal anchors at equal places, so they can only meet at the anchor's hash. Neighbouring
windows mostly share an anchor; the run of windows that one occurrence of an anchor owns is a
*region*, and about ``2 / (length - k + 2)`` of the units start one. Regions, not windows, are
shuffled, with a hash of their content. Equal regions are one; where an anchor has different regions,
their content is compared by the operator that asked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import AT, located, store

#: Units whose anchors are searched at once; texts of any length take this much memory.
BLOCK = 1 << 19
SKETCH_BITS = 16
HOT_SHARE = 4096
#: Rows of one anchor whose texts a task compares together: about 2.5 MB of text, 300 MB of working
#: memory. Beyond, windows are compared one by one.
LARGE = 4000
_PLACE = np.uint64((1 << 21) - 1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_ODD = 0xD6E8FEB86659FD93
_ODD_INVERSE = pow(_ODD, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of ``x``, which is overwritten."""
    x ^= x >> np.uint64(31)
    x *= _B
    x ^= x >> np.uint64(29)
    x *= _C
    x ^= x >> np.uint64(32)
    return x


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: prefix and suffix minima of blocks of that width."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


class ByteUnits:
    """A text as bytes; anchors are 64 bytes long, so that few are met by chance, or 16 in short windows."""

    def __init__(self, length: int):
        self.length, self.k = length, 64 if length >= 256 else 16

    def read(self, text: str | bytes | None) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
        """The text's units, and a function that cuts ``windows`` windows from ``start``."""
        data = text if isinstance(text, bytes) else (text or "").encode()
        return np.frombuffer(data, np.uint8), lambda start, windows: data[start:start + windows - 1 + self.length]

    def contents(self, codes: list[np.ndarray], cuts: list, doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of each region."""
        return np.fromiter((xxhash.xxh3_64_intdigest(cuts[d](f, m)) for d, f, m in zip(doc.tolist(), first.tolist(), n.tolist())), np.uint64, len(doc))

    def grams(self, units: np.ndarray) -> np.ndarray:
        """A hash of each ``k`` neighbouring units, from hashes of 8, 16 and so on."""
        data = units.tobytes()
        out = np.empty(len(data) - 7, np.uint64)
        for shift in range(8):
            out[shift::8] = np.frombuffer(data, "<u8", (len(data) - shift) // 8, shift)
        size = 8
        while size < self.k:
            out, ahead = out[:-size] * _A, out[size:]
            out += ahead
            out = mixed(out)
            size *= 2
        return out


class WordUnits:
    """A text as words joined by one space; anchors are four words long."""

    k = 4

    def __init__(self, length: int):
        self.length = length

    def contents(self, codes: list[np.ndarray], cuts: list, doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A hash of each region: differences of running sums of word hashes times powers of an odd number."""
        sizes = np.array([len(c) for c in codes])
        start = (np.cumsum(sizes) - sizes)[doc] + first
        total = int(sizes.sum()) + 1
        power, back = (np.full(total, x, np.uint64) for x in (_ODD, _ODD_INVERSE))
        for powers in (power, back):
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.concatenate(codes) * power[:-1], dtype=np.uint64)))
        end = start + n - 1 + self.length
        return mixed((sums[end] - sums[start]) * back[start] + n.astype(np.uint64) * _A)

    def read(self, text: str | bytes | None) -> tuple[np.ndarray, Callable[[int, int], bytes]]:
        words = (text if isinstance(text, bytes) else (text or "").encode()).split()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        return hashes, lambda start, windows: b" ".join(words[start:start + windows - 1 + self.length])

    def grams(self, units: np.ndarray) -> np.ndarray:
        n = len(units) - 3
        out = units[:n].copy()
        for t in (1, 2, 3):
            out *= _A
            out += units[t:t + n]
        return mixed(out)


def find(units, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, anchor hash, first window, windows)`` of each region of ``texts``, in blocks of units.

    Short texts are searched together: a window that reaches into the next text is none.
    """
    length, width = units.length, units.length - units.k + 1
    block: list[tuple[int, int, np.ndarray]] = []

    def search():
        sizes = np.array([len(x) for _, _, x in block])
        offsets = np.cumsum(sizes) - sizes
        hashes = units.grams(np.concatenate([x for _, _, x in block]))
        hashes_at = np.arange(len(hashes), dtype=np.uint64)
        at = (_smallest((hashes & ~_PLACE) | hashes_at, width) & _PLACE).astype(np.int64)
        text = np.repeat(np.arange(len(block)), sizes - length + 1)
        start = np.concatenate([np.arange(o, o + n - length + 1) for o, n in zip(offsets.tolist(), sizes.tolist())])
        at = at[start]
        first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (text[1:] != text[:-1]))))
        n = np.diff(np.append(first, len(at)))
        owner = text[first]
        names, before = np.array([i for i, _, _ in block]), np.array([lo for _, lo, _ in block])
        return names[owner], hashes[at[first]], start[first] - offsets[owner] + before[owner], n

    size = 0
    for i, codes in enumerate(texts):
        for lo in range(0, len(codes) - length + 1, BLOCK):
            part = codes[lo:lo + BLOCK + length - 1]
            if size + len(part) > BLOCK and block:
                yield search()
                block, size = [], 0
            block.append((i, lo, part))
            size += len(part)
    if block:
        yield search()


def numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``file, row, doc_id, text``: a place as two numbers. Paths are hashed to 64 bits; there are only as many as files."""
    rows = located(docs, F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.select(F.xxhash64(f"{AT}.file").alias("file"), F.col(f"{AT}.row").alias("row"), "doc_id", "text")


def packed(rows: DataFrame) -> DataFrame:
    """``rows`` with their text compressed, as ``packed``: what is shuffled is less than half as large."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                few = batch.slice(lo, 128)
                texts = [squeeze((v.as_py() or "").encode()) for v in few.column(3)]
                yield pa.RecordBatch.from_arrays([*few.columns[:3], pa.array(texts, pa.binary())], names=["file", "row", "doc_id", "packed"])

    return rows.mapInArrow(pack, f"file bigint, row bigint, doc_id {kind}, packed binary")


def unpacked(value: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value) if value else b""


def region_rows(rows: DataFrame, units, hot: list[int] | None = None, common: bool = False) -> DataFrame:
    """``anchor, content, file, row, doc_id, starts, windows, prefix``: a row for each different region of a text.

    ``starts`` are its places in that text, so a text that repeats itself is no more rows than others.
    ``prefix`` are a few bits of a hash of the anchor. Given ``hot`` prefixes, regions of these are
    left out, or with ``common`` all others.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def emit(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                few = batch.slice(lo, 128)
                read = [units.read(v.as_py()) for v in few.column(3)]
                cuts = [cut for _, cut in read]
                codes = [c for c, _ in read]
                for doc, anchor, first, n in find(units, codes):
                    if hot is not None:
                        wanted = np.isin(_prefix(anchor), hot) == common
                        doc, anchor, first, n = doc[wanted], anchor[wanted], first[wanted], n[wanted]
                        if not len(doc):
                            continue
                    content = units.contents(codes, cuts, doc, first, n)
                    order = np.lexsort((first, content, anchor, doc))
                    doc, anchor, content, first, n = (x[order] for x in (doc, anchor, content, first, n))
                    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]))))
                    at = pa.array(doc[new])
                    starts = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)).astype(np.int32)), pa.array(first.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[new].view(np.int64)), pa.array(content[new].view(np.int64)), *[few.column(c).take(at) for c in range(3)], starts,
                         pa.array(n[new].astype(np.int32)), pa.array(_prefix(anchor[new]))],
                        names=["anchor", "content", "file", "row", "doc_id", "starts", "windows", "prefix"])

    return rows.mapInArrow(emit, f"anchor bigint, content bigint, file bigint, row bigint, doc_id {kind}, starts array<bigint>, windows int, prefix int")


def _prefix(anchor: np.ndarray) -> np.ndarray:
    """An anchor, the smallest of many hashes, is a small number itself: hash it again."""
    return (mixed(anchor + _A) >> np.uint64(64 - SKETCH_BITS)).astype(np.int32)


def prefix_counts(rows: DataFrame, units) -> DataFrame:
    """``prefix, n`` by task: how many regions, from anchors alone."""

    def count(batches):
        seen = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                for doc, anchor, _, _ in find(units, [units.read(v.as_py())[0] for v in batch.column(0).slice(lo, 128)]):
                    # An anchor counts once a text.
                    order = np.lexsort((anchor, doc))
                    doc, anchor = doc[order], anchor[order]
                    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])))
                    seen += np.bincount(_prefix(anchor[new]), minlength=len(seen))
        full = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(seen[full])], names=["prefix", "n"])

    return rows.select("text").mapInArrow(count, "prefix int, n bigint")


def common_prefixes(counts: DataFrame) -> list[int]:
    """Hash prefixes of anchors that hold more than ``1 / HOT_SHARE`` of all regions and over ``LARGE``.

    Regions are counted by ``SKETCH_BITS`` bits of their anchor's hash, so what a task sends is bounded,
    and so is the list: at most ``HOT_SHARE`` numbers.
    """
    sizes = counts.groupBy("prefix").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # 2 ** SKETCH_BITS rows at most
    return [r[0] for r in sizes.withColumn("total", total).where((F.col("n") > LARGE) & (F.col("n") * HOT_SHARE > F.col("total"))).select("prefix").collect()]


def repeated(rows: DataFrame, units, keep: bool) -> DataFrame:
    """``region_rows`` of anchors met more than once, with what the table holds of them:

    ``copies``  occurrences of this content, in this text and others
    ``least``   the smallest ``doc_id`` among them
    ``head``    whether the row stands for its content: one row of the smallest ``doc_id``
    ``size``    rows at this anchor
    ``alone``   whether no other content has this anchor
    ``later``   whether the anchor is met under more than one ``doc_id``

    Anchors that are common all over the table are counted by content, with partial sums, and joined
    back; Spark splits that join where a content is common itself. They count as larger than ``LARGE``
    and never as alone. All others are counted by windows over their anchor, after one shuffle by it.

    Regions are needed twice: ``keep`` stores them, else they are found again, where a table of them
    would be as large as the input.
    """
    if keep:
        every = store(region_rows(rows, units), "anchors")
        hot = common_prefixes(every.select("prefix", F.lit(1).alias("n")))
        found, common = (every.where(~F.col("prefix").isin(hot)), every.where(F.col("prefix").isin(hot))) if hot else (every, None)
    else:
        hot = common_prefixes(prefix_counts(rows, units))
        found, common = region_rows(rows, units, hot), store(region_rows(rows, units, hot, common=True), "common") if hot else None
    here = Window.partitionBy("anchor")
    same = Window.partitionBy("anchor", "content")
    found = found.drop("prefix").repartition("anchor")
    found = found.withColumn("head", F.row_number().over(same.orderBy("doc_id", "file", "row")) == 1)
    found = found.withColumns({"copies": F.sum(F.size("starts")).over(same), "least": F.min("doc_id").over(same)})
    found = found.withColumns({
        "size": F.count(F.lit(1)).over(here), "alone": F.min("content").over(here) == F.max("content").over(here),
        "later": F.min("doc_id").over(here) < F.max("doc_id").over(here), "met": F.sum(F.size("starts")).over(here),
    }).where("met > 1").drop("met")
    found = store(found, "regions")
    if common is None:
        return found
    place = F.struct("doc_id", "file", "row")
    counted = common.groupBy("anchor", "content").agg(F.sum(F.size("starts")).alias("copies"), F.min(place).alias("best"))
    common = common.join(counted, ["anchor", "content"]).withColumns({
        "head": place == F.col("best"), "least": F.col("best.doc_id"), "size": F.lit(LARGE + 1).cast("long"), "alone": F.lit(False), "later": F.lit(True)})
    return found.unionByName(store(common.select(*found.columns), "regions"))


def cut_out(texts: DataFrame, wanted: DataFrame, units, single: Column) -> DataFrame:
    """``anchor, content, part, windows, data, key, check``: the bytes of the regions ``wanted``, as ``windows`` and ``data``.

    Where ``single`` holds, a row for each window of the region instead, with its place there as ``part``
    and a hash of 128 bits as ``key, check``. Texts are shuffled once for both.
    """
    spot = F.struct("anchor", "content", F.get("starts", F.lit(0)).alias("start"), "windows", single.alias("single"))
    per_text = wanted.groupBy("file", "row").agg(F.collect_list(spot).alias("spots"))
    kinds = {"anchor": pa.int64(), "content": pa.int64(), "part": pa.int32(), "windows": pa.int32(), "data": pa.binary(), "key": pa.int64(), "check": pa.int64()}

    def emit(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                few = batch.slice(lo, 16)
                cols = {c: [] for c in kinds}
                for value, spots in zip(few.column(0), few.column(1)):
                    _, cut = units.read(unpacked(value.as_py()))
                    for s in spots.as_py():
                        parts = [cut(s["start"] + p, 1) for p in range(s["windows"])] if s["single"] else []
                        n = len(parts) or 1
                        cols["anchor"] += [s["anchor"]] * n
                        cols["content"] += [s["content"]] * n
                        cols["part"] += range(n)
                        cols["windows"] += [1 if parts else s["windows"]] * n
                        cols["data"] += [None] * n if parts else [cut(s["start"], s["windows"])]
                        cols["key"] += [xxhash.xxh64_intdigest(t, 1) - (1 << 63) for t in parts] or [None]
                        cols["check"] += [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in parts] or [None]
                yield pa.RecordBatch.from_arrays([pa.array(cols[c], k) for c, k in kinds.items()], names=list(kinds))

    met = texts.select("file", "row", "packed").join(per_text, ["file", "row"]).select("packed", "spots")
    return met.mapInArrow(emit, "anchor bigint, content bigint, part int, windows int, data binary, key bigint, check bigint")


def covered(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Merged stretches ``(from, to)`` that windows cover; ``runs`` are ``(first window, windows)``."""
    out: list[list[int]] = []
    for start, windows in sorted(runs):
        end = start + windows - 1 + length
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]
