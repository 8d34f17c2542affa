"""Measures on decoded pixel tables: frame quality, box contrast, perceptual hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import large_groups, pin

DARK_LEVEL = 40  # fixed value: luma below this counts as dark


def luma() -> Column:
    """Rec. 601 luma of ``r, g, b`` columns."""
    return 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")


def frame_quality(pixels: DataFrame, frame: str = "frame") -> DataFrame:
    """Sharpness, contrast, brightness, saturation and dark share from ``frame, y, x, r, g, b``.

    The Laplacian uses the four neighbours and the interior only; rows and columns of an
    image are the window partitions.
    """
    along = Window.partitionBy(frame, "y").orderBy("x")
    down = Window.partitionBy(frame, "x").orderBy("y")
    rows = pixels.withColumn("_l", luma()).withColumns({
        "_w": F.lag("_l").over(along), "_e": F.lead("_l").over(along),
        "_n": F.lag("_l").over(down), "_s": F.lead("_l").over(down),
    })
    lap = F.col("_w") + F.col("_e") + F.col("_n") + F.col("_s") - 4.0 * F.col("_l")
    chroma = F.greatest("r", "g", "b") - F.least("r", "g", "b")
    return rows.groupBy(frame).agg(
        F.var_pop(lap).alias("sharpness"), F.stddev_pop("_l").alias("contrast"), F.avg("_l").alias("brightness"),
        F.avg(chroma.cast("double")).alias("saturation"),
        F.avg(F.when(F.col("_l") < DARK_LEVEL, 1.0).otherwise(0.0)).alias("dark_fraction"),
    )


def box_contrast(pixels: DataFrame, boxes: DataFrame, frame: str = "frame") -> DataFrame:
    """Interior and ring luma of every box, signed contrast (positive = darker inside), shape and edges.

    Sums over rectangles come from summed-area tables, so a box looks up sixteen corners
    however many pixels it covers. Boxes under two pixels on a side give NULL measures.
    Pixel rows and columns count from 0; ``boxes`` has ``frame, box_id, x1, y1, x2, y2``.
    """
    lit = pixels.select(frame, "y", "x", (F.col("luma").cast("double") if "luma" in pixels.columns else luma()).alias("l"))
    along, down = Window.partitionBy(frame, "y").orderBy("x"), Window.partitionBy(frame, "x").orderBy("y")
    graded = lit.withColumns({
        "gx": F.coalesce(F.abs(F.col("l") - F.lag("l").over(along)), F.lit(0.0)),
        "gy": F.coalesce(F.abs(F.col("l") - F.lag("l").over(down)), F.lit(0.0)),
    })
    to_here = (Window.unboundedPreceding, Window.currentRow)
    names = ("l", "gx", "gy")
    row_sums = graded.withColumns({f"r_{c}": F.sum(c).over(along.rowsBetween(*to_here)) for c in names})
    table = row_sums.select(
        frame, "y", "x", *[F.sum(f"r_{c}").over(down.rowsBetween(*to_here)).alias(f"s_{c}") for c in names]
    )
    sizes = lit.groupBy(frame).agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    cut = boxes.join(sizes, frame, "left").withColumns({
        "_x1": F.greatest(F.lit(0), F.col("x1").cast("int")), "_y1": F.greatest(F.lit(0), F.col("y1").cast("int")),
        "_x2": F.least("_w", F.col("x2").cast("int")), "_y2": F.least("_h", F.col("y2").cast("int")),
    })
    bw, bh = F.col("_x2") - F.col("_x1"), F.col("_y2") - F.col("_y1")
    pad = lambda size: F.greatest(F.lit(4), F.floor(size / 2).cast("int"))
    good = cut.where((bw >= 2) & (bh >= 2)).withColumns({
        "_a1": F.greatest(F.lit(0), F.col("_x1") - pad(bw)), "_b1": F.greatest(F.lit(0), F.col("_y1") - pad(bh)),
        "_a2": F.least("_w", F.col("_x2") + pad(bw)), "_b2": F.least("_h", F.col("_y2") + pad(bh)),
    })
    # (rectangle, left, top, right, bottom); corners are looked up at right-1/bottom-1 and left-1/top-1.
    rectangles = (
        ("in", "_x1", "_y1", "_x2", "_y2"), ("out", "_a1", "_b1", "_a2", "_b2"),
        ("gx", F.col("_x1") + 1, "_y1", "_x2", "_y2"), ("gy", "_x1", F.col("_y1") + 1, "_x2", "_y2"),
    )
    corners = []
    for name, left, top, right, bottom in rectangles:
        left, top, right, bottom = [F.col(c) if isinstance(c, str) else c for c in (left, top, right, bottom)]
        for x, y, sign in ((right, bottom, 1), (left, bottom, -1), (right, top, -1), (left, top, 1)):
            corners.append(F.struct(
                F.lit(name).alias("part"), (x - 1).cast("int").alias("x"), (y - 1).cast("int").alias("y"), F.lit(sign).alias("sign")))
    asked = good.select(frame, "box_id", F.explode(F.array(*corners)).alias("c")).select(frame, "box_id", "c.*")
    found = asked.where((F.col("x") >= 0) & (F.col("y") >= 0)).join(
        table.select(frame, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *[f"s_{c}" for c in names]),
        [frame, "x", "y"],
    )
    part = lambda p, c: F.coalesce(F.sum(F.when(F.col("part") == p, F.col("sign") * F.col(f"s_{c}"))), F.lit(0.0))
    sums = found.groupBy(frame, "box_id").agg(
        part("in", "l").alias("_in"), part("out", "l").alias("_out"), part("gx", "gx").alias("_gx"), part("gy", "gy").alias("_gy"))
    measured = good.join(sums, [frame, "box_id"])
    area = (bw * bh).cast("double")
    ring = ((F.col("_a2") - F.col("_a1")) * (F.col("_b2") - F.col("_b1"))).cast("double") - area
    interior = F.col("_in") / area
    surround = F.when(ring > 0, (F.col("_out") - F.col("_in")) / F.greatest(ring, F.lit(1.0))).otherwise(interior)
    values = measured.select(
        frame, "box_id", interior.alias("interior"), surround.alias("surround"), (surround - interior).alias("contrast"),
        (F.greatest(bw, bh) / F.greatest(F.lit(1), F.least(bw, bh)).cast("double")).alias("elongation"),
        (area / (F.col("_w") * F.col("_h"))).alias("area_frac"),
        ((F.col("_gx") / (bh * (bw - 1)) + F.col("_gy") / (bw * (bh - 1))) / 2.0).alias("edge_density"),
    )
    return boxes.join(values, [frame, "box_id"], "left")


def difference_hash(grid: Column, width: int, height: int) -> Column:
    """Row-wise ``left < right`` bits of a row-major luma array, first bit highest."""
    spots = [r * width + c for r in range(height) for c in range(width - 1)]
    places = F.array(*[F.lit(i) for i in spots])

    def push(bits: Column, i: Column) -> Column:
        return F.shiftleft(bits, 1).bitwiseOR(F.when(F.get(grid, i) < F.get(grid, i + 1), F.lit(1)).otherwise(F.lit(0)).cast("bigint"))

    return F.aggregate(places, F.lit(0).cast("bigint"), push)


# Near-duplicate search -------------------------------------------------------------------


def _edge(left: Column, i: Column | int, parts: int) -> Column:
    """First bit of band ``i`` when ``left`` bits are cut into ``parts`` bands."""
    return F.floor(left * i / F.lit(float(parts)) + 0.5).cast("int")


def _low(count: Column) -> Column:
    """A mask of the lowest ``count`` bits; a shift by 64 would be none."""
    return F.when(count >= 64, F.lit(-1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), count) - 1)


def _shifted(value: Column, by: Column) -> Column:
    return F.when(by >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", value, by))


def _band(value: Column, left: Column, i: Column, parts: int) -> Column:
    start = _edge(left, i, parts)
    return _shifted(value, start).bitwiseAND(_low(_edge(left, i + 1, parts) - start))


def near_duplicates(
    hashes: DataFrame, threshold: int = 4, *, split: str = "split", image: str = "image", bits: int = 64,
    bucket_rows: int = 10_000,
) -> DataFrame:
    """Pairs of hashes at most ``threshold`` bits apart that occur in different splits.

    One row per pair of (split, hash), with how many images carry each and one example, so
    copies are counted, not multiplied: ``split_a, hash_a, images_a, example_a, …_b, distance``.

    With ``threshold + 1`` disjoint bands at least one band of such a pair is equal, so pairs
    meet on an equal band. The rest of their bits hold at most ``threshold`` flips too. So a band value
    shared by more than ``bucket_rows`` hashes is cut again into as many bands of the rest, and so on
    until it is calm or no more than a bit a band is left. A pair is reported by its first equal band
    at every cut, hence once.
    """
    parts = threshold + 1
    known = pin(hashes.groupBy(split, F.col("h").alias("hash")).agg(
        F.count(F.lit(1)).alias("images"), F.min(image).alias("example")
    ))
    # What is left of the hash and its bits, the bucket so far, and the cuts that led there.
    level = known.withColumns({"_v": F.col("hash"), "_left": F.lit(bits), "_path": F.lit(""), "_cuts": F.array().cast("array<struct<v:bigint,left:int,band:int>>")})
    out = None
    while True:
        tall = level.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        start, end = _edge(F.col("_left"), F.col("_b"), parts), _edge(F.col("_left"), F.col("_b") + 1, parts)
        rest = F.call_function("shiftleft", _shifted(F.col("_v"), end), start).bitwiseOR(F.col("_v").bitwiseAND(_low(start)))
        tall = tall.select(
            split, "hash", "images", "example", F.concat("_path", F.lit("/"), "_b", F.lit(":"), _band(F.col("_v"), F.col("_left"), F.col("_b"), parts)).alias("_path"),
            F.concat("_cuts", F.array(F.struct(F.col("_v").alias("v"), F.col("_left").alias("left"), F.col("_b").alias("band")))).alias("_cuts"),
            rest.alias("_v"), (F.col("_left") - (end - start)).alias("_left"))
        crowded = large_groups(tall.where(F.col("_left") >= parts), ["_path"], bucket_rows).select("_path")
        if crowded.isEmpty():
            found = _meeting(tall, threshold, parts, split)
            return found if out is None else out.unionByName(found)
        crowded = pin(crowded)
        found = _meeting(tall.join(crowded, "_path", "left_anti"), threshold, parts, split)
        out = found if out is None else out.unionByName(found)
        level = pin(tall.join(crowded, "_path", "left_semi"))


def _meeting(tall: DataFrame, threshold: int, parts: int, split: str) -> DataFrame:
    """Pairs within the threshold that share a bucket and were led there by their first equal bands."""
    columns = (split, "hash", "images", "example")
    side = lambda t: tall.select("_path", *[F.col(c).alias(f"{c}_{t}") for c in (*columns, "_cuts")])
    distance = F.bit_count(F.col("hash_a").bitwiseXOR(F.col("hash_b")))
    pairs = side("a").join(side("b"), "_path").where((F.col(f"{split}_a") < F.col(f"{split}_b")) & (distance <= threshold))
    # No band before the one taken is equal, at any cut.
    earlier = lambda x, y: F.exists(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: (i < x["band"]) & (_band(x["v"].bitwiseXOR(y["v"]), x["left"], i, parts) == 0))
    first = F.forall(F.zip_with("_cuts_a", "_cuts_b", lambda x, y: ~earlier(x, y)), lambda ok: ok)
    return pairs.where(first).select(*[f"{c}_{t}" for t in "ab" for c in columns], distance.alias("distance"))


def duplicated_images(hashes: DataFrame, pairs: DataFrame, split: str = "split", image: str = "image") -> DataFrame:
    """Images that have a near-duplicate in another split.

    Hashes are stored first: a join on a hash computed in the plan may infer filters from a lambda that lose its columns.
    """
    ends = F.array(*[F.struct(F.col(f"{split}_{t}").alias(split), F.col(f"hash_{t}").alias("h")) for t in "ab"])
    touched = pairs.select(F.explode(ends).alias("_e")).select("_e.*").distinct()
    return pin(hashes).join(touched, [split, "h"], "left_semi")


def grid_cells(vectors: DataFrame, key: str, vector: str, columns: int) -> DataFrame:
    """A row-major array as ``frame, row, col, score`` cells."""
    return vectors.select(F.col(key).alias("frame"), F.posexplode(vector).alias("_p", "score")).select(
        "frame", F.floor(F.col("_p") / columns).cast("int").alias("row"), (F.col("_p") % columns).cast("int").alias("col"), "score"
    )
