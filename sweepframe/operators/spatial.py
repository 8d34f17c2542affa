"""Where a pass went, what it covered, which sightings are one place."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import group_limit, group_quantiles, group_sizes, ordered_columns, pin
from ..plans.components import connected_components, roots

# Reference scale of the camera and the share of travel counted as drift.
MM_PER_PX_AT_1M = 1.36
REFERENCE_STANDOFF_M = 1.0
DRIFT_FRACTION = 0.05
GAP_M = 0.25


def build_track(
    motion: DataFrame, order: Sequence[str], *, clip: str = "clip",
    mm_per_px_at_1m: float = MM_PER_PX_AT_1M, reference_standoff: float = REFERENCE_STANDOFF_M,
) -> DataFrame:
    """Frame motions integrated into positions on the net, one row per frame.

    ``motion`` has ``dx_px, dy_px`` leading to each frame (NULL when it could not be
    matched) and ``standoff``. The first frame is the origin. An unmatched frame does not
    move but is flagged. A pass that would run backwards is rotated by 180 degrees, both
    axes, and says so in ``orient``.
    """
    order = list(order)
    sizes = group_sizes(motion, [clip])
    so = F.coalesce(F.when(~F.isnan("standoff"), F.col("standoff")), F.lit(float(reference_standoff)))
    rows = ordered_columns(
        motion.withColumns({"standoff_m": so, "mm_per_px": so * F.lit(float(mm_per_px_at_1m))}),
        [clip], order, lags={"_before": F.lit(1)}, sizes=sizes,
    )
    first = F.col("_before").isNull()
    known = ~first & F.col("dx_px").isNotNull() & F.col("dy_px").isNotNull()
    scale = F.col("mm_per_px") / 1000.0

    def step(pixels: Column) -> Column:
        return F.when(known, pixels * scale).otherwise(0.0)

    rows = rows.withColumns({
        "_along": step(-F.col("dx_px")), "_across": step(-F.col("dy_px")),
        "_travel": step(F.hypot("dx_px", "dy_px")), "matched": first | known,
    })
    placed = ordered_columns(
        rows, [clip], order,
        sums={"along_m": F.col("_along"), "across_m": F.col("_across"), "drift_m": F.col("_travel")}, sizes=sizes,
    )
    if sizes[0] <= group_limit(motion.sparkSession):  # a pass lies in one task already, which sees its end
        whole = Window.partitionBy(clip).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ended = placed.where(F.col(clip).isNotNull()).withColumn("_end", F.round(F.last("along_m").over(whole), 4))
    else:
        ended = placed.join(rows.groupBy(clip).agg(F.round(F.sum("_along"), 4).alias("_end")), clip)
    turn = F.when(F.col("_end") < 0, -1.0).otherwise(1.0)
    zero = F.lit(0.0)
    return ended.withColumns({
        "orient": turn,
        "along_m": F.round(F.col("along_m") * turn, 4) + zero, "across_m": F.round(F.col("across_m") * turn, 4) + zero,
        "drift_m": F.round(F.col("drift_m") * DRIFT_FRACTION, 4),
        "standoff_m": F.round("standoff_m", 3), "mm_per_px": F.round("mm_per_px", 4),
    }).drop("_before", "_along", "_across", "_travel", "_end")


def telemetry_step(samples: DataFrame, order: Sequence[str], time: str, speed: Column, clip: str = "clip") -> DataFrame:
    """Distance since the previous sample as speed times elapsed time, NULL on the first."""
    rows = ordered_columns(samples, [clip], order, lags={"_t": F.col(time)})
    return rows.withColumn("step_m", speed * (F.col(time) - F.col("_t"))).drop("_t")


def odometer(motion: DataFrame, order: Sequence[str], standoff_m: float = 1.0, clip: str = "clip") -> DataFrame:
    """Along-track travel so far at a declared standoff; an unmatched frame adds nothing."""
    step = F.coalesce(F.abs("dx_px"), F.lit(0.0)) * F.lit(MM_PER_PX_AT_1M * standoff_m / 1000.0)
    return ordered_columns(motion, [clip], order, sums={"travelled_m": step})


def _steps(track: DataFrame, order: Sequence[str], clip: str, frame: str) -> DataFrame:
    rows = ordered_columns(
        track, [clip], order, lags={"_p": F.struct(F.col(frame), "along_m", "across_m")}
    )
    return rows.where(F.col("_p").isNotNull()).withColumn(
        "_step", F.hypot(F.col("along_m") - F.col("_p.along_m"), F.col("across_m") - F.col("_p.across_m"))
    )


def coverage_gaps(
    track: DataFrame, order: Sequence[str], *, frame: str, clip: str = "clip", threshold_m: float = GAP_M
) -> DataFrame:
    """Steps between successive frames longer than the threshold: net that passed unseen."""
    far = _steps(track, order, clip, frame).where(F.col("_step") > threshold_m)
    return far.select(
        clip, F.col(f"_p.{frame}").alias("from_frame"), F.col(frame).alias("to_frame"),
        F.col("_p.along_m").alias("from_along_m"), F.col("along_m").alias("to_along_m"),
        F.round("_step", 3).alias("gap_m"),
    )


def swept_coverage(track: DataFrame, image_height_px: int, clip: str = "clip") -> DataFrame:
    """Extent, mean footprint across the track and swept area of every pass."""
    along = F.max("along_m") - F.min("along_m")
    footprint = F.avg(F.col("mm_per_px") * image_height_px / 1000.0)
    return track.groupBy(clip).agg(
        F.round(along, 3).alias("along_extent_m"), F.round(F.max("across_m") - F.min("across_m"), 3).alias("across_extent_m"),
        F.round(along * footprint, 3).alias("swept_area_m2"), F.count(F.lit(1)).alias("frames"),
        F.count_if("matched").alias("matched_frames"), F.round(footprint, 3).alias("mean_footprint_m"),
    )


def path_validation(
    track: DataFrame, telemetry_m: DataFrame, order: Sequence[str], *, frame: str, clip: str = "clip"
) -> DataFrame:
    """Visual path length against the telemetry's (``clip, telemetry_path_m``), per pass."""
    visual = _steps(track, order, clip, frame).groupBy(clip).agg(F.sum("_step").alias("_v"))
    both = track.select(clip).distinct().join(visual, clip, "left").join(telemetry_m, clip, "left")
    problem = F.when(F.col("_v").isNull(), "track too short").when(
        F.coalesce(F.col("telemetry_path_m"), F.lit(0.0)) <= 0, "no telemetry distance"
    )
    ratio = F.when(problem.isNull(), F.try_divide("_v", "telemetry_path_m"))
    return both.select(
        clip, problem.isNull().alias("comparable"), problem.alias("reason"),
        F.when(problem.isNull(), F.round("_v", 3)).alias("visual_path_m"),
        F.when(problem.isNull(), F.round("telemetry_path_m", 3)).alias("telemetry_path_m"),
        F.round(ratio, 3).alias("ratio"), ((ratio >= 0.8) & (ratio <= 1.2)).alias("agrees_within_20pct"),
    )


def calibrate_scale(
    pairs: DataFrame, keys: Sequence[str] = (), image_width_px: int | None = None
) -> DataFrame:
    """Millimetres per pixel from total travel: ``px, m, standoff`` per frame pair in, one row per key out.

    Pairs count when all three are known and pixels and standoff are positive. Fewer than
    five such pairs, or no travel, give a row with ``error`` and no estimate.
    """
    keys = list(keys)
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = F.coalesce(
        finite("px") & finite("m") & finite("standoff") & (F.col("px") > 0) & (F.col("standoff") > 0), F.lit(False)
    )
    good = pairs.where(usable)
    middle = group_quantiles(good, keys, "standoff", [0.5], "_q")
    sums = pairs.groupBy(*keys).agg(
        F.count_if(usable).alias("frames"), F.sum(F.when(usable, F.col("px"))).alias("_px"),
        F.sum(F.when(usable, F.col("m"))).alias("_m"),
    )
    sums = sums.join(middle, keys, "left") if keys else sums.withColumn("_q", middle.scalar())
    problem = F.when(F.col("frames") < 5, "need at least 5 usable frame pairs").when(
        (F.col("_px") <= 0) | (F.col("_m") <= 0), "no motion to calibrate against"
    )
    ref = F.col("_q")[0]
    here = F.when(problem.isNull(), F.try_divide(1000.0 * F.col("_m"), "_px"))
    out = [
        F.round(F.try_divide(here, ref), 4).alias("mm_per_px_at_1m"),
        F.when(problem.isNull(), F.round(ref, 3)).alias("reference_standoff_m"),
        F.when(problem.isNull(), F.round("_px", 1)).alias("total_pixels"),
        F.when(problem.isNull(), F.round("_m", 3)).alias("total_metres"), "frames",
    ]
    if image_width_px:
        half = here / 1000.0 * image_width_px / 2.0
        out.append(F.round(F.degrees(2 * F.atan2(half, ref)), 1).alias("implied_hfov_deg"))
    return sums.select(*keys, *out, problem.alias("error"))


def localise(
    detections: DataFrame, track: DataFrame, on: Sequence[str], image_width_px: float, image_height_px: float,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Position and size on the net of every detection whose frame is on the track.

    ``keep`` names further track columns to hand on, such as the depth.
    """
    spots = track.select(*on, *keep, "along_m", "across_m", "mm_per_px", "orient", "drift_m")
    return on_net(detections.join(spots, list(on)), image_width_px, image_height_px)


def on_net(seen: DataFrame, image_width_px: float, image_height_px: float) -> DataFrame:
    """:func:`localise` for rows that hold a box and the track's columns already, as a track built of its boxes' rows does."""
    scale = F.col("mm_per_px") / 1000.0
    off_x = (F.col("x1") + F.col("x2")) / 2.0 - image_width_px / 2.0
    off_y = (F.col("y1") + F.col("y2")) / 2.0 - image_height_px / 2.0
    return seen.withColumns({
        "along_m": F.round(F.col("along_m") + F.col("orient") * off_x * scale, 3) + F.lit(0.0),
        "across_m": F.round(F.col("across_m") + F.col("orient") * off_y * scale, 3) + F.lit(0.0),
        "width_mm": F.round((F.col("x2") - F.col("x1")) * F.col("mm_per_px"), 1),
        "height_mm": F.round((F.col("y2") - F.col("y1")) * F.col("mm_per_px"), 1),
    })


# Single linkage --------------------------------------------------------------------------


def _neighbour_cells(reach: int = 2) -> list[tuple[int, int]]:
    """Half of the cell offsets that can hold a point within the radius (corners cannot)."""
    return [
        (dx, dy) for dx in range(reach + 1) for dy in range(-reach, reach + 1)
        if (dx, dy) > (0, 0) and not (dx == reach and abs(dy) == reach)
    ]


def link_within(
    points: DataFrame, radius: float, keys: Sequence[str] = ("clip",), x: str = "along_m", y: str = "across_m", *,
    sizes: tuple[int, int] | None = None,
) -> DataFrame:
    """Adds ``component``, a number that is unique within ``keys``: points chained by steps no longer than ``radius``.

    Cells of side ``radius / sqrt(2)`` hold only points within the radius of each other, so a
    crowded cell is one node and its pairs are never formed. Whether two neighbouring cells
    touch is decided by their facing outlines: for cells side by side, the outermost point of
    each row (distinct ``y``), for cells above each other, of each column. Positions are in
    whole millimetres after :func:`localise`, which bounds an outline by the cell width.

    While every key's points fit a task they are dealt by key once and linked there. Otherwise cells
    are a table, and so are the edges between them. ``sizes`` are the points of the largest key and
    of all, where the caller has counted them.
    """
    keys = list(keys)
    side = radius / math.sqrt(2.0) * (1.0 - 1e-12)
    if (sizes or group_sizes(points, keys))[0] <= group_limit(points.sparkSession):
        known = points.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, x, y]))
        return _linked_by_key(known, radius, side, keys, x, y)
    cell = [*keys, "_cx", "_cy"]
    # Read several times below, so the positions are stored rather than derived again.
    placed = pin(points.withColumns({
        "_cx": F.floor(F.col(x) / side).cast("bigint"), "_cy": F.floor(F.col(y) / side).cast("bigint"),
    }))
    # Cells get a number that is stored with them and stands for the cell from here on. Numbers follow
    # the map, so that edges dealt by number lie together and most of them are contracted in their task.
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.select(*cell).distinct().repartitionByRange(parts, *cell).sortWithinPartitions(*cell)
    cells = pin(ordered.withColumn("_cell", F.monotonically_increasing_id()))
    celled = placed.join(cells, cell)
    by_row = celled.groupBy(*cell, "_cell", F.col(y).alias("_y")).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    by_column = celled.groupBy(*cell, "_cell", F.col(x).alias("_x")).agg(F.min(y).alias("_lo"), F.max(y).alias("_hi"))
    beside = [o for o in _neighbour_cells() if o[0] > 0]
    above = [o for o in _neighbour_cells() if o[0] == 0]
    edges = _facing(by_row, keys, beside, "_y", radius).unionByName(_facing(by_column, keys, above, "_x", radius))
    members = connected_components(edges.repartitionByRange(parts, "a")).withColumnRenamed("node", "_cell")
    return celled.join(members, "_cell", "left").withColumn("component", F.coalesce("component", "_cell")).drop("_cell", "_cx", "_cy")


#: Pairs of outline points that a task compares at a time.
_PAIRS = 1_000_000


def _linked_by_key(points: DataFrame, radius: float, side: float, keys: list[str], x: str, y: str) -> DataFrame:
    """:func:`link_within` for keys that fit a task: the same cells and outlines, as arrays."""

    def link(table: pa.Table) -> pa.Table:
        at = [table.column(c).cast(pa.float64()).to_numpy() for c in (x, y)]
        return table.append_column("component", pa.array(_chained(*at, radius, side), pa.int64()))

    shape = points.withColumn("component", F.lit(0).cast("bigint")).schema
    return points.groupBy(*keys).applyInArrow(link, shape)


def _chained(x: np.ndarray, y: np.ndarray, radius: float, side: float) -> np.ndarray:
    """For each point the smallest cell that its chain reaches; cells are numbered by place."""
    cx, cy = (np.floor(v / side).astype(np.int64) for v in (x, y))
    wide = cy.max() - cy.min() + 5
    names, cell = np.unique((cx - cx.min() + 2) * wide + cy - cy.min() + 2, return_inverse=True)
    ends = [np.zeros((2, 0), np.int64)]
    for across, along, step in ((y, x, (1, 2)), (x, y, (0,))):
        # The outline of a cell: for each row (column) of points its two outermost, a line (cell, place, lo, hi).
        order = np.lexsort((along, across, cell))
        c, p, v = cell[order], across[order], along[order]
        first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (p[1:] != p[:-1])])
        c, p, lo, hi = c[first], p[first], v[first], v[np.r_[first[1:], len(v)] - 1]
        start, stop = (np.searchsorted(c, np.arange(len(names)), s) for s in ("left", "right"))
        target = np.concatenate([names + dx * wide + dy for dx, dy in _neighbour_cells() if dx in step])
        found = np.minimum(np.searchsorted(names, target), len(names) - 1)
        met = np.flatnonzero(names[found] == target)
        a, b = met % len(names), found[met]
        many = stop - start
        upto = np.r_[0, np.cumsum(many[a] * many[b])]
        at = 0
        while at < len(a):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + _PAIRS, "right")) - 1)
            pair = np.repeat(np.arange(at, to), np.diff(upto[at:to + 1]))
            nth = np.arange(upto[at], upto[to]) - upto[pair]
            i, j = start[a[pair]] + nth // many[b[pair]], start[b[pair]] + nth % many[b[pair]]
            near = np.unique(pair[np.hypot(lo[j] - hi[i], p[j] - p[i]) <= radius])
            ends.append(np.stack([a[near], b[near]]))
            at = to
    return roots(*np.concatenate(ends, axis=1), len(names))[cell]


def _facing(outline: DataFrame, keys: list[str], offsets: list[tuple[int, int]], across: str, radius: float) -> DataFrame:
    """Cell pairs at the given offsets whose facing outlines come within the radius."""
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets])
    near = outline.select(
        *keys, F.col("_cell").alias("a"), F.col(across).alias("_p"), F.col("_hi").alias("_edge"),
        F.col("_cx").alias("_ax"), F.col("_cy").alias("_ay"), F.explode(shifts).alias("_o"),
    ).select(
        *keys, "a", "_p", "_edge", (F.col("_ax") + F.col("_o.dx")).alias("_cx"), (F.col("_ay") + F.col("_o.dy")).alias("_cy")
    )
    far = outline.select(
        *keys, "_cx", "_cy", F.col("_cell").alias("b"), F.col(across).alias("_q"), F.col("_lo").alias("_start")
    )
    pairs = near.join(far, [*keys, "_cx", "_cy"]).where(
        F.hypot(F.col("_start") - F.col("_edge"), F.col("_q") - F.col("_p")) <= radius
    )
    return pairs.select("a", "b").distinct()


def site_evidence(sightings: Column) -> Column:
    # The sentences below are outputs that must match the published ones word for word.
    return (
        F.when(sightings >= 10, "strong — seen from many viewpoints")
        .when(sightings >= 3, "moderate — seen in several frames").otherwise("weak — one or two frames only")
    )


def cluster_sites(
    detections: DataFrame, order: Sequence[str], *, frame: str, keys: Sequence[str] = ("clip",),
    radius_m: float = 0.25, min_sightings: int = 1,
) -> DataFrame:
    """Sightings rolled up to places, most seen first.

    ``order`` says which sighting of a place was first and last; of equal scores the first
    is the best look. Every sighting belongs to exactly one place.
    """
    keys = list(keys)
    sizes, limit = group_sizes(detections, keys), group_limit(detections.sparkSession)
    linked = link_within(detections, radius_m, keys, sizes=sizes)
    group = [*keys, "component"]
    if sizes[0] <= limit:  # dealt as rows, which are smaller than the sums of a place that most often has one row
        linked = linked.repartition(*keys)
    small = sizes[0] <= limit or group_sizes(linked, group)[0] <= limit
    medians = {"depth_m": "depth_m", "width_mm": "median_width_mm", "height_mm": "median_height_mm"}
    place = F.struct(*order)
    best = F.min_by(F.struct(F.col(frame).alias("frame"), "x1", "y1", "x2", "y2"), F.struct(-F.col("score"), *order))
    sites = linked.groupBy(*group).agg(
        F.avg("along_m").alias("along_m"), F.avg("across_m").alias("across_m"),
        F.count(F.lit(1)).alias("sightings"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"),
        F.hypot(F.max("along_m") - F.min("along_m"), F.max("across_m") - F.min("across_m")).alias("span_m"),
        F.min_by(frame, place).alias("first_frame"), F.max_by(frame, place).alias("last_frame"), best.alias("_best"),
        *([F.median(c).alias(m) for c, m in medians.items()] if small else []),
    ).where(F.col("sightings") >= min_sightings)
    out = sites if small else sites.join(_medians(linked, group, medians), group, "left")
    out = out.withColumns({
        "evidence": site_evidence(F.col("sightings")), "best_frame": F.col("_best.frame"),
        "best_x1": F.col("_best.x1"), "best_y1": F.col("_best.y1"), "best_x2": F.col("_best.x2"), "best_y2": F.col("_best.y2"),
    })
    depth = F.when(F.col("depth_m").isNotNull(), F.format_string(", %.1f m depth", "depth_m")).otherwise("")
    described = F.concat(
        F.format_string("%.2f m along, %+.2f m across", "along_m", "across_m"), depth,
        F.format_string(" · %d sightings · ~%.0f×%.0f mm · ", "sightings", "median_width_mm", "median_height_mm"), "evidence",
    )
    return out.withColumn("description", described).drop("_best").orderBy(
        F.col("sightings").desc(), *keys, "first_frame"
    ).drop("component")


def _medians(linked: DataFrame, group: list[str], names: dict[str, str]) -> DataFrame:
    """Medians of several columns when one place may hold more rows than a task should."""
    tall = linked.unpivot(group, list(names), "_m", "_v")
    middles = group_quantiles(tall, [*group, "_m"], "_v", [0.5], "_q")
    return middles.groupBy(*group).agg(*[F.max(F.when(F.col("_m") == c, F.col("_q")[0])).alias(m) for c, m in names.items()])


def grid_components(
    cells: DataFrame, threshold: float, *, rows: int, cols: int, width_px: float, height_px: float, keys: Sequence[str] = ("frame",)
) -> DataFrame:
    """Boxes around 8-connected groups of cells at or above the threshold.

    The score is the highest cell inside the box over twice the threshold, clipped to [0, 1].
    """
    keys = list(keys)
    hot = cells.where((F.col("score") >= threshold) & F.col("row").isNotNull() & F.col("col").isNotNull())
    # A frame has at most rows x cols cells, so it is one row; frames are labelled a batch at a time.
    framed = hot.groupBy(*keys).agg(F.collect_list(F.struct(F.col("row").cast("int").alias("r"), F.col("col").cast("int").alias("c"), F.col("score").cast("double").alias("s"))).alias("_cells"))
    kinds = dict(framed.dtypes)
    shape = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column("_cells")).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + _CELLS, "right")))
                few = batch.slice(lo, hi - lo)
                frame, boxes = _grid_boxes(few.column("_cells"))
                at = pa.array(frame)
                yield pa.RecordBatch.from_arrays([*[few.column(k).take(at) for k in keys], *[pa.array(b) for b in boxes]], names=[*keys, "r0", "r1", "c0", "c1", "cells", "top"])
                lo = hi

    boxes = framed.mapInArrow(label, shape + ", r0 bigint, r1 bigint, c0 bigint, c1 bigint, cells bigint, top double")
    wide, high = F.lit(float(width_px)), F.lit(float(height_px))
    return boxes.select(
        *keys, (F.col("c0") / float(cols) * wide).alias("x1"), (F.col("r0") / float(rows) * high).alias("y1"),
        ((F.col("c1") + 1) / float(cols) * wide).alias("x2"), ((F.col("r1") + 1) / float(rows) * high).alias("y2"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("top") / (threshold * 2))).alias("score"), "cells",
    )


#: Cells of frames that a task labels at a time.
_CELLS = 500_000


def _grid_boxes(frames: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each 8-connected group its frame, and ``r0, r1, c0, c1, cells, top``; ``frames`` are lists of cells."""
    flat = frames.flatten()
    r, c, s = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("r", "c", "s"))
    f = np.repeat(np.arange(len(frames)), pc.list_value_length(frames).to_numpy())
    r, c = r.astype(np.int64), c.astype(np.int64)
    r0, c0 = r.min(initial=0), c.min(initial=0)
    width = c.max(initial=0) - c0 + 3
    area = (r.max(initial=0) - r0 + 3) * width
    place = f * area + (r - r0 + 1) * width + c - c0 + 1
    order = np.argsort(place)
    f, r, c, s, place = (v[order] for v in (f, r, c, s, place))
    again = np.flatnonzero(place[1:] == place[:-1])  # a cell that comes twice
    ends = [(again, again + 1)]
    for step in (1, width - 1, width, width + 1):
        at = np.minimum(np.searchsorted(place, place + step), len(place) - 1)
        here = np.flatnonzero(place[at] == place + step)
        ends.append((here, at[here]))
    root = roots(*(np.concatenate([e[i] for e in ends]) for i in (0, 1)), len(place))
    heads, group = np.unique(root, return_inverse=True)
    out = [np.full(len(heads), v) for v in (np.iinfo(np.int64).max, -np.iinfo(np.int64).max, np.iinfo(np.int64).max, -np.iinfo(np.int64).max)]
    for have, how, value in zip(out, (np.minimum, np.maximum, np.minimum, np.maximum), (r, r, c, c)):
        how.at(have, group, value)
    first, last = np.searchsorted(f, np.arange(len(frames))), np.searchsorted(f, np.arange(len(frames)), "right")
    top = np.empty(len(heads))
    for i, head in enumerate(heads):
        mine = slice(first[f[head]], last[f[head]])
        inside = (r[mine] >= out[0][i]) & (r[mine] <= out[1][i]) & (c[mine] >= out[2][i]) & (c[mine] <= out[3][i])
        top[i] = s[mine][inside].max()
    return f[heads], [*out, np.bincount(group, minlength=len(heads)), top]
