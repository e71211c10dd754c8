"""Joins and groupings over the boxes of pages.

A page is the unit of locality and is bounded. Overlap joins go through a grid: both sides are cut into cells, joined on
(page, cell), and a pair counts only in the one cell that holds its corner, so no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G

CELL = 64.0


def _cells(boxes: DataFrame, prefix: str, page: str, grow: float = 0.0) -> DataFrame:
    names = [c for c in boxes.columns if c != page]
    out = boxes.select(page, *[F.col(c).alias(prefix + c) for c in names])
    b = G.box(prefix)
    edges = {"x1": G.left(b) - grow, "x2": G.right(b) + grow, "y1": G.top(b) - grow, "y2": G.bottom(b) + grow}
    for name, edge in edges.items():
        out = out.withColumn(prefix + name, edge)

    def span(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.col(prefix + lo) / CELL).cast("int"), F.floor(F.col(prefix + hi) / CELL).cast("int"))

    return out.withColumn("_gx", F.explode(span("x1", "x2"))).withColumn("_gy", F.explode(span("y1", "y2")))


def overlapping_pairs(a: DataFrame, b: DataFrame, page: str = "page", rotated: bool = False) -> DataFrame:
    """Pairs of boxes of two sides that overlap (touching included); columns prefixed a_ and b_."""
    pairs = _cells(a, "a_", page).join(_cells(b, "b_", page), [page, "_gx", "_gy"])
    ax, bx = G.box("a_"), G.box("b_")
    home = (F.floor(F.greatest("a_x1", "b_x1") / CELL) == F.col("_gx")) & (
        F.floor(F.greatest("a_y1", "b_y1") / CELL) == F.col("_gy")
    )
    test = G.boxes_overlap(ax, bx) if rotated else G.rectangles_intersect(ax, bx)
    return pairs.where(home & test).drop("_gx", "_gy", *[p + e for p in ("a_", "b_") for e in ("x1", "x2", "y1", "y2")])


def without_overlap(candidates: DataFrame, others: DataFrame, page: str = "page") -> DataFrame:
    hit = overlapping_pairs(candidates, others, page).select(page, F.col("a_box_id").alias("box_id")).distinct()
    return candidates.join(hit, [page, "box_id"], "left_anti")


def attach_stems(heads: DataFrame, stems: DataFrame, grow: float = 15.0, page: str = "page") -> DataFrame:
    """First overlapping stem (by stem order) of each notehead, grown first; heads without one keep NULL."""
    thick = heads.withColumn("w", F.col("w") + grow).withColumn("h", F.col("h") + grow)
    pairs = overlapping_pairs(thick, stems, page)
    first = pairs.groupBy(page, F.col("a_box_id").alias("box_id")).agg(
        F.min(F.struct(F.col("b_box_id").alias("stem_id"), F.col("b_cy").alias("cy"))).alias("_s")
    )
    joined = heads.join(first, [page, "box_id"], "left")
    way = F.when(F.col("_s.cy") < F.col("cy"), F.lit("UP")).when(F.col("_s").isNotNull(), F.lit("DOWN"))
    return joined.withColumn("stem_id", F.col("_s.stem_id")).withColumn("direction", way).drop("_s")


def nearest_grid_point(items: DataFrame, points: DataFrame, keys, tolerance: float = 50.0) -> DataFrame:
    """Closest staff point in x per item and staff, NULL when farther than the tolerance.

    Points and items meet in x buckets as wide as the tolerance; an item looks into three of them.
    """
    near = items.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("cx") / tolerance) + d)))
    grid = points.withColumn("_b", F.floor(F.col("x") / tolerance)).select(*keys, "_b", "x", "ys")
    pairs = near.join(grid, [*keys, "_b"]).where(F.abs(F.col("x") - F.col("cx")) <= tolerance)
    best = pairs.groupBy(*keys, "box_id").agg(
        F.min(F.struct(F.abs(F.col("x") - F.col("cx")).alias("dx"), "x", "ys")).alias("_p")
    )
    joined = items.join(best, [*keys, "box_id"], "left")
    distance = F.array_min(F.transform("_p.ys", lambda y: F.abs(y - F.col("cy"))))
    return joined.select(*items.columns, F.col("_p.x").alias("x"), F.col("_p.ys").alias("ys"), distance.alias("y_distance"))


def on_staff_zone() -> Column:
    """The item lies within four ledger lines of the staff at its x."""
    reach = (F.element_at("ys", -1) - F.element_at("ys", 1)) / (F.size("ys") - 1) * G.LEDGER_LINES
    return F.col("cy").between(F.element_at("ys", 1) - reach, F.element_at("ys", -1) + reach)


def nearest_above_below(probes: DataFrame, regions: DataFrame, keys) -> DataFrame:
    """above: greatest stop of the regions that start before y (0 if none); below: least start of those that stop
    after y (1e12 if none). Running frames over the union, a probe before the regions at its own value, so no pairs are
    formed and equal values do not count."""
    probe = probes.select(*keys, "probe_id", F.col("y").cast("double").alias("_k"), F.lit(None).cast("double").alias("_v"), F.lit(0).alias("_region"))

    def side(key: str, value: str) -> DataFrame:
        reg = regions.select(*keys, F.lit(None).cast("bigint").alias("probe_id"), F.col(key).cast("double").alias("_k"), F.col(value).cast("double").alias("_v"), F.lit(1).alias("_region"))
        return probe.unionByName(reg)

    def before(*order) -> W:
        return W.partitionBy(*keys).orderBy(*order, "_region").rowsBetween(W.unboundedPreceding, -1)

    above = side("start", "stop").withColumn("above", F.max("_v").over(before("_k")))
    below = side("stop", "start").withColumn("below", F.min("_v").over(before(F.desc("_k"))))
    a = above.where("probe_id is not null").select(*keys, "probe_id", F.coalesce("above", F.lit(0.0)).alias("above"))
    b = below.where("probe_id is not null").select(*keys, "probe_id", F.coalesce("below", F.lit(1e12)).alias("below"))
    return a.join(b, [*keys, "probe_id"])


def nearest_staff(stems: DataFrame, staffs: DataFrame, page: str = "page") -> DataFrame:
    """Staff of each stem: the nearest in height among those that contain its x, else the nearest overall.

    The few staffs of a page travel as one array per page; no pair rows are formed.
    """
    b = G.box()
    lists = staffs.groupBy(page).agg(
        F.collect_list(F.struct(F.col("box_id").alias("id"), "cy", G.left(b).alias("x1"), G.right(b).alias("x2"))).alias("_staffs")
    )
    ranked = F.transform(
        "_staffs",
        lambda s: F.struct(
            (~F.col("cx").between(s["x1"], s["x2"])).alias("outside"), F.abs(F.col("cy") - s["cy"]).alias("distance"), s["id"].alias("staff_id")
        ),
    )
    return stems.join(lists, page, "left").withColumn("_best", F.array_min(ranked)).select(*stems.columns, "_best.staff_id", "_best.outside")


def empty_measures(bars: DataFrame, notes: DataFrame, page: str = "page", x_tolerance: float = 5.0) -> DataFrame:
    """Bar boundaries to drop: the end of every measure without a note, the start when it is the last one."""
    w = W.partitionBy(page).orderBy("x")
    measures = bars.withColumn("stop", F.lead("x").over(w)).withColumn("_after", F.lead("x", 2).over(w)).where("stop is not null")
    content = notes.groupBy(page).agg(F.array_sort(F.collect_list("cx")).alias("_notes"))
    joined = measures.join(content, page, "left")
    filled = F.exists(F.coalesce("_notes", F.array().cast("array<double>")), lambda n: (n >= F.col("x") - x_tolerance) & (n < F.col("stop")))
    return joined.where(~filled).select(page, F.col("x").alias("start"), "stop", F.when(F.col("_after").isNull(), F.col("x")).otherwise(F.col("stop")).alias("dropped"))


def connections(symbols: DataFrame, items: DataFrame, page: str = "page", grow: float = 30.0) -> DataFrame:
    """Symbols that touch items of two adjacent staffs: (page, upper staff, symbol)."""
    thick = symbols.withColumn("w", F.col("w") + grow).withColumn("h", F.col("h") + grow)
    touched = overlapping_pairs(thick, items, page).select(page, "a_box_id", F.col("b_staff").alias("staff")).distinct()
    lower = touched.select(page, "a_box_id", (F.col("staff") - 1).alias("staff"))
    return touched.join(lower, [page, "a_box_id", "staff"], "left_semi").select(page, "staff", F.col("a_box_id").alias("box_id"))


def brace_scores(staffs: DataFrame, braces: DataFrame, page: str = "page") -> DataFrame:
    """Best brace score of each pair of neighbouring staffs of a page; 0 when no brace fits.

    A brace fails when it reaches past the midpoint to a staff outside the pair, is five units or more away, or covers
    less than half of itself. Otherwise: overlap over union, less the relative distance.
    """
    w = W.partitionBy(page).orderBy("min_y", "staff_id")
    lead = [F.lead(c).over(w).alias("l_" + c) for c in ("staff_id", "min_x", "min_y", "max_y", "unit")]
    pairs = staffs.select(
        page, "staff_id", "min_x", "min_y", "max_y", "unit", *lead,
        F.lag("max_y").over(w).alias("above"), F.lead("min_y", 2).over(w).alias("beneath"),
    ).where("l_staff_id is not null")
    lists = braces.groupBy(page).agg(F.collect_list(F.struct("cx", "cy", "h")).alias("_braces"))
    joined = pairs.join(lists, page, "left")
    limit = (F.col("unit") + F.col("l_unit")) / 2 * 5

    def score(b: Column) -> Column:
        lo, hi = b["cy"] - b["h"] / 2, b["cy"] + b["h"] / 2
        outside = F.coalesce(lo < (F.col("above") + F.col("min_y")) / 2, F.lit(False)) | F.coalesce(
            hi > (F.col("l_max_y") + F.col("beneath")) / 2, F.lit(False)
        )
        dx = F.least(F.abs(F.col("min_x") - b["cx"]), F.abs(F.col("l_min_x") - b["cx"]))
        overlap = F.least(hi, F.col("l_max_y")) - F.greatest(lo, F.col("min_y"))
        union = F.greatest(hi, F.col("l_max_y")) - F.least(lo, F.col("min_y"))
        fits = (dx < limit) & (overlap > b["h"] * 0.5) & (overlap > dx)
        iou = F.when(union > 0, F.try_divide(overlap, union)).otherwise(F.lit(0.0))
        return F.when(~outside & fits, iou - F.try_divide(dx, limit)).otherwise(F.lit(0.0))

    best = F.coalesce(F.array_max(F.transform("_braces", score)), F.lit(0.0))
    return joined.select(page, "staff_id", F.col("l_staff_id").alias("next_id"), best.alias("score"))


def crossing_groups(lines: DataFrame, group: str) -> DataFrame:
    """Whether two lines of a group swap order (or meet) between the ends of the x range they share.

    Groups are the candidate lines of one anchor: a handful.
    """
    a = lines.select(group, *[F.col(c).alias("a_" + c) for c in ("line_id", "cx", "cy", "w", "h", "angle")])
    b = lines.select(group, *[F.col(c).alias("b_" + c) for c in ("line_id", "cx", "cy", "w", "h", "angle")])
    ab, bb = G.box("a_"), G.box("b_")
    lo, hi = F.greatest(G.left(ab), G.left(bb)), F.least(G.right(ab), G.right(bb))
    pairs = a.join(b, group).where((F.col("a_line_id") < F.col("b_line_id")) & (lo < hi))
    first = G.y_at(lo, ab) - G.y_at(lo, bb)
    last = G.y_at(hi, ab) - G.y_at(hi, bb)
    flips = (first == 0) | (last == 0) | ((first > 0) != (last > 0))
    crossing = pairs.groupBy(group).agg(F.bool_or(flips).alias("crossing"))
    return lines.select(group).distinct().join(crossing, group, "left").select(group, F.coalesce("crossing", F.lit(False)).alias("crossing"))


def parallel_groups(fragments: DataFrame, group: str, unit: Column) -> DataFrame:
    """Every long fragment (over two units) within ten degrees of the mean angle of its group."""
    away = F.abs(F.col("angle") - F.avg("angle").over(W.partitionBy(group)))
    ok = ~((away > 10) & (F.col("w") > unit * 2))
    return fragments.withColumn("_ok", ok).groupBy(group).agg(F.bool_and("_ok").alias("parallel"))


def heat_map(boxes: DataFrame, page: str, tile: float, origin: float, tiles: int = 20, limit: int = 50) -> DataFrame:
    """Tiles hot themselves with a hot neighbour, per page; none when more than half of the page would go.

    The tile score is an unsigned byte, as in the source material.
    """
    gx = F.floor((F.col("cx") - origin) / tile).cast("int")
    gy = F.floor((F.col("cy") - origin) / tile).cast("int")
    scores = boxes.groupBy(page, gx.alias("gx"), gy.alias("gy")).agg((F.floor(F.sum(F.col("w") * F.col("h")) / 20) % 256).alias("score"))
    hot = scores.where(F.col("score") > limit).select(page, "gx", "gy")
    steps = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    around = hot.withColumn("_d", F.explode(steps)).select(page, (F.col("gx") + F.col("_d.x")).alias("gx"), (F.col("gy") + F.col("_d.y")).alias("gy")).distinct()
    flagged = hot.join(around, [page, "gx", "gy"], "left_semi")
    share = F.count("*").over(W.partitionBy(page)) / (tiles * tiles)
    return flagged.withColumn("_share", share).where("_share <= 0.5").drop("_share")


def count_measures(staffs: DataFrame, min_width: float = 50.0, header: float = 0.15) -> DataFrame:
    """Measures of a staff from its bar positions: `bars` is an array of (x, heavy), `x1` and `x2` the staff ends.

    Left to right, a bar closer than min_width to a kept one (or to an end) is dropped; a heavy first bar in the
    header region does not count.
    """
    bars = F.array_sort("bars")
    start = F.struct(F.lit(True).alias("first"), F.col("x1").alias("last"), F.lit(0).alias("kept"))

    def step(s: Column, b: Column) -> Column:
        skip = (s["first"] & b["heavy"] & (b["x"] < F.col("x1") + (F.col("x2") - F.col("x1")) * header))
        keep = ~skip & (F.abs(b["x"] - s["last"]) >= min_width) & (F.abs(F.col("x2") - b["x"]) >= min_width)
        return F.struct(
            F.lit(False).alias("first"), F.when(keep, b["x"]).otherwise(s["last"]).alias("last"),
            (s["kept"] + keep.cast("int")).alias("kept"),
        )

    kept = F.aggregate(bars, start, step)
    return staffs.withColumn("measures", kept.getField("kept") + F.when(F.col("x2") != F.col("x1"), F.lit(1)).otherwise(F.lit(0)))


def merge_intervals(ranges: DataFrame, keys, end_is_last: bool = True) -> DataFrame:
    """Merge ranges that start before the end of the one before.

    By default the merged end is that of the last range, not the greatest, and only that end is compared with the next
    start; `end_is_last=False` gives the plain union.
    """
    w = W.partitionBy(*keys).orderBy("start", "iv_id")
    reach = F.lag("stop").over(w) if end_is_last else F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    starts = F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")
    runs = ranges.withColumn("_new", starts).withColumn("zone", F.sum("_new").over(w))
    stop = F.max_by("stop", F.struct("start", "iv_id")) if end_is_last else F.max("stop")
    return runs.groupBy(*keys, "zone").agg(F.min("start").alias("start"), stop.alias("stop"), F.count("*").alias("n"))


def rank_groups(lines: DataFrame, keys, size: int = G.STAFF_LINES) -> DataFrame:
    """Groups of `size` lines from top to bottom; nothing for keys whose number of lines does not divide evenly."""
    part = W.partitionBy(*keys)
    rank = F.row_number().over(part.orderBy("cy", "box_id")) - 1
    out = lines.withColumn("_n", F.count("*").over(part)).withColumn("_r", rank).where(F.col("_n") % size == 0)
    return out.withColumn("grp", F.expr(f"_r div {size}")).drop("_n", "_r")


def complete_lines(lines: DataFrame, group: str, unit: Column) -> DataFrame:
    """Add the fifth line of a staff where exactly four evenly spaced ones were found and one end is a unit short.

    lines: group, cy, plus the symbol's sym_top and sym_bottom. Adds rows flagged `added`.
    """
    gaps = F.struct("cy")
    sets = lines.groupBy(group).agg(
        F.array_sort(F.collect_list(gaps)).getField("cy").alias("_ys"), F.first("sym_top").alias("sym_top"), F.first("sym_bottom").alias("sym_bottom"), F.first(unit).alias("_u")
    ).where(F.size("_ys") == G.STAFF_LINES - 1)
    u, tol = F.col("_u"), F.col("_u") * 0.3
    even = F.forall(
        F.zip_with(F.slice("_ys", 2, 3), F.slice("_ys", 1, 3), lambda b, a: b - a), lambda g: F.abs(g - u) <= tol
    )
    above = F.element_at("_ys", 1) - F.col("sym_top")
    below = F.col("sym_bottom") - F.element_at("_ys", -1)
    miss_above = (F.abs(above - u) <= tol) & (below <= tol)
    miss_below = (F.abs(below - u) <= tol) & (above <= tol)
    fixed = sets.where(even & (miss_above != miss_below))
    y = F.when(miss_above, F.element_at("_ys", 1) - u).otherwise(F.element_at("_ys", -1) + u)
    return fixed.select(group, y.alias("cy"))
