"""Connected components and the greedy selections that have to run in order.

Components are computed with distributed label rounds; each round ends in a reliable checkpoint so that a lost executor
does not replay the loop. The greedy selections run per page, a bounded group, and spread over pages.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..session import ensure_checkpoint_dir
from . import layout as L


#: Keys over which a label is spread when its nodes look up where it leads.
SALTS = 16


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the least node id reachable. nodes: node; edges: src, dst in any direction.

    Rounds of large-star / small-star style hooking: every node takes the least label around it, then jumps to the label of its
    label. The number of rounds grows with the logarithm of the component diameter. Every step aggregates with
    map-side combine, so a node with very many edges is no hot spot. Labels that jump on are looked up once each and
    salted, so the one label that most nodes of a giant component share is spread over ``SALTS`` keys.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = both.where("src <> dst").distinct().checkpoint()
    labels = nodes.select("node", F.col("node").alias("label")).checkpoint()
    while True:
        around = links.join(labels, links.dst == labels.node).groupBy("src").agg(F.min("label").alias("near"))
        hooked = labels.join(around, labels.node == around.src, "left").select(
            "node", F.least("label", F.coalesce("near", "label")).alias("hook"), "label"
        )
        target = hooked.select(F.col("node").alias("hook"), F.col("hook").alias("jump")).where("jump < hook")
        jumps = hooked.select("hook").distinct().join(target, "hook").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = hooked.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(jumps, ["hook", "_salt"], "left")
        jumped = salted.select("node", F.coalesce("jump", "hook").alias("label"), F.col("label").alias("old")).checkpoint()
        changed = not jumped.where("label <> old").isEmpty()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))


# ---- ordered selections in bounded groups --------------------------------------------------------------------------
# The rows of a group travel as parallel arrays in one row, in the order the rule walks them; one Arrow batch holds
# thousands of groups, and the answer (a flag or a number per element) is joined back by position in the JVM.


def _packed(rows: DataFrame, keys, order) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("_o"), F.struct(*rest).alias("_r")))).getField("_r")
    return rows.groupBy(*keys).agg(sorted_rows.alias("_rows"))


def _with_answer(packed: DataFrame, keys, udf, columns, name: str) -> DataFrame:
    answer = udf(*[F.col("_rows").getField(c) for c in columns])
    zipped = F.arrays_zip(F.col("_rows").alias("row"), answer.alias("answer"))
    return packed.select(*keys, F.explode(zipped).alias("_z")).select(*keys, "_z.row.*", F.col("_z.answer").alias(name))


def _spaced(distance: float):
    """Kept positions stay sorted, so that only the two neighbours of a new one can be too near."""

    def flags(positions) -> list[bool]:
        kept: list = []
        out = []
        for p in positions:
            at = bisect_left(kept, p)
            free = (at == 0 or p - kept[at - 1] >= distance) and (at == len(kept) or kept[at] - p >= distance)
            if free:
                kept.insert(at, p)
            out.append(free)
        return out

    return F.pandas_udf(lambda s: s.map(flags), TY.ArrayType(TY.BooleanType()))


def spaced_peaks(peaks: DataFrame, key: str, distance: float) -> DataFrame:
    """Highest first, keep a peak when it is at least `distance` away from every kept one (the later one on ties)."""
    packed = _packed(peaks, [key], [-F.col("h"), -F.col("pos")])
    return _with_answer(packed, [key], _spaced(distance), ["pos"], "_keep").where("_keep").select(*peaks.columns)


def _unused(first, second) -> list[bool]:
    used: set = set()
    flags = []
    for a, b in zip(first, second):
        flags.append(a not in used and b not in used)
        if flags[-1]:
            used.update((a, b))
    return flags


def exclusive_pairs(pairs: DataFrame, key: str) -> DataFrame:
    """Best score first, keep a pair when neither member was used. pairs: key, a, b, score."""
    udf = F.pandas_udf(lambda a, b: pd.Series([_unused(x, y) for x, y in zip(a, b)]), TY.ArrayType(TY.BooleanType()))
    packed = _packed(pairs, [key], [-F.col("score"), F.col("a"), F.col("b")])
    return _with_answer(packed, [key], udf, ["a", "b"], "_keep").where("_keep").select(*pairs.columns)


def distinct_staffs(staffs: DataFrame, page: str) -> DataFrame:
    """In order of detection: a staff that overlaps one kept staff replaces it when it has more anchors; one that
    overlaps two or more is dropped. staffs: page, box_id (unique in a page), cx, cy, w, h, anchors (axis-aligned boxes).

    The overlaps come from the grid join; the ordered step of a page sees ids and anchor counts only.
    """
    sides = staffs.select(page, "box_id", "cx", "cy", "w", "h")
    overlaps = L.overlapping_pairs(sides, sides, page).where("b_box_id < a_box_id")
    earlier = overlaps.groupBy(page, F.col("a_box_id").alias("box_id")).agg(F.collect_set("b_box_id").alias("earlier"))
    listed = staffs.select(page, "box_id", "anchors").join(earlier, [page, "box_id"], "left")
    kinds = {c: staffs.schema[c].dataType.simpleString() for c in ("box_id", "anchors")}
    none = F.array().cast(f"array<struct<box_id:{kinds['box_id']},anchors:{kinds['anchors']}>>")

    def step(kept: Column, staff: Column) -> Column:
        rivals = F.filter(kept, lambda k: F.array_contains(staff["earlier"], k["box_id"]))
        own = F.array(F.struct(staff["box_id"].alias("box_id"), staff["anchors"].alias("anchors")))
        stronger = (F.size(rivals) == 1) & F.exists(rivals, lambda k: k["anchors"] < staff["anchors"])
        return F.when((F.size(rivals) == 0) | stronger, F.concat(F.array_except(kept, rivals), own)).otherwise(kept)

    walked = F.struct("box_id", "anchors", F.coalesce("earlier", F.array()).alias("earlier"))
    packed = listed.groupBy(page).agg(F.array_sort(F.collect_list(walked)).alias("_staffs"))
    kept = packed.select(page, F.explode(F.aggregate("_staffs", none, step)).alias("_k")).select(page, "_k.box_id")
    return staffs.join(kept, [page, "box_id"], "left_semi").select(*staffs.columns)


def chain_fragments(fragments: DataFrame, keys) -> DataFrame:
    """Chains of line fragments from left to right: (keys, chain, box_id), chains numbered from top to bottom.

    A fragment is continued by the first later one (by left end, then id) that meets its prolongation: their facing ends
    lie within ten units and their lines within a third of a unit half-way. A chain starts at each fragment that continues
    none, so chains that meet share their tail. Fragments shorter than a fifth of a unit join no chain. Line ends are
    swept at the first left end more than five units past the last sweep: what ended five units before is closed then.
    ``unit`` is the same for all fragments of a key, box_id is unique there.

    Candidates meet in x buckets as wide as two fragments of the key can lie apart.
    """
    keys = list(keys)
    row = F.struct((F.col("cx") - F.col("w") / 2).alias("at"), "box_id", "cx", "cy", "w", F.tan(F.radians("angle")).alias("slope"), "unit")
    lanes = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_f"), F.max(F.col("w") + 10 * F.col("unit")).alias("_reach"))
    never = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("swept"), F.array().cast("array<double>").alias("all"))

    def sweep(acc: Column, f: Column) -> Column:
        due = f["at"] - acc["at"] > 5 * f["unit"]
        swept = F.when(due, f["at"]).otherwise(acc["swept"])
        return F.struct(F.when(due, f["at"]).otherwise(acc["at"]).alias("at"), swept.alias("swept"), F.array_append(acc["all"], swept).alias("all"))

    swept = F.aggregate("_f", never, sweep, lambda acc: acc["all"])
    rows = lanes.select(*keys, "_reach", F.posexplode(F.arrays_zip(F.col("_f").alias("f"), swept.alias("swept"))).alias("i", "_z"))
    numbered = rows.select(*keys, "i", "_z.f.*", "_z.swept", F.floor(F.col("_z.f.cx") / F.col("_reach")).alias("_b"))
    numbered = numbered.withColumn("long", F.col("w") >= F.col("unit") / 5)

    used = numbered.where("long")
    ends = used.select(*keys, "_b", *[F.col(c).alias("e_" + c) for c in ("i", "cx", "cy", "w", "slope", "unit")])
    nexts = used.withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col("_b") + d)))
    half = (F.col("cx") - F.col("e_cx")) / 2
    rise = half * F.col("e_slope") + F.col("e_cy") - (F.col("cy") - half * F.col("slope"))
    closed = F.coalesce(F.col("swept") - F.col("e_cx") - F.col("e_w") / 2 >= 5 * F.col("unit"), F.lit(False))
    met = (F.abs(half) - F.floor(F.least("w", "e_w") / 2) <= 5 * F.col("unit")) & (F.abs(rise) <= F.col("unit") / 3) & ~closed
    links = ends.join(nexts, [*keys, "_b"]).where((F.col("i") > F.col("e_i")) & met).groupBy(*keys, "e_i").agg(F.min("i").alias("i"))
    before = links.groupBy(*keys, "i").agg(F.sort_array(F.collect_list("e_i")).alias("before"))

    item = F.struct("i", "box_id", "cy", "long", F.coalesce("before", F.array().cast("array<int>")).alias("before"))
    walks = numbered.select(*keys, "i", "box_id", "cy", "long").join(before, [*keys, "i"], "left").groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_f"))

    def heads(acc: Column, f: Column) -> Column:
        carried = F.flatten(F.transform(f["before"], lambda e: F.element_at(acc, e + 1)))
        return F.array_append(acc, F.when(F.size(f["before"]) == 0, F.array(f["i"])).otherwise(carried))

    starts = F.array_sort(F.transform(F.filter("_f", lambda f: f["long"] & (F.size(f["before"]) == 0)), lambda f: F.struct(f["cy"].alias("cy"), f["i"].alias("i"))))
    heads_of = F.aggregate("_f", F.array().cast("array<array<int>>"), heads)
    members = walks.select(*keys, starts.getField("i").alias("_starts"), F.explode(F.arrays_zip(F.col("_f").alias("f"), heads_of.alias("heads"))).alias("_z")).where("_z.f.long")
    members = members.select(*keys, "_starts", F.col("_z.f.box_id").alias("box_id"), F.explode("_z.heads").alias("_head"))
    return members.select(*keys, (F.array_position("_starts", F.col("_head")) - 1).cast("int").alias("chain"), "box_id")


def _voices(start, stop) -> list[int]:
    running: list[tuple] = []
    out = []
    for begin, end in zip(start, stop):
        running = [(e, v) for e, v in running if e > begin]
        taken = {v for _, v in running}
        out.append(next(v for v in range(1, len(taken) + 2) if v not in taken))
        running.append((end, out[-1]))
    return out


def colour_intervals(events: DataFrame, keys) -> DataFrame:
    """Voice of each event: by (start, end), the smallest number no running event of its key holds."""
    udf = F.pandas_udf(lambda a, b: pd.Series([_voices(x, y) for x, y in zip(a, b)]), TY.ArrayType(TY.IntegerType()))
    packed = _packed(events, list(keys), [F.col("start"), F.col("stop"), F.col("ev_id")])
    return _with_answer(packed, list(keys), udf, ["start", "stop"], "voice")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fill_staff_lines(points: DataFrame, keys, unit: float) -> DataFrame:
    """Repair missing or jumping line heights along a staff, walking in x.

    points: keys, x, ys (array with NULL for a line not seen). Lines closer than half a unit to the next, or moved by
    more than half a unit since the last whole point, are dropped; gaps are refilled from the nearest line to the left, or
    else the first one. A point without any line left is dropped. Neighbours are counted among the lines seen, and
    their count marks the place to drop.
    """
    apart = unit / 2
    ys = F.transform("ys", lambda y: F.when(~F.isnan(y), y.cast("double")))
    seen = F.filter("_ys", lambda y: y.isNotNull())
    close = F.transform("_seen", lambda y, i: F.coalesce(F.get("_seen", i + 1) - y < apart, F.lit(False)))
    tight = lambda i: F.coalesce(F.get("_close", i), F.lit(False)) | F.coalesce(F.get("_close", i - 1), F.lit(False))
    clear = F.transform("_ys", lambda y, i: F.when(~tight(i), y))
    rows = points.select(*keys, "x", ys.alias("_ys")).withColumn("_seen", seen).withColumn("_close", close).select(*keys, "x", clear.alias("ys"))
    walks = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "ys"))).alias("_p"))

    def filled(steady: Column, places: Column) -> Column:
        def at(y: Column, i: Column) -> Column:
            source = F.coalesce(F.array_max(F.filter(places, lambda p: p <= i)), F.array_min(places))
            return F.coalesce(y, _let(source, lambda p: F.get(steady, p) + unit * (i - p)))

        return F.transform(steady, at)

    def step(acc: Column, point: Column) -> Column:
        last = acc["last"]
        steady = F.transform(point["ys"], lambda y, i: F.when(last.isNull() | (F.abs(y - F.get(last, i)) <= apart), y))
        places = lambda s: F.filter(F.transform(s, lambda y, i: F.when(y.isNotNull(), i)), lambda p: p.isNotNull())
        whole = _let(steady, lambda s: _let(places(s), lambda p: F.when(F.size(p) > 0, filled(s, p))))
        return _let(whole, lambda w: F.struct(F.coalesce(w, last).alias("last"), F.array_append(acc["all"], w).alias("all")))

    start = F.struct(F.lit(None).cast("array<double>").alias("last"), F.array().cast("array<array<double>>").alias("all"))
    out = F.aggregate("_p", start, step, lambda acc: acc["all"])
    zipped = walks.select(*keys, F.explode(F.arrays_zip(F.col("_p.x").alias("x"), out.alias("ys"))).alias("_z"))
    return zipped.select(*keys, "_z.x", "_z.ys").where("ys is not null")
