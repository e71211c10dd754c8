"""Page-layout queries over boxes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..operators import containment as CT
from ..operators import graphs as GR
from ..operators import layout as L
from ..operators import series as SE
from ..session import ensure_checkpoint_dir
from ..sources import bundles, layout_files
from . import bindings as B
from .registry import query

W0, H0 = 800.0, 800.0


def boxes(spark, sf, tilt: bool = False):
    angle = (F.col("kind") * 5 - 20).cast("double") if tilt else F.lit(0.0)
    return B.boxes(spark, sf).withColumn("angle", angle)


def kinds(df, lo: int, hi: int):
    return df.where(F.col("kind").between(lo, hi))


EDGES = "cx - w / 2 AS x1, cx + w / 2 AS x2, cy - h / 2 AS y1, cy + h / 2 AS y2"
BX = B.BOX + f", bx AS (SELECT *, {EDGES} FROM box)"
HIT = "a.page = b.page AND a.x1 <= b.x2 AND b.x1 <= a.x2 AND a.y1 <= b.y2 AND b.y1 <= a.y2"


@query("pf17_size_band", f"WITH {B.BOX} SELECT page, box_id FROM box WHERE w >= 22 AND h >= 20 AND w <= 28")
def size_band(spark, sf):
    max_w, max_h = 28, 0  # 0 means unbounded
    b = B.boxes(spark, sf).where((F.col("w") >= 22) & (F.col("h") >= 20))
    for name, limit in (("w", max_w), ("h", max_h)):
        b = b.where(F.when(F.lit(limit) > 0, F.col(name) <= limit).otherwise(F.lit(True)))
    return b.select("page", "box_id")


UNIT = "u AS (SELECT page, median(h) / 3 AS unit FROM box GROUP BY 1)"


def page_unit(b):
    """Median box height of a page; a page is bounded, so is the exact median."""
    return b.groupBy("page").agg((F.median("h") / 3).alias("unit"))


@query("pf18_bar_line_candidates", f"WITH {B.BOX}, {UNIT} SELECT page, box_id FROM box JOIN u USING (page) WHERE h >= 3 * unit AND w <= 2.5 * unit")
def bar_line_candidates(spark, sf):
    b = B.boxes(spark, sf)
    sized = b.join(page_unit(b), "page")
    return sized.where((F.col("h") >= F.col("unit") * 3) & (F.col("w") <= F.col("unit") * 2.5)).select("page", "box_id")


@query("ag27_median_unit", f"WITH {B.BOX}, {UNIT} SELECT page, unit FROM u")
def median_unit(spark, sf):
    return page_unit(B.boxes(spark, sf))


# Staff points: boxes of kind 0, five lines eight units apart.
POINTS = "pt AS (SELECT page, round_even(cx, 0) AS x, [cy, cy + 8, cy + 16, cy + 24, cy + 32] AS ys, cy FROM box WHERE kind = 0)"
NEAR = f"""{POINTS}, nr AS (SELECT b.page, b.box_id, b.cy, b.h, b.w, pt.x, pt.ys, row_number() OVER (PARTITION BY b.page, b.box_id ORDER BY abs(pt.x - b.cx), pt.x, pt.ys) AS r
  FROM box b JOIN pt ON pt.page = b.page AND abs(pt.x - b.cx) <= 50 WHERE b.kind > 0),
nn AS (SELECT b.page, b.box_id, b.cy, b.h, b.w, nr.x, nr.ys, list_min([abs(y - b.cy) FOR y IN nr.ys]) AS y_distance FROM box b LEFT JOIN nr ON nr.page = b.page AND nr.box_id = b.box_id AND r = 1 WHERE b.kind > 0)"""


def staff_points(b):
    lines = F.array(*[F.col("cy") + 8 * i for i in range(5)])
    return kinds(b, 0, 0).select("page", F.bround("cx").alias("x"), lines.alias("ys"))


def nearest_points(spark, sf):
    b = B.boxes(spark, sf)
    return L.nearest_grid_point(b.where("kind > 0"), staff_points(b), ["page"])


@query("jn07_nearest_grid_point", f"WITH {B.BOX}, {NEAR} SELECT page, box_id, x, y_distance FROM nn")
def nearest_grid_point(spark, sf):
    return nearest_points(spark, sf).select("page", "box_id", "x", "y_distance")


@query("jn09_staff_zone", f"WITH {B.BOX}, {NEAR} SELECT page, box_id, x FROM nn WHERE cy BETWEEN ys[1] - 32 AND ys[5] + 32")
def staff_zone(spark, sf):
    return nearest_points(spark, sf).where(L.on_staff_zone()).select("page", "box_id", "x")


@query("sf09_staff_position", f"""WITH {B.BOX}, {NEAR}, i AS (SELECT *, list_position([abs(y - cy) FOR y IN ys], y_distance) AS ix FROM nn WHERE ys IS NOT NULL)
    SELECT page, box_id, CAST(2 * (5 - (ix - 1)) + round_even(2 * (ys[ix] - cy) / 8, 0) - 1 AS INTEGER) AS staff_position FROM i""")
def staff_position(spark, sf):
    return nearest_points(spark, sf).where("ys is not null").select(
        "page", "box_id", G.staff_position(F.col("ys"), F.col("cy")).alias("staff_position")
    )


@query("pf19_tall_elements", f"""WITH {B.BOX}, {UNIT}, {NEAR} SELECT page, box_id FROM nn JOIN u USING (page) WHERE h > 2 * unit AND w < 3 * unit AND w >= 5
    AND h > 4 * (ys[5] - ys[1]) / 4""")
def tall_elements(spark, sf):
    """A cheap page-wide threshold first, then the unit of the nearest staff."""
    b = B.boxes(spark, sf)
    rough = b.where("kind > 0").join(page_unit(b), "page").where("h > 2 * unit and w < 3 * unit and w >= 5").drop("unit")
    near = L.nearest_grid_point(rough, staff_points(b), ["page"])
    unit = (F.element_at("ys", 5) - F.element_at("ys", 1)) / 4
    return near.where(F.col("h") > unit * 4).select("page", "box_id")


@query("pf20_page_edge", f"""WITH {BX}, a AS (SELECT *, avg(w) OVER (PARTITION BY page) AS mw FROM bx)
    SELECT page, box_id FROM a WHERE NOT (y2 >= 300 OR y1 < -300) AND NOT ((x1 < -200 OR x2 > 200) AND w < mw)""")
def page_edge(spark, sf):
    b = B.boxes(spark, sf).withColumn("mw", F.avg("w").over(W.partitionBy("page")))
    e = {"cx": F.col("cx"), "cy": F.col("cy"), "w": F.col("w"), "h": F.col("h")}
    outside = (G.bottom(e) >= 300) | (G.top(e) < -300)
    margin = (G.left(e) < -200) | (G.right(e) > 200)
    return b.where(~outside & ~(margin & (F.col("w") < F.col("mw")))).select("page", "box_id")


@query("pf24_parallel_groups", f"""WITH {B.BOX}, g AS (SELECT box_id // 4 AS grp, w, kind * 2.0 AS angle FROM box),
    m AS (SELECT *, avg(angle) OVER (PARTITION BY grp) AS ma FROM g) SELECT grp, bool_and(NOT (abs(angle - ma) > 10 AND w > 2 * 11)) AS parallel FROM m GROUP BY 1""")
def parallel_groups(spark, sf):
    b = B.boxes(spark, sf).select(F.expr("box_id div 4").alias("grp"), "w", (F.col("kind") * 2.0).alias("angle"))
    return L.parallel_groups(b, "grp", F.lit(11.0))


@query("jn05_overlap_anti_join", f"""WITH {BX} SELECT a.page, a.box_id FROM bx a WHERE a.kind < 4 AND NOT EXISTS (SELECT 1 FROM bx b WHERE b.kind >= 4 AND {HIT})""")
def overlap_anti_join(spark, sf):
    b = boxes(spark, sf)
    return L.without_overlap(b.where("kind < 4"), b.where("kind >= 4")).select("page", "box_id")


@query("jn06_first_stem", f"""WITH {BX}, hd AS (SELECT page, box_id, cy, cx - (w + 15) / 2 AS x1, cx + (w + 15) / 2 AS x2, cy - (h + 15) / 2 AS y1, cy + (h + 15) / 2 AS y2 FROM box WHERE kind < 5),
    m AS (SELECT a.page, a.box_id, a.cy, min(b.box_id) AS stem_id FROM hd a LEFT JOIN bx b ON b.kind >= 5 AND {HIT} GROUP BY 1, 2, 3)
    SELECT m.page, m.box_id, stem_id, CASE WHEN s.cy < m.cy THEN 'UP' WHEN stem_id IS NOT NULL THEN 'DOWN' END AS direction FROM m LEFT JOIN box s ON s.box_id = stem_id""")
def first_stem(spark, sf):
    b = boxes(spark, sf)
    return L.attach_stems(b.where("kind < 5"), b.where("kind >= 5")).select("page", "box_id", "stem_id", "direction")


@query("jn10_rectangle_join", f"WITH {BX} SELECT a.page, a.box_id AS a_box_id, b.box_id AS b_box_id FROM bx a JOIN bx b ON a.kind < 5 AND b.kind >= 5 AND {HIT}")
def rectangle_join(spark, sf):
    b = boxes(spark, sf)
    return L.overlapping_pairs(b.where("kind < 5"), b.where("kind >= 5")).select("page", "a_box_id", "b_box_id")


PROBE = """ab AS (SELECT p.line, p.iv_id AS probe_id, coalesce(max(CASE WHEN r.start < p.start THEN r.stop END), 0) * 1.0e0 AS above,
  coalesce(min(CASE WHEN r.stop > p.start THEN r.start END), 1e12) * 1.0e0 AS below FROM iv p JOIN iv r USING (line) GROUP BY 1, 2)"""


def above_below(spark, sf):
    iv = B.intervals(spark, sf)
    probes = iv.select("line", F.col("iv_id").alias("probe_id"), F.col("start").alias("y"))
    return L.nearest_above_below(probes, iv, ["line"])


@query("jn08_nearest_above_below", f"WITH {B.IV}, {PROBE} SELECT line, probe_id, above, below FROM ab")
def nearest_above_below(spark, sf):
    return above_below(spark, sf)


@query("jn08_nearest_box_heights", f"""WITH {B.BOX}, r AS (SELECT page, cy - h / 2 AS start, cy + h / 2 AS stop FROM box WHERE kind % 2 = 0)
    SELECT p.page, p.box_id AS probe_id, coalesce(max(CASE WHEN r.start < p.cy THEN r.stop END), 0.0e0) AS above,
      coalesce(min(CASE WHEN r.stop > p.cy THEN r.start END), 1e12) AS below
    FROM box p LEFT JOIN r ON r.page = p.page GROUP BY 1, 2""")
def nearest_box_heights(spark, sf):
    """Fractional heights: every box centre against the even kinds' spans of its page."""
    box = B.boxes(spark, sf)
    probes = box.select("page", F.col("box_id").alias("probe_id"), F.col("cy").alias("y"))
    spans = box.where("kind % 2 = 0").select("page", (F.col("cy") - F.col("h") / 2).alias("start"), (F.col("cy") + F.col("h") / 2).alias("stop"))
    return L.nearest_above_below(probes, spans, ["page"])


@query("jn22_region_clamp", f"""WITH {B.IV}, {PROBE} SELECT a.line, probe_id, greatest(start - 5, above) * 1.0e0 AS start, least(stop + 5, below) * 1.0e0 AS stop
    FROM ab a JOIN iv ON iv_id = probe_id AND iv.line = a.line""")
def region_clamp(spark, sf):
    iv = B.intervals(spark, sf).withColumnRenamed("iv_id", "probe_id")
    joined = iv.join(above_below(spark, sf), ["line", "probe_id"])
    region = G.clamp_region(F.col("start").cast("double"), F.col("stop").cast("double"), F.lit(5.0), F.col("above"), F.col("below"))
    return joined.select("line", "probe_id", region.alias("_r")).select("line", "probe_id", "_r.*")


@query("jn11_nearest_staff", f"""WITH {BX}, r AS (SELECT s.page, s.box_id, t.box_id AS staff_id, NOT (s.cx BETWEEN t.x1 AND t.x2) AS outside,
      row_number() OVER (PARTITION BY s.box_id ORDER BY NOT (s.cx BETWEEN t.x1 AND t.x2), abs(s.cy - t.cy), t.box_id) AS r FROM bx s LEFT JOIN bx t ON t.page = s.page AND t.kind < 3 WHERE s.kind >= 3)
    SELECT page, box_id, staff_id, outside FROM r WHERE r = 1""")
def nearest_staff(spark, sf):
    b = B.boxes(spark, sf)
    return L.nearest_staff(b.where("kind >= 3"), b.where("kind < 3")).select("page", "box_id", "staff_id", "outside")


@query("jn12_empty_measures", f"""WITH {B.BOX}, m AS (SELECT page, cx AS start, lead(cx) OVER w AS stop, lead(cx, 2) OVER w AS aft FROM box WHERE kind < 5 WINDOW w AS (PARTITION BY page ORDER BY cx))
    SELECT page, start, stop, CASE WHEN aft IS NULL THEN start ELSE stop END AS dropped FROM m WHERE stop IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM box n WHERE n.page = m.page AND n.kind >= 5 AND n.cx >= start - 5 AND n.cx < stop)""")
def empty_measures(spark, sf):
    b = B.boxes(spark, sf)
    bars = b.where("kind < 5").select("page", F.col("cx").alias("x"))
    return L.empty_measures(bars, b.where("kind >= 5"))


@query("jn13_staff_connections", f"""WITH {BX}, a0 AS (SELECT page, box_id, cx - (w + 30) / 2 AS x1, cx + (w + 30) / 2 AS x2, cy - (h + 30) / 2 AS y1, cy + (h + 30) / 2 AS y2 FROM box WHERE kind >= 5),
    t AS (SELECT DISTINCT a.page, a.box_id, CAST(floor((b.cy + 400) / 50) AS BIGINT) AS staff FROM a0 a JOIN bx b ON b.kind < 5 AND {HIT})
    SELECT t.page, t.staff, t.box_id FROM t JOIN t n ON n.page = t.page AND n.box_id = t.box_id AND n.staff = t.staff + 1""")
def staff_connections(spark, sf):
    b = boxes(spark, sf)
    items = b.where("kind < 5").withColumn("staff", F.floor((F.col("cy") + 400) / 50))
    return L.connections(b.where("kind >= 5"), items)


GRIDS = """ga AS (SELECT seq_id, k AS x, arg_max(value, pos) AS y, count(*) * 1.0 AS angle FROM evt WHERE user_id % 2 = 0 GROUP BY 1, 2),
gb AS (SELECT seq_id, k AS x, arg_max(value, pos) AS y, count(*) * 1.0 AS angle FROM evt WHERE user_id % 2 = 1 GROUP BY 1, 2)"""


def grid(spark, sf, side: int):
    t = B.evt(spark, sf).where(F.col("user_id") % 2 == side)
    return t.groupBy("seq_id", F.col("k").alias("x")).agg(F.max_by("value", "pos").alias("y"), (F.count("*") * 1.0).alias("angle"))


@query("jn14_grid_inner_join", f"""WITH {B.EVT}, {GRIDS} SELECT seq_id, x, least(ga.y, gb.y) AS y1, greatest(ga.y, gb.y) AS y2, CAST((ga.angle + gb.angle) / 2 AS DOUBLE) AS angle
    FROM ga JOIN gb USING (seq_id, x)""")
def grid_inner_join(spark, sf):
    """Merge two staffs on equal rounded x: heights concatenated and sorted, angles averaged."""
    a = grid(spark, sf, 0).withColumnsRenamed({"y": "ya", "angle": "aa"})
    b = grid(spark, sf, 1).withColumnsRenamed({"y": "yb", "angle": "ab"})
    ys = F.array_sort(F.array("ya", "yb"))
    angle = ((F.col("aa") + F.col("ab")) / 2).cast("double")
    return a.join(b, ["seq_id", "x"]).select("seq_id", "x", ys[0].alias("y1"), ys[1].alias("y2"), angle.alias("angle"))


@query("so07_key_intersection", f"WITH {B.EVT}, {GRIDS} SELECT seq_id, x FROM ga INTERSECT SELECT seq_id, x FROM gb")
def key_intersection(spark, sf):
    return grid(spark, sf, 0).select("seq_id", "x").intersect(grid(spark, sf, 1).select("seq_id", "x"))


@query("so13_edge_extension", f"""WITH {B.EVT}, {GRIDS}, e AS (SELECT seq_id, min(x) AS lo, max(x) AS hi, arg_min(y, x) AS ylo, arg_max(y, x) AS yhi FROM ga GROUP BY 1)
    SELECT seq_id, x, y FROM ga UNION ALL SELECT seq_id, 10, ylo FROM e WHERE 10 < lo UNION ALL SELECT seq_id, 95, yhi FROM e WHERE 95 > hi""")
def edge_extension(spark, sf):
    g = grid(spark, sf, 0).select("seq_id", "x", "y")
    ends = g.groupBy("seq_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min_by("y", "x").alias("ylo"), F.max_by("y", "x").alias("yhi"))
    left = ends.where("10 < lo").select("seq_id", F.lit(10).alias("x"), F.col("ylo").alias("y"))
    right = ends.where("95 > hi").select("seq_id", F.lit(95).alias("x"), F.col("yhi").alias("y"))
    return g.unionByName(left).unionByName(right)


STAFFS = """sf AS (SELECT page, box_id AS staff_id, cx - w * 2 AS min_x, cy - h AS min_y, cy + h AS max_y, h / 4 AS unit FROM box WHERE kind < 3)"""


def staff_rows(b):
    return kinds(b, 0, 2).select(
        "page", F.col("box_id").alias("staff_id"), (F.col("cx") - F.col("w") * 2).alias("min_x"), (F.col("cy") - F.col("h")).alias("min_y"),
        (F.col("cy") + F.col("h")).alias("max_y"), (F.col("h") / 4).alias("unit"),
    )


BRACES = f"""{B.BOX}, {STAFFS}, p AS (SELECT *, lead(staff_id) OVER w AS lid, lead(min_x) OVER w AS lx, lead(min_y) OVER w AS ly, lead(max_y) OVER w AS lm, lead(unit) OVER w AS lu,
      lag(max_y) OVER w AS above, lead(min_y, 2) OVER w AS beneath FROM sf WINDOW w AS (PARTITION BY page ORDER BY min_y, staff_id)),
    b AS (SELECT page, cx, cy - h * 1.5 AS lo, cy + h * 1.5 AS hi, h * 3 AS bh FROM box WHERE kind >= 3),
    c AS (SELECT p.*, cx, lo, hi, bh, least(abs(min_x - cx), abs(lx - cx)) AS dx, least(hi, lm) - greatest(lo, min_y) AS ov, greatest(hi, lm) - least(lo, min_y) AS un, (unit + lu) / 2 * 5 AS lim FROM p LEFT JOIN b USING (page) WHERE lid IS NOT NULL),
    s AS (SELECT *, CASE WHEN NOT (coalesce(lo < (above + min_y) / 2, false) OR coalesce(hi > (lm + beneath) / 2, false)) AND dx < lim AND ov > bh * 0.5 AND ov > dx
      THEN CASE WHEN un > 0 THEN ov / un ELSE 0 END - dx / lim ELSE 0 END AS sc FROM c),
    br AS (SELECT page, staff_id, lid AS next_id, coalesce(max(sc), 0.0) AS score FROM s GROUP BY 1, 2, 3)"""


@query("jn18_brace_scores", f"WITH {BRACES} SELECT page, staff_id, next_id, score FROM br")
def brace_scores(spark, sf):
    b = B.boxes(spark, sf)
    return L.brace_scores(staff_rows(b), b.where("kind >= 3").withColumn("h", F.col("h") * 3))


def scored_pairs(spark, sf):
    s = brace_scores(spark, sf).where("score > 0")
    return s.select("page", F.col("staff_id").alias("a"), F.col("next_id").alias("b"), "score")


@query("sq12_grand_staff_selection", f"""WITH RECURSIVE {BRACES}, rk AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, staff_id, next_id) AS i FROM br WHERE score > 0),
    r AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS used, false AS hit FROM rk UNION ALL
      SELECT r.page, rk.i, CASE WHEN list_contains(used, staff_id) OR list_contains(used, next_id) THEN used ELSE list_concat(used, [staff_id, next_id]) END,
        NOT (list_contains(used, staff_id) OR list_contains(used, next_id)) FROM r JOIN rk ON rk.page = r.page AND rk.i = r.i + 1)
    SELECT rk.page, staff_id AS a, next_id AS b, score FROM rk JOIN r ON r.page = rk.page AND r.i = rk.i AND hit""")
def grand_staff_selection(spark, sf):
    """Best pairs first, each staff once; the rest stay single."""
    return GR.exclusive_pairs(scored_pairs(spark, sf), "page")


LINES = """ln AS (SELECT iv_id // 5 AS grp, iv_id AS line_id, (start + stop) / 2 AS cx, price / 10000 AS cy, (stop - start) * 40.0 AS w, 2.0 AS h, CAST(cust % 21 - 10 AS DOUBLE) / 200 AS angle FROM iv)"""


@query("jn19_order_inversion", f"""WITH {B.IV}, {LINES}, p AS (SELECT a.grp, a.cx AS acx, a.cy AS acy, tan(radians(a.angle)) AS ta, b.cx AS bcx, b.cy AS bcy, tan(radians(b.angle)) AS tb,
      greatest(a.cx - a.w / 2, b.cx - b.w / 2) AS lo, least(a.cx + a.w / 2, b.cx + b.w / 2) AS hi FROM ln a JOIN ln b ON a.grp = b.grp AND a.line_id < b.line_id),
    d AS (SELECT grp, (lo - acx) * ta + acy - ((lo - bcx) * tb + bcy) AS d1, (hi - acx) * ta + acy - ((hi - bcx) * tb + bcy) AS d2 FROM p WHERE lo < hi)
    SELECT g.grp, coalesce(bool_or(d1 = 0 OR d2 = 0 OR (d1 > 0) <> (d2 > 0)), false) AS crossing FROM (SELECT DISTINCT grp FROM ln) g LEFT JOIN d USING (grp) GROUP BY 1""")
def order_inversion(spark, sf):
    lines = B.intervals(spark, sf).select(
        F.expr("iv_id div 5").alias("grp"), F.col("iv_id").alias("line_id"), ((F.col("start") + F.col("stop")) / 2).alias("cx"), (F.col("price") / 10000).alias("cy"),
        ((F.col("stop") - F.col("start")) * 40.0).alias("w"), F.lit(2.0).alias("h"), ((F.col("cust") % 21 - 10).cast("double") / 200).alias("angle"),
    )
    return L.crossing_groups(lines, "grp")


# ---- fragments, anchors, staffs ------------------------------------------------------------------------------------


FR = """fr AS (SELECT page, box_id * 5 + g.n AS box_id, cx, cy + (g.n - 2) * 10 AS cy, tan(radians(kind * 0.5)) AS slope, row_number() OVER (PARTITION BY page ORDER BY cx - 30, box_id * 5 + g.n) AS i
      FROM box, (SELECT unnest(range(5)) AS n) g)"""


def fragments(spark, sf):
    """Every box gives five line fragments, ten apart; the unit of a page is ten."""
    b = boxes(spark, sf)
    i = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")
    return b.select("page", "box_id", "cx", "cy", "kind", i).select(
        "page", (F.col("box_id") * 5 + F.col("i")).alias("box_id"), "cx", (F.col("cy") + (F.col("i") - 2) * 10).alias("cy"), F.lit(60.0).alias("w"), F.lit(2.0).alias("h"),
        (F.col("kind") * 0.5).alias("angle"), F.lit(10.0).alias("unit"),
    )


@query("sq14_fragment_chains", f"""WITH RECURSIVE {B.BOX}, {FR},
    sw AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS swept, false AS any_sweep FROM fr UNION ALL
      SELECT fr.page, fr.i, CASE WHEN cx - 30 - swept > 50 THEN cx - 30 ELSE swept END, any_sweep OR cx - 30 - swept > 50 FROM sw JOIN fr ON fr.page = sw.page AND fr.i = sw.i + 1),
    nx AS (SELECT a.page, a.i, min(b.i) AS nxt FROM fr a JOIN fr b ON a.page = b.page AND a.i < b.i JOIN sw ON sw.page = b.page AND sw.i = b.i
      WHERE NOT (any_sweep AND swept - a.cx - 30 >= 50) AND abs(b.cx - a.cx) / 2 - 30 <= 50 AND abs((b.cx - a.cx) / 2 * (a.slope + b.slope) + a.cy - b.cy) <= 10 / 3.0 GROUP BY 1, 2),
    hd AS (SELECT fr.page, fr.i, CAST(row_number() OVER (PARTITION BY fr.page ORDER BY cy, fr.i) - 1 AS INTEGER) AS chain FROM fr LEFT JOIN (SELECT DISTINCT page, nxt FROM nx) k ON k.page = fr.page AND k.nxt = fr.i WHERE k.nxt IS NULL),
    pa AS (SELECT * FROM hd UNION ALL SELECT pa.page, nx.nxt, pa.chain FROM pa JOIN nx ON nx.page = pa.page AND nx.i = pa.i)
    SELECT pa.page, chain, box_id FROM pa JOIN fr ON fr.page = pa.page AND fr.i = pa.i""")
def fragment_chains(spark, sf):
    return GR.chain_fragments(fragments(spark, sf), ["page"])


def anchors(spark, sf):
    """Probe each symbol at five shifted places; five parallel, uncrossed chains there make an anchor."""
    shifts = F.explode(F.array(*[F.lit(float(d)) for d in (-10, -5, 0, 5, 10)])).alias("dx")
    symbols = kinds(boxes(spark, sf), 0, 4).select("page", F.col("box_id").alias("symbol"), "cx", "cy", F.lit(3.0).alias("w"), F.lit(40.0).alias("h"), "angle", shifts)
    probes = symbols.select(
        "page", F.concat_ws("_", "symbol", F.col("dx").cast("int")).alias("box_id"), (F.col("cx") + F.col("dx")).alias("cx"), "cy", "w", (F.col("h") + 10).alias("h"), "angle"
    )
    hit = L.overlapping_pairs(probes, fragments(spark, sf), rotated=True)
    lines = hit.select(
        "page", F.col("a_box_id").alias("probe"), F.col("b_box_id").alias("box_id"), F.col("a_cx").alias("sym_x"), F.col("a_cy").alias("sym_y"),
        *[F.col("b_" + c).alias(c) for c in ("cx", "cy", "w", "h", "angle")], F.lit(10.0).alias("unit"),
    )
    chains = GR.chain_fragments(lines, ["page", "probe"])
    # five plans read the chains; the checkpoint keeps the grouped Python step from running five times
    ensure_checkpoint_dir(spark)
    tagged = chains.join(lines, ["page", "probe", "box_id"]).checkpoint()
    heads = tagged.groupBy("page", "probe", "chain").agg(F.min_by(F.struct("cx", "cy", "w", "h", "angle"), F.struct("cx", "box_id")).alias("_f"), F.min("box_id").alias("line_id"))
    five = heads.groupBy("page", "probe").agg(F.count("*").alias("n")).where(F.col("n") == G.STAFF_LINES).select("page", "probe")
    kept = tagged.join(five, ["page", "probe"], "left_semi")
    parallel = L.parallel_groups(kept, "probe", F.lit(10.0)).where("parallel").select("probe")
    straight = L.crossing_groups(heads.select("probe", "line_id", "_f.*"), "probe").where("not crossing").select("probe")
    near = kept.where(F.abs(G.y_at(F.col("sym_x"), G.box()) - F.col("sym_y")) < 10).select("probe").distinct()
    ok = five.join(parallel, "probe", "left_semi").join(straight, "probe", "left_semi").join(near, "probe", "left_semi")
    return kept.join(ok, ["page", "probe"], "left_semi").groupBy("page", "probe").agg(
        F.first("sym_x").alias("x"), F.min("cy").alias("min_y"), F.max("cy").alias("max_y"), ((F.max("cy") - F.min("cy")) / 4).alias("unit"), F.count("*").alias("fragments")
    )


query("jn20_anchor_probes")(anchors)


@query("jn24_predicted_anchors", f"""WITH {BX}, kn AS (SELECT * FROM bx WHERE kind IN (0, 1)),
    rg AS (SELECT page, box_id AS iv_id, CAST(trunc(cx - w / 2) AS INTEGER) AS start, CAST(trunc(cx + w / 2 + 10) AS INTEGER) AS stop FROM kn),
    nw AS (SELECT *, CASE WHEN start < lag(stop) OVER w THEN 0 ELSE 1 END AS fresh FROM rg WINDOW w AS (PARTITION BY page ORDER BY start, iv_id)),
    zn AS (SELECT *, sum(fresh) OVER (PARTITION BY page ORDER BY start, iv_id) AS zone FROM nw),
    zones AS (SELECT page, CAST(zone AS BIGINT) AS zone, min(start) AS start, last(stop ORDER BY start, iv_id) AS stop FROM zn GROUP BY page, zone),
    lines AS (SELECT DISTINCT box.page, zone, start, stop, CAST(round_even(cy + (g.n - 2) * 10, 0) AS INTEGER) AS y
      FROM box, (SELECT unnest(range(5)) AS n) g, zones z WHERE z.page = box.page AND cx >= start AND cx < stop),
    gp AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page, zone ORDER BY y) > 15 THEN 1 ELSE 0 END AS gap FROM lines),
    gr AS (SELECT *, sum(gap) OVER (PARTITION BY page, zone ORDER BY y) AS grp FROM gp),
    fd AS (SELECT page, zone || '_' || grp AS box_id, (start + stop) / 2.0 AS cx, (min(y) + max(y)) / 2.0 AS cy, CAST(stop - start AS DOUBLE) AS w, CAST(max(y) - min(y) AS DOUBLE) AS h
      FROM gr GROUP BY page, zone, grp, start, stop HAVING count(*) = 5)
    SELECT page, box_id, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy, w, h FROM fd WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.page = fd.page
      AND fd.cx - fd.w / 2 <= kn.x2 AND kn.x1 <= fd.cx + fd.w / 2 AND fd.cy - fd.h / 2 <= kn.y2 AND kn.y1 <= fd.cy + fd.h / 2)""")
def predicted_anchors(spark, sf):
    """Merged zones of known symbols, five-line groups in their projection profile, minus what overlaps a known one."""
    b = boxes(spark, sf)
    known = kinds(b, 0, 1)
    ranges = known.select("page", F.col("box_id").alias("iv_id"), G.left(G.box()).cast("int").alias("start"), (G.right(G.box()) + 10).cast("int").alias("stop"))
    zones = L.merge_intervals(ranges, ["page"]).select("page", "zone", "start", "stop")
    inside = fragments(spark, sf).join(zones, "page").where((F.col("cx") >= F.col("start")) & (F.col("cx") < F.col("stop")))
    rows = inside.groupBy("page", "zone", F.bround("cy").cast("int").alias("y")).agg(F.count("*").alias("n"), F.first("start").alias("start"), F.first("stop").alias("stop"))
    w = W.partitionBy("page", "zone").orderBy("y")
    gap = F.coalesce(F.col("y") - F.lag("y").over(w) > 15, F.lit(False)).cast("int")
    groups = rows.withColumn("_g", gap).withColumn("grp", F.sum("_g").over(w)).groupBy("page", "zone", "grp").agg(
        F.count("*").alias("lines"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.first("start").alias("start"), F.first("stop").alias("stop")
    ).where(F.col("lines") == G.STAFF_LINES)
    found = groups.select(
        "page", F.concat_ws("_", "zone", "grp").alias("box_id"), ((F.col("start") + F.col("stop")) / 2).alias("cx"), ((F.col("lo") + F.col("hi")) / 2).alias("cy"),
        (F.col("stop") - F.col("start")).cast("double").alias("w"), (F.col("hi") - F.col("lo")).cast("double").alias("h"), F.lit(0.0).alias("angle"),
    )
    return L.without_overlap(found, known).select("page", "box_id", "cx", "cy", "w", "h")


@query("jn21_set_containment", """WITH iw AS (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS word FROM benchmark),
    dw AS (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS word FROM documents),
    n AS (SELECT item_id, count(*) AS need FROM iw GROUP BY 1)
    SELECT item_id, doc_id FROM iw JOIN dw USING (word) JOIN n USING (item_id) GROUP BY item_id, doc_id, need HAVING count(*) = need""")
def set_containment(spark, sf):
    """Documents that hold every word of an item."""
    items = B.table(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("words"))
    docs = B.table(spark, sf, "documents").select("doc_id", F.split("text", " ").alias("words"))
    return CT.containing(docs, "doc_id", items, "item_id", "words")


@query("sq13_connected_components", f"""WITH RECURSIVE {BX}, e AS (SELECT a.box_id AS s, b.box_id AS t FROM bx a JOIN bx b ON {HIT} AND a.box_id <> b.box_id),
    r AS (SELECT box_id AS node, box_id AS label FROM bx UNION SELECT e.t, r.label FROM r JOIN e ON e.s = r.node)
    SELECT node, min(label) AS component FROM r GROUP BY 1""")
def connected_components(spark, sf):
    b = boxes(spark, sf)
    edges = L.overlapping_pairs(b, b).where("a_box_id < b_box_id").select(F.col("a_box_id").alias("src"), F.col("b_box_id").alias("dst"))
    return GR.connected_components(b.select(F.col("box_id").alias("node")), edges)


@query("so10_distinct_staffs", f"""WITH RECURSIVE {BX}, rn AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY box_id) AS i FROM bx),
    ov AS (SELECT a.page, a.i, list(b.i) AS near FROM rn a JOIN rn b ON {HIT} AND b.i < a.i GROUP BY 1, 2),
    st AS (SELECT rn.page, rn.i, rn.kind, coalesce(near, CAST([] AS BIGINT[])) AS near FROM rn LEFT JOIN ov ON ov.page = rn.page AND ov.i = rn.i),
    w AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, n BIGINT)[]) AS kept FROM st UNION ALL
      SELECT page, i, CASE WHEN len(r) = 0 THEN list_append(kept, {{'i': i, 'n': kind}}) WHEN len(r) = 1 AND r[1].n < kind THEN list_append([k FOR k IN kept IF k.i <> r[1].i], {{'i': i, 'n': kind}}) ELSE kept END
      FROM (SELECT st.page, st.i, CAST(st.kind AS BIGINT) AS kind, kept, [k FOR k IN kept IF list_contains(near, k.i)] AS r FROM w JOIN st ON st.page = w.page AND st.i = w.i + 1)),
    f AS (SELECT page, arg_max([k.i FOR k IN kept], i) AS kept FROM w GROUP BY 1)
    SELECT rn.page, box_id, cx, cy, w, h, kind AS anchors FROM rn JOIN f ON f.page = rn.page AND list_contains(kept, rn.i)""")
def distinct_staffs(spark, sf):
    b = boxes(spark, sf).select("page", "box_id", "cx", "cy", "w", "h", F.col("kind").alias("anchors"))
    return GR.distinct_staffs(b, "page")


@query("sq11_spaced_peaks", f"""WITH RECURSIVE {B.EVT}, v AS (SELECT seq_id, pos, value AS h FROM evt UNION ALL SELECT seq_id, min(pos) - 1, 0.0 FROM evt GROUP BY 1 UNION ALL SELECT seq_id, max(pos) + 1, 0.0 FROM evt GROUP BY 1),
    rn AS (SELECT *, CASE WHEN h IS NOT DISTINCT FROM lag(h) OVER (PARTITION BY seq_id ORDER BY pos) THEN 0 ELSE 1 END AS nw FROM v),
    rg AS (SELECT *, sum(nw) OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM rn), rr AS (SELECT seq_id, run, min(pos) AS lo, max(pos) AS hi, min(h) AS h FROM rg GROUP BY 1, 2),
    pk AS (SELECT *, lag(h) OVER (PARTITION BY seq_id ORDER BY run) AS lh, lead(h) OVER (PARTITION BY seq_id ORDER BY run) AS rh FROM rr),
    rk AS (SELECT seq_id, CAST((lo + hi) // 2 AS INTEGER) AS pos, h, row_number() OVER (PARTITION BY seq_id ORDER BY h DESC, (lo + hi) // 2 DESC) AS i FROM pk WHERE h > lh AND h > rh),
    s AS (SELECT DISTINCT seq_id, CAST(0 AS BIGINT) AS i, CAST([] AS INTEGER[]) AS kept FROM rk UNION ALL
      SELECT s.seq_id, rk.i, CASE WHEN len([p FOR p IN kept IF abs(p - pos) < 5]) = 0 THEN list_append(kept, pos) ELSE kept END FROM s JOIN rk ON rk.seq_id = s.seq_id AND rk.i = s.i + 1),
    f AS (SELECT seq_id, arg_max(kept, i) AS kept FROM s GROUP BY 1)
    SELECT rk.seq_id, rk.pos, rk.h FROM rk JOIN f ON f.seq_id = rk.seq_id AND list_contains(kept, pos)""")
def spaced_peaks(spark, sf):
    rows = B.evt(spark, sf).select("seq_id", "pos", "value")
    peaks = SE.local_maxima(SE.zero_padded(rows), "value").withColumnRenamed("value", "h")
    return GR.spaced_peaks(peaks, "seq_id", 5)


EV16 = "ev AS (SELECT seq_id AS measure, position AS staff, event_id AS ev_id, k AS start, k + 1 + pos % 7 AS stop FROM evt WHERE position <> '.')"


def timed_events(spark, sf):
    return B.evt(spark, sf).where("position <> '.'").select(
        F.col("seq_id").alias("measure"), F.col("position").alias("staff"), F.col("event_id").alias("ev_id"), F.col("k").alias("start"), (F.col("k") + 1 + F.col("pos") % 7).alias("stop")
    )


@query("sq16_interval_colouring", f"""WITH RECURSIVE {B.EVT}, {EV16}, rn AS (SELECT *, row_number() OVER (PARTITION BY measure, staff ORDER BY start, stop, ev_id) AS i FROM ev),
    w AS (SELECT DISTINCT measure, staff, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(e BIGINT, v BIGINT)[]) AS run, CAST(0 AS BIGINT) AS voice FROM rn UNION ALL
      SELECT measure, staff, i, list_append(busy, {{'e': stop, 'v': v}}), v FROM (SELECT *, list_min([x FOR x IN range(1, len(busy) + 2) IF NOT list_contains([b.v FOR b IN busy], x)]) AS v
        FROM (SELECT w.measure, w.staff, rn.i, CAST(rn.stop AS BIGINT) AS stop, [r FOR r IN run IF r.e > rn.start] AS busy FROM w JOIN rn ON rn.measure = w.measure AND rn.staff = w.staff AND rn.i = w.i + 1)))
    SELECT rn.measure, rn.staff, ev_id, start, stop, CAST(voice AS INTEGER) AS voice FROM w JOIN rn ON rn.measure = w.measure AND rn.staff = w.staff AND rn.i = w.i""")
def interval_colouring(spark, sf):
    return GR.colour_intervals(timed_events(spark, sf), ["measure", "staff"])


@query("sq16_voices_needed", f"""WITH {B.EVT}, {EV16}, d AS (SELECT a.measure, a.staff, a.ev_id, count(*) AS depth FROM ev a JOIN ev b ON a.measure = b.measure AND a.staff = b.staff AND b.start <= a.start AND b.stop > a.start GROUP BY 1, 2, 3)
    SELECT measure, staff, max(depth) AS voices, CAST(0 AS BIGINT) AS clashes FROM d GROUP BY 1, 2""")
def voices_needed(spark, sf):
    """The colouring uses exactly as many voices as events overlap at most, and no voice overlaps itself."""
    coloured = interval_colouring(spark, sf)
    w = W.partitionBy("measure", "staff", "voice").orderBy("start", "stop", "ev_id")
    clash = F.coalesce(F.lag("stop").over(w) > F.col("start"), F.lit(False)).cast("bigint")
    return coloured.withColumn("_c", clash).groupBy("measure", "staff").agg(F.max("voice").cast("bigint").alias("voices"), F.sum("_c").alias("clashes"))


@query("wn20_line_repair", f"""WITH RECURSIVE {B.BOX}, pt AS (SELECT page, cx AS x, [CASE WHEN (box_id + i) % 4 <> 0 THEN i * CAST(10 AS DOUBLE) + cy / 100 END FOR i IN [0, 1, 2, 3, 4]] AS ys, row_number() OVER (PARTITION BY page ORDER BY cx) AS n FROM box),
    w AS (SELECT DISTINCT page, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE[]) AS prev, CAST(NULL AS DOUBLE[]) AS ys FROM pt UNION ALL
      SELECT page, n, coalesce(filled, prev), filled FROM (SELECT page, n, prev, CASE WHEN len(seen) > 0 THEN [coalesce(st[i], st[coalesce(list_max([s FOR s IN seen IF s <= i]), seen[1])] + 10 * (i - coalesce(list_max([s FOR s IN seen IF s <= i]), seen[1]))) FOR i IN [1, 2, 3, 4, 5]] END AS filled
        FROM (SELECT *, [i FOR i IN [1, 2, 3, 4, 5] IF st[i] IS NOT NULL] AS seen FROM (SELECT pt.page, pt.n, prev, [CASE WHEN prev IS NULL OR abs(pt.ys[i] - prev[i]) <= 5 THEN pt.ys[i] END FOR i IN [1, 2, 3, 4, 5]] AS st FROM w JOIN pt ON pt.page = w.page AND pt.n = w.n + 1))))
    SELECT pt.page, x, w.ys FROM w JOIN pt ON pt.page = w.page AND pt.n = w.n WHERE w.ys IS NOT NULL""")
def line_repair(spark, sf):
    """Staff points of a page with some lines not seen."""
    b = boxes(spark, sf)
    lines = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when((F.col("box_id") + i) % 4 != 0, i * 10.0 + F.col("cy") / 100))
    return GR.fill_staff_lines(b.select("page", F.col("cx").alias("x"), lines.alias("ys")), ["page"], 10.0)


# ---- windows and groups over boxes ---------------------------------------------------------------------------------


@query("ag17_group_bounds", f"""WITH {BX} SELECT page, kind, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, median(h) AS mid_h, count(*) AS n FROM bx GROUP BY 1, 2""")
def group_bounds(spark, sf):
    b, g = boxes(spark, sf), G.box()
    return b.groupBy("page", "kind").agg(
        F.min(G.left(g)).alias("x1"), F.min(G.top(g)).alias("y1"), F.max(G.right(g)).alias("x2"), F.max(G.bottom(g)).alias("y2"), F.median("h").alias("mid_h"), F.count("*").alias("n")
    )


@query("ag19_heat_map", f"""WITH {B.BOX}, s AS (SELECT page, CAST(floor((cx + 400) / 40) AS INTEGER) AS gx, CAST(floor((cy + 400) / 40) AS INTEGER) AS gy, CAST(floor(sum(w * h) / 20) AS BIGINT) % 256 AS score FROM box GROUP BY 1, 2, 3),
    h AS (SELECT * FROM s WHERE score > 50), f AS (SELECT page, gx, gy FROM h WHERE EXISTS (SELECT 1 FROM h n WHERE n.page = h.page AND abs(n.gx - h.gx) + abs(n.gy - h.gy) = 1))
    SELECT page, gx, gy FROM f WHERE page IN (SELECT page FROM f GROUP BY 1 HAVING count(*) <= 200)""")
def heat_map(spark, sf):
    return L.heat_map(B.boxes(spark, sf), "page", 40.0, -400.0)


@query("ag21_measure_count", f"""WITH RECURSIVE {B.IV}, st AS (SELECT line, min(start) * 1.0e0 AS x1, max(start) * 1.0e0 AS x2 FROM iv GROUP BY 1),
    b AS (SELECT line, start * 1.0e0 AS x, cust % 2 = 0 AS heavy, row_number() OVER (PARTITION BY line ORDER BY start, cust % 2 = 0) AS i FROM iv),
    r AS (SELECT line, x1, x2, CAST(0 AS BIGINT) AS i, x1 AS last, 0 AS kept FROM st UNION ALL
      SELECT r.line, x1, x2, b.i, CASE WHEN NOT (b.i = 1 AND heavy AND x < x1 + (x2 - x1) * 0.15) AND abs(x - last) >= 50 AND abs(x2 - x) >= 50 THEN x ELSE last END,
        kept + CASE WHEN NOT (b.i = 1 AND heavy AND x < x1 + (x2 - x1) * 0.15) AND abs(x - last) >= 50 AND abs(x2 - x) >= 50 THEN 1 ELSE 0 END
      FROM r JOIN b ON b.line = r.line AND b.i = r.i + 1)
    SELECT line, max(kept) + max(CASE WHEN x1 <> x2 THEN 1 ELSE 0 END) AS measures FROM r GROUP BY 1""")
def measure_count(spark, sf):
    iv = B.intervals(spark, sf)
    staffs = iv.groupBy("line").agg(
        F.min("start").cast("double").alias("x1"), F.max("start").cast("double").alias("x2"), F.collect_list(F.struct(F.col("start").cast("double").alias("x"), (F.col("cust") % 2 == 0).alias("heavy"))).alias("bars")
    )
    return L.count_measures(staffs).select("line", "measures")


@query("ag23_projection_profile", f"""WITH {B.BOX}, r AS (SELECT page, CAST(floor(cy / 20) AS INTEGER) AS y, count(*) AS n FROM box GROUP BY 1, 2), m AS (SELECT page, min(y) AS lo, max(y) AS hi FROM r GROUP BY 1)
    SELECT m.page, CAST(i AS INTEGER) AS y, coalesce(n, 0) AS n FROM m, LATERAL (SELECT unnest(range(lo, hi + 1)) AS i) g LEFT JOIN r ON r.page = m.page AND r.y = i""")
def projection_profile(spark, sf):
    rows = B.boxes(spark, sf).groupBy("page", F.floor(F.col("cy") / 20).cast("int").alias("y")).agg(F.count("*").alias("n"))
    every = rows.groupBy("page").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).select("page", F.explode(F.sequence("lo", "hi")).alias("y"))
    return every.join(rows, ["page", "y"], "left").select("page", "y", F.coalesce("n", F.lit(0)).alias("n"))


@query("sl09_reading_order", f"WITH {B.BOX} SELECT page, box_id, CAST(row_number() OVER (PARTITION BY page ORDER BY cy, cx, box_id) AS INTEGER) AS rank FROM box")
def reading_order(spark, sf):
    rank = F.row_number().over(W.partitionBy("page").orderBy("cy", "cx", "box_id"))
    return B.boxes(spark, sf).select("page", "box_id", rank.alias("rank"))


@query("so06_ordered_union", f"""WITH {B.BOX}, u AS (SELECT page, kind, min(CASE WHEN box_id % 2 = 0 THEN box_id ELSE box_id + 1000000000 END) AS o FROM box GROUP BY 1, 2)
    SELECT page, kind, CAST(row_number() OVER (PARTITION BY page ORDER BY o) AS INTEGER) AS nth FROM u""")
def ordered_union(spark, sf):
    """Union of the even and the odd list of a page, first appearance kept, in order."""
    b = B.boxes(spark, sf)
    first = b.groupBy("page", "kind").agg(F.min(F.struct(F.col("box_id") % 2, "box_id")).alias("o"))
    return first.select("page", "kind", F.row_number().over(W.partitionBy("page").orderBy("o")).alias("nth"))


@query("so11_patch_expansion", f"""WITH {B.BOX} SELECT box_id, CAST(least(x, greatest(w * 10 - 80, 0)) AS INTEGER) AS x, CAST(least(y, greatest(h * 10 - 80, 0)) AS INTEGER) AS y
    FROM box, LATERAL (SELECT unnest(range(0, CAST(w * 10 AS BIGINT), 60)) AS x) a, LATERAL (SELECT unnest(range(0, CAST(h * 10 AS BIGINT), 60)) AS y) b""")
def patch_expansion(spark, sf):
    """Patches of 80 every 60 steps over an image ten times the box; the last ones are moved inside."""

    def starts(side: str):
        size = (F.col(side) * 10).cast("int")
        steps = F.sequence(F.lit(0), size - 1, F.lit(60))
        return F.transform(steps, lambda v: F.least(v, F.greatest(size - 80, F.lit(0))))

    b = B.boxes(spark, sf).select("box_id", "h", F.explode(starts("w")).alias("x"), "w")
    return b.select("box_id", "x", F.explode(starts("h")).alias("y"))


@query("so12_grid_generation", f"""WITH {BX} SELECT box_id, CAST(x AS INTEGER) AS x, y1 + 0 * (y2 - y1) / 4 AS ya, y1 + 2 * (y2 - y1) / 4 AS yc, y1 + 4 * (y2 - y1) / 4 AS ye
    FROM bx, LATERAL (SELECT unnest(range(CAST(trunc(x1 - 50) AS BIGINT), CAST(trunc(x2 + 50) AS BIGINT), 10)) AS x) r""")
def grid_generation(spark, sf):
    b, g = boxes(spark, sf), G.box()
    xs = F.sequence((G.left(g) - 50).cast("int"), (G.right(g) + 50).cast("int") - 1, F.lit(10))
    line = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: G.top(g) + i * (G.bottom(g) - G.top(g)) / 4)
    return b.select("box_id", F.explode(xs).alias("x"), line.alias("_y")).select(
        "box_id", "x", F.col("_y")[0].alias("ya"), F.col("_y")[2].alias("yc"), F.col("_y")[4].alias("ye")
    )


@query("wn19_neighbours", f"WITH {B.BOX} SELECT page, box_id, lag(box_id) OVER w AS previous, lead(box_id) OVER w AS next FROM box WINDOW w AS (PARTITION BY page ORDER BY cy, box_id)")
def neighbours(spark, sf):
    w = W.partitionBy("page").orderBy("cy", "box_id")
    return B.boxes(spark, sf).select("page", "box_id", F.lag("box_id").over(w).alias("previous"), F.lead("box_id").over(w).alias("next"))


def with_long_ends(zones):
    return zones.withColumns({c: F.col(c).cast("bigint") for c in ("start", "stop")})


@query("wn22_interval_merge", f"""WITH {B.IV}, n AS (SELECT *, CASE WHEN start < lag(stop) OVER w THEN 0 ELSE 1 END AS nw FROM iv WINDOW w AS (PARTITION BY line ORDER BY start, iv_id)),
    z AS (SELECT *, sum(nw) OVER (PARTITION BY line ORDER BY start, iv_id) AS zone FROM n)
    SELECT line, CAST(zone AS BIGINT) AS zone, min(start) AS start, last(stop ORDER BY start, iv_id) AS stop, count(*) AS n FROM z GROUP BY line, zone""")
def interval_merge(spark, sf):
    return with_long_ends(L.merge_intervals(B.intervals(spark, sf), ["line"]))


@query("wn22_interval_union", f"""WITH {B.IV}, n AS (SELECT *, CASE WHEN start < max(stop) OVER (PARTITION BY line ORDER BY start, iv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM iv),
    z AS (SELECT *, sum(nw) OVER (PARTITION BY line ORDER BY start, iv_id) AS zone FROM n)
    SELECT line, CAST(zone AS BIGINT) AS zone, min(start) AS start, max(stop) AS stop, count(*) AS n FROM z GROUP BY line, zone""")
def interval_union(spark, sf):
    return with_long_ends(L.merge_intervals(B.intervals(spark, sf), ["line"], end_is_last=False))


@query("wn23_rank_groups", f"""WITH {B.BOX}, g AS (SELECT page, box_id, cy, count(*) OVER p AS n, row_number() OVER (PARTITION BY page, kind ORDER BY cy, box_id) - 1 AS r, kind FROM box WINDOW p AS (PARTITION BY page, kind))
    SELECT page, kind, box_id, CAST(r // 5 AS INTEGER) AS grp FROM g WHERE n % 5 = 0""")
def rank_groups(spark, sf):
    return L.rank_groups(B.boxes(spark, sf), ["page", "kind"]).select("page", "kind", "box_id", F.col("grp").cast("int").alias("grp"))


@query("wn26_consume_by_count", f"""WITH {B.BOX}, s AS (SELECT page, box_id, kind % 3 + 1 AS need, (row_number() OVER (PARTITION BY page ORDER BY cy, box_id) - 1) % 2 AS voice, cy FROM box),
    r AS (SELECT *, sum(need) OVER (PARTITION BY page, voice ORDER BY cy, box_id) AS upto FROM s)
    SELECT page, box_id, CAST(voice AS INTEGER) AS voice, CAST(m AS BIGINT) AS measure FROM r, LATERAL (SELECT unnest(range(CAST(upto - need AS BIGINT), CAST(upto AS BIGINT))) AS m) x""")
def consume_by_count(spark, sf):
    """Staffs from top to bottom take voices in rotation; each takes the next measures of its voice."""
    rank = F.row_number().over(W.partitionBy("page").orderBy("cy", "box_id")) - 1
    s = B.boxes(spark, sf).select("page", "box_id", "cy", (F.col("kind") % 3 + 1).alias("need"), (rank % 2).alias("voice"))
    upto = F.sum("need").over(W.partitionBy("page", "voice").orderBy("cy", "box_id"))
    return s.withColumn("upto", upto).select("page", "box_id", "voice", F.explode(F.sequence(F.col("upto") - F.col("need"), F.col("upto") - 1)).alias("measure"))


FOUR = """ql AS (SELECT page, kind, cy FROM box), qs AS (SELECT page, kind, list_sort(list(cy)) AS ys FROM ql GROUP BY 1, 2 HAVING count(*) = 4),"""


@query("sq24_missing_line", f"""WITH {B.BOX}, g AS (SELECT box_id, CASE WHEN box_id % 3 = 0 THEN -1 ELSE box_id % 5 END AS skip, cy, (CASE WHEN box_id % 7 = 0 THEN 4.0 ELSE 0 END) AS bend FROM box),
    l AS (SELECT box_id, cy - 20 AS st, cy + 20 AS sb, [cy - 20 + i * 10 + CASE WHEN i = 2 THEN bend ELSE 0 END FOR i IN range(0, 5) IF i <> skip] AS ys FROM g),
    f AS (SELECT *, ys[1] - st AS ga, sb - ys[4] AS gb FROM l WHERE len(ys) = 4 AND abs(ys[2] - ys[1] - 10) <= 3 AND abs(ys[3] - ys[2] - 10) <= 3 AND abs(ys[4] - ys[3] - 10) <= 3)
    SELECT box_id, CASE WHEN abs(ga - 10) <= 3 AND gb <= 3 THEN ys[1] - 10 ELSE ys[4] + 10 END AS cy FROM f WHERE (abs(ga - 10) <= 3 AND gb <= 3) <> (abs(gb - 10) <= 3 AND ga <= 3)""")
def missing_line(spark, sf):
    """Five lines per box with one left out; only a missing outer line can be restored."""
    b = B.boxes(spark, sf)
    skip = F.when(F.col("box_id") % 3 == 0, F.lit(-1)).otherwise((F.col("box_id") % 5).cast("int"))
    bend = F.when(F.col("box_id") % 7 == 0, F.lit(4.0)).otherwise(F.lit(0.0))
    lines = b.select("box_id", "cy", skip.alias("skip"), bend.alias("bend"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).where("i <> skip")
    y = F.col("cy") - 20 + F.col("i") * 10 + F.when(F.col("i") == 2, F.col("bend")).otherwise(F.lit(0.0))
    rows = lines.select("box_id", y.alias("y"), (F.col("cy") - 20).alias("sym_top"), (F.col("cy") + 20).alias("sym_bottom")).withColumnRenamed("y", "cy")
    return L.complete_lines(rows, "box_id", F.lit(10.0))


# ---- geometry functions --------------------------------------------------------------------------------------------


@query("sf18_extrapolated_height", f"WITH {B.BOX} SELECT box_id, round((100 - cx) * tan(radians(kind * 5.0 - 20)) + cy, 6) AS y FROM box")
def extrapolated_height(spark, sf):
    return boxes(spark, sf, tilt=True).select("box_id", F.round(G.y_at(F.lit(100.0), G.box()), 6).alias("y"))


@query("sf19_angle_normalisation", f"""WITH {B.BOX}, a AS (SELECT box_id, w, h, kind * 40.0 - 180 AS t FROM box)
    SELECT box_id, CASE WHEN (t > 45 AND t <= 135) OR (t < -45 AND t >= -135) THEN h ELSE w END AS w, CASE WHEN (t > 45 AND t <= 135) OR (t < -45 AND t >= -135) THEN w ELSE h END AS h,
      CAST(CASE WHEN t > 135 THEN t - 180 WHEN t < -135 THEN t + 180 WHEN t > 45 THEN t - 90 WHEN t < -45 THEN t + 90 ELSE t END AS DOUBLE) AS angle FROM a""")
def angle_normalisation(spark, sf):
    b = B.boxes(spark, sf).withColumn("angle", F.col("kind") * 40.0 - 180)
    return b.select("box_id", G.normalised_angle(F.col("w"), F.col("h"), F.col("angle")).alias("_n")).select("box_id", "_n.*")


@query("sf20_box_arithmetic", f"""WITH {B.BOX} SELECT box_id, greatest(w, 25) AS min_w, w + 15 AS thick_w, h + 15 AS thick_h, h + 7 AS tall_h, cy - 7 // 2 AS tall_cy, cx - 10 AS moved_cx FROM box""")
def box_arithmetic(spark, sf):
    grow, taller = 15, 7
    return B.boxes(spark, sf).select(
        "box_id", F.greatest("w", F.lit(25.0)).alias("min_w"), (F.col("w") + grow).alias("thick_w"), (F.col("h") + grow).alias("thick_h"), (F.col("h") + taller).alias("tall_h"),
        (F.col("cy") - taller // 2).alias("tall_cy"), (F.col("cx") - 10).alias("moved_cx"),
    )


NEXT = "nx AS (SELECT a.box_id, a.cx, a.cy, a.w, a.h, b.cx AS bcx, b.cy AS bcy, b.w AS bw, b.h AS bh, a.kind AS ka, b.kind AS kb FROM box a JOIN box b ON b.box_id = a.box_id + 1)"


def next_boxes(spark, sf, tilt=False):
    b = boxes(spark, sf, tilt)
    nxt = b.select((F.col("box_id") - 1).alias("box_id"), *[F.col(c).alias("b_" + c) for c in ("cx", "cy", "w", "h", "angle")])
    return b.join(nxt, "box_id")


@query("sf21_may_touch", f"WITH {B.BOX}, {NEXT} SELECT box_id, sqrt(pow(cx - bcx, 2) + pow(cy - bcy, 2)) <= greatest(w, h) + greatest(bw, bh) AS near FROM nx")
def may_touch(spark, sf):
    return next_boxes(spark, sf).select("box_id", G.may_touch(G.box(), G.box("b_")).alias("near"))


def _corner(p, sx, sy, t):
    return (f"{p}cx + cos({t}) * {sx} * {p}w / 2 - sin({t}) * {sy} * {p}h / 2", f"{p}cy + sin({t}) * {sx} * {p}w / 2 + cos({t}) * {sy} * {p}h / 2")


def _sat_sql():
    """Separating axes on explicit corners: project all corners on each edge direction and compare the ranges."""
    ta, tb = "radians(ka * 5.0 - 20)", "radians(kb * 5.0 - 20)"
    corners = {}
    for p, t in (("", ta), ("b", tb)):
        corners[p] = [_corner(p, sx, sy, t) for sx in (-1, 1) for sy in (-1, 1)]
    tests = []
    for t in (ta, tb):
        for ux, uy in ((f"cos({t})", f"sin({t})"), (f"-sin({t})", f"cos({t})")):
            pr = {p: [f"({x}) * ({ux}) + ({y}) * ({uy})" for x, y in corners[p]] for p in corners}
            lo = {p: "least(" + ", ".join(v) + ")" for p, v in pr.items()}
            hi = {p: "greatest(" + ", ".join(v) + ")" for p, v in pr.items()}
            tests.append(f"({lo['']} <= {hi['b']} + 1e-9 AND {lo['b']} <= {hi['']} + 1e-9)")
    return " AND ".join(tests)


@query("sf22_polygon_overlap", f"WITH {B.BOX}, {NEXT}, z AS (SELECT box_id, cx, cy, w * 8 AS w, h * 4 AS h, bcx, bcy, bw * 8 AS bw, bh * 4 AS bh, ka, kb FROM nx) SELECT box_id, {_sat_sql()} AS overlap FROM z")
def polygon_overlap(spark, sf):
    n = next_boxes(spark, sf, tilt=True)
    for p in ("", "b_"):
        n = n.withColumn(p + "w", F.col(p + "w") * 8).withColumn(p + "h", F.col(p + "h") * 4)
    return n.select("box_id", G.boxes_overlap(G.box(), G.box("b_")).alias("overlap"))


@query("sf28_affine_points", f"WITH {B.BOX} SELECT box_id, (cx - 10) * 1.5 AS x, (cy - 20) * 1.5 AS y1, (cy + 8 - 20) * 1.5 AS y2 FROM box")
def affine_points(spark, sf):
    ys = F.transform(F.array(F.col("cy"), F.col("cy") + 8), lambda y: (y - 20) * 1.5)
    return B.boxes(spark, sf).select("box_id", ((F.col("cx") - 10) * 1.5).alias("x"), ys[0].alias("y1"), ys[1].alias("y2"))


# ---- layout files --------------------------------------------------------------------------------------------------


@query("sc13_layout_sink", f"""WITH {B.BOX} SELECT box_id, (kind % 2) || ' ' || printf('%.8f', (cx + 400) / {W0}) || ' ' || printf('%.8f', (cy + 400) / {H0}) || ' ' || printf('%.8f', w / {W0}) || ' ' || printf('%.8f', h / {H0}) AS line FROM box""")
def layout_sink(spark, sf):
    """Written as a bundle and read back."""
    b = B.boxes(spark, sf).select("page", "box_id", (F.col("kind") % 2).alias("class"), (F.col("cx") + 400).alias("cx"), (F.col("cy") + 400).alias("cy"), "w", "h")
    folder = B.work_folder(spark, "layout")
    layout_files.write_layout(b, folder, W0, H0, "box_id", digits=8)
    return bundles.read(spark, folder).select(F.col("number").alias("box_id"), F.col("value").alias("line"))


@query("sc14_layout_scan", f"""WITH {B.BOX}, n AS (SELECT box_id, kind % 2 <> 0 AS grand, CAST(printf('%.8f', (cx + 400) / {W0}) AS DOUBLE) * {W0} AS x, CAST(printf('%.8f', (cy + 400) / {H0}) AS DOUBLE) * {H0} AS y,
      CAST(printf('%.8f', w / {W0}) AS DOUBLE) * {W0} AS w, CAST(printf('%.8f', h / {H0}) AS DOUBLE) * {H0} AS h FROM box WHERE box_id % 5 <> 0),
    e AS (SELECT *, trunc(x - w / 2) AS x1, trunc(y - h / 2) AS y1 FROM n)
    SELECT box_id, grand, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(trunc(x1 + w) AS INTEGER) AS x2, CAST(trunc(y1 + h) AS INTEGER) AS y2 FROM e""")
def layout_scan(spark, sf):
    """Every fifth line is damaged and skipped."""
    lines = layout_sink(spark, sf)
    bad = F.concat("line", F.lit(" x"))
    damaged = lines.withColumn("line", F.when(F.col("box_id") % 5 == 0, bad).otherwise(F.col("line")))
    return layout_files.parse_lines(damaged, W0, H0).select("box_id", "grand", "x1", "y1", "x2", "y2")
