"""Corpus-windowing queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tokens as T
from ..functions import vocabulary as V
from ..operators import chords as C
from ..operators import series as SE
from ..operators import windows as N
from . import bindings as B
from .registry import query
from .sequence_queries import CHORDS, MEASURES, TICKS, tick_sql

FIELDS = ", ".join(V.TOKEN_FIELDS)
KIND = "CASE WHEN starts_with(rhythm, 'clef') THEN 'clef' WHEN starts_with(rhythm, 'key') THEN 'key' WHEN starts_with(rhythm, 'time') THEN 'time' END"


@query("wn06_signature_carry", f"""WITH {B.EVT}, d AS (SELECT *, pos // 16 AS doc, {KIND} AS kind FROM evt),
    o AS (SELECT *, coalesce(pos < min(CASE WHEN regexp_matches(rhythm, '^(note|rest)') THEN pos END) OVER (PARTITION BY seq_id, doc), true) AS opening FROM d),
    u AS (SELECT seq_id, doc, pos, kind, rhythm, opening FROM o WHERE kind IS NOT NULL UNION ALL
      SELECT seq_id, min(doc), -1, kk, rr, true FROM d, (VALUES ('clef', 'clef_G2'), ('key', 'keySignature_0'), ('time', 'timeSignature/4')) v(kk, rr) GROUP BY seq_id, kk, rr),
    l AS (SELECT *, max(CASE WHEN opening THEN pos END) OVER (PARTITION BY seq_id, doc, kind) AS lo FROM u),
    g AS (SELECT *, lag(rhythm) OVER (PARTITION BY seq_id, kind ORDER BY pos) AS prev FROM l WHERE NOT opening OR pos = lo)
    SELECT seq_id, doc, CAST(pos AS INTEGER) AS pos, kind, rhythm FROM g WHERE prev IS DISTINCT FROM rhythm""")
def signature_carry(spark, sf):
    return N.carry_signatures(B.evt(spark, sf).withColumn("doc", F.expr("pos div 16").cast("int")))


@query("wn07_tie_folding", f"""WITH {B.EVT}, t AS (SELECT * REPLACE (CASE WHEN starts_with(rhythm, 'repeat') THEN 'tieSlur' ELSE rhythm END AS rhythm) FROM evt),
    i AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY seq_id) AS n, starts_with(rhythm, 'note') AS isn FROM t WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
    ties AS (SELECT seq_id, i AS t FROM i WHERE rhythm = 'tieSlur' AND i BETWEEN 1 AND n - 2),
    nxt AS (SELECT ties.seq_id, min(i.i) AS m FROM ties JOIN i ON i.seq_id = ties.seq_id AND i.i > t AND isn GROUP BY ties.seq_id, t),
    prv AS (SELECT ties.seq_id, max(i.i) AS m FROM ties JOIN i ON i.seq_id = ties.seq_id AND i.i < t AND i.i >= 1 AND isn GROUP BY ties.seq_id, t),
    prc AS (SELECT seq_id, m, count(*) AS c FROM prv GROUP BY 1, 2)
    SELECT i.seq_id, pos, rhythm, CASE WHEN NOT isn THEN slur WHEN prc.c IS NULL THEN CASE WHEN x.m IS NOT NULL THEN 'slurStop' ELSE slur END
      WHEN prc.c = 1 AND (x.m IS NOT NULL OR slur = 'slurStop') THEN 'slurStart_slurStop' ELSE 'slurStart' END AS slur
    FROM i LEFT JOIN (SELECT DISTINCT * FROM nxt) x ON x.seq_id = i.seq_id AND x.m = i.i LEFT JOIN prc ON prc.seq_id = i.seq_id AND prc.m = i.i
    WHERE rhythm <> 'tieSlur' OR i >= n - 2""")
def tie_folding(spark, sf):
    r = F.col("rhythm")
    tied = B.evt(spark, sf).withColumn("rhythm", F.when(r.startswith("repeat"), F.lit("tieSlur")).otherwise(r))
    return N.fold_ties(tied).select("seq_id", "pos", "rhythm", "slur")


_ROWS = """rws AS (SELECT seq_id, pos, k AS duration, value >= 5 AS visible, CASE WHEN starts_with(rhythm, 'clef') THEN 'clef' WHEN contains(rhythm, 'barline') THEN 'bar'
    WHEN starts_with(rhythm, 'note') AND k % 4 = 0 AND pos > 0 THEN 'chord' WHEN starts_with(rhythm, 'note') THEN 'note'
    WHEN starts_with(rhythm, 'rest') THEN 'move' ELSE 'symbol' END AS kind FROM evt)"""


@query("wn08_onsets", f"""WITH RECURSIVE {B.EVT}, {_ROWS},
    r AS (SELECT seq_id, pos, kind, CASE WHEN kind = 'move' AND duration % 2 = 0 THEN -duration ELSE duration END AS d, visible FROM rws),
    s AS (SELECT seq_id, -1 AS pos, 0 AS cur, CAST(NULL AS INTEGER) AS head, CAST(NULL AS INTEGER) AS onset, 0 AS low FROM (SELECT DISTINCT seq_id FROM r) q
      UNION ALL
      SELECT r.seq_id, r.pos,
        CASE kind WHEN 'clef' THEN cur WHEN 'symbol' THEN cur + 1 WHEN 'bar' THEN cur + 1 WHEN 'chord' THEN coalesce(head, cur) + d ELSE cur + d END,
        CASE WHEN kind = 'clef' OR (kind = 'note' AND visible) THEN cur WHEN kind = 'symbol' THEN cur + 1 WHEN kind = 'bar' THEN cur + 2 ELSE head END,
        CASE kind WHEN 'symbol' THEN cur + 1 WHEN 'bar' THEN cur + 2 WHEN 'chord' THEN coalesce(head, cur) ELSE cur END,
        least(low, CASE kind WHEN 'clef' THEN cur WHEN 'symbol' THEN cur + 1 WHEN 'bar' THEN cur + 1 WHEN 'chord' THEN coalesce(head, cur) + d ELSE cur + d END)
      FROM s JOIN r ON r.seq_id = s.seq_id AND r.pos = s.pos + 1)
    SELECT seq_id, pos, CAST(onset AS BIGINT) AS onset, min(low) OVER (PARTITION BY seq_id) < 0 AS broken FROM s WHERE pos >= 0""")
def onsets(spark, sf):
    r, k = F.col("rhythm"), F.col("k")
    kind = (
        F.when(r.startswith("clef"), F.lit("clef")).when(r.contains("barline"), F.lit("bar"))
        .when(r.startswith("note") & (k % 4 == 0) & (F.col("pos") > 0), F.lit("chord")).when(r.startswith("note"), F.lit("note"))
        .when(r.startswith("rest"), F.lit("move")).otherwise(F.lit("symbol"))
    )
    rows = B.evt(spark, sf).select("seq_id", "pos", kind.alias("kind"), "k", (F.col("value") >= 5).alias("visible"))
    rows = rows.withColumn("duration", F.when((F.col("kind") == "move") & (F.col("k") % 2 == 0), -F.col("k")).otherwise(F.col("k")))
    return N.onsets(rows).select("seq_id", "pos", F.col("onset").cast("bigint").alias("onset"), "broken")


_RM = """rm AS (SELECT *, CAST(coalesce(sum(CASE WHEN contains(rhythm, 'barline') OR contains(rhythm, 'repeat') THEN 1 ELSE 0 END)
    OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS measure FROM evt)"""


@query("wn09_pending_clefs", f"""WITH {B.EVT}, {_RM},
    q AS (SELECT seq_id, measure + 1 AS measure, position AS staff, arg_max(rhythm, pos) AS rhythm FROM rm WHERE starts_with(rhythm, 'clef') AND k % 8 = 2 GROUP BY 1, 2, 3),
    f AS (SELECT *, min(CASE WHEN NOT (starts_with(rhythm, 'clef') AND k % 8 <> 2) THEN pos END) OVER (PARTITION BY seq_id, measure) AS other FROM rm),
    e AS (SELECT DISTINCT seq_id, measure, position AS staff FROM f WHERE starts_with(rhythm, 'clef') AND k % 8 <> 2 AND (other IS NULL OR pos < other))
    SELECT q.* FROM q ANTI JOIN e USING (seq_id, measure, staff) WHERE (q.seq_id, q.measure) IN (SELECT (seq_id, measure) FROM rm)""")
def pending_clefs(spark, sf):
    m = N.row_measures(B.evt(spark, sf))
    clef, later = F.col("rhythm").startswith("clef"), F.col("k") % 8 == 2
    other = F.min(F.when(~(clef & ~later), F.col("pos"))).over(W.partitionBy("seq_id", "measure"))
    tagged = m.withColumn("staff", F.col("position")).withColumn("_other", other)
    announced = tagged.where(clef & later)
    leading = tagged.where(clef & ~later & (F.col("_other").isNull() | (F.col("pos") < F.col("_other"))))
    existing = m.select("seq_id", "measure").distinct()
    return N.pending_clefs(announced, leading).join(existing, ["seq_id", "measure"], "left_semi").select("seq_id", "measure", "staff", "rhythm")


@query("wn10_toggle_state", f"""WITH {B.EVT}, s AS (SELECT *, CASE WHEN k % 10 = 0 THEN true WHEN k % 10 = 5 THEN false END AS sig FROM evt),
    l AS (SELECT *, coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS tremolo,
      coalesce(last_value(sig IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS prev FROM s)
    SELECT seq_id, pos, tremolo, tremolo OR prev AS tremolo_span FROM l""")
def toggle_state(spark, sf):
    k = F.col("k")
    rows = N.toggle_state(B.evt(spark, sf), k % 10 == 0, k % 10 == 5, "tremolo")
    return rows.select("seq_id", "pos", "tremolo", "tremolo_span")


def _last(cond, default, frame):
    return (f"coalesce(last_value(CASE WHEN {cond} THEN rhythm END IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY pos "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND {frame}), '{default}')")


_CLEF = "starts_with(rhythm, 'clef')"
_LOW = "(position = 'lower' AND staves = 2)"
_STATE = [("clef_upper", f"{_CLEF} AND NOT {_LOW}", "clef_G2"), ("clef_lower", f"{_CLEF} AND {_LOW}", "clef_F4"),
          ("key", "starts_with(rhythm, 'keySignature')", "keySignature_0"), ("time", "starts_with(rhythm, 'timeSignature')", "timeSignature/4")]
CONTEXT = f"""{_RM},
st0 AS (SELECT *, min(CASE WHEN measure = 0 AND regexp_matches(rhythm, '^(note|rest)') THEN pos END) OVER (PARTITION BY seq_id) AS fn FROM rm),
st AS (SELECT *, CASE WHEN count(*) FILTER (measure = 0 AND {_CLEF} AND (fn IS NULL OR pos < fn)) OVER (PARTITION BY seq_id) >= 2 THEN 2 ELSE 1 END AS staves FROM st0),
cx AS (SELECT *, {", ".join(f"{_last(c, d, 'CURRENT ROW')} AS a_{n}, {_last(c, d, '1 PRECEDING')} AS b_{n}" for n, c, d in _STATE)} FROM st)"""


@query("jn17_signature_context", f"""WITH {B.EVT}, {CONTEXT}, f AS (SELECT *, row_number() OVER (PARTITION BY seq_id, measure ORDER BY pos) AS r FROM cx)
    SELECT seq_id, measure, staves, b_clef_upper AS clef_upper, b_clef_lower AS clef_lower, b_key AS key, b_time AS time FROM f WHERE r = 1""")
def signature_context(spark, sf):
    return N.context_at_measures(N.row_measures(B.evt(spark, sf)))


@query("wn11_measure_windows", f"""WITH {B.EVT}, {CONTEXT},
    w0 AS (SELECT *, measure // 4 AS win, max(measure) OVER (PARTITION BY seq_id) + 1 AS ms FROM cx),
    w1 AS (SELECT *, min(CASE WHEN NOT ({KIND} IS NOT NULL OR rhythm = 'chord') THEN pos END) OVER (PARTITION BY seq_id, win) AS fo FROM w0 WHERE ms >= 2),
    w2 AS (SELECT *, measure % 4 = 0 AND (fo IS NULL OR pos < fo) AS ldg FROM w1),
    hd AS (SELECT seq_id, win, max(staves) AS staves, {", ".join(f"coalesce(arg_max(a_{n}, pos) FILTER (ldg), arg_min(b_{n}, pos)) AS {n}" for n, _, _ in _STATE)} FROM w2 GROUP BY 1, 2)
    SELECT seq_id, win AS "window", ord, rhythm, position FROM (
      SELECT seq_id, win, -5 AS ord, clef_upper AS rhythm, 'upper' AS position FROM hd UNION ALL SELECT seq_id, win, -4, 'chord', '.' FROM hd WHERE staves = 2
      UNION ALL SELECT seq_id, win, -3, clef_lower, 'lower' FROM hd WHERE staves = 2 UNION ALL SELECT seq_id, win, -2, key, '.' FROM hd
      UNION ALL SELECT seq_id, win, -1, time, '.' FROM hd UNION ALL SELECT seq_id, win, pos, rhythm, position FROM w2 WHERE NOT ldg) x""")
def measure_windows(spark, sf):
    cut = N.cut_windows(N.row_measures(B.evt(spark, sf)), size=4)
    return cut.select("seq_id", "window", "ord", "rhythm", "position")


@query("wn12_page_breaks", f"""WITH {B.EVT}, {_RM},
    m AS (SELECT seq_id // 2 AS score, seq_id % 2 AS voice, measure, arg_min(k, pos) % 4 = 0 AS new_page FROM rm GROUP BY seq_id, measure),
    p AS (SELECT *, CAST(sum(CASE WHEN new_page AND measure > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY score, voice ORDER BY measure) AS INTEGER) AS page FROM m),
    v AS (SELECT score, voice, count(*) AS n, string_agg(CASE WHEN new_page AND measure > 0 THEN CAST(measure AS VARCHAR) END, ',' ORDER BY measure) AS breaks FROM p GROUP BY 1, 2),
    ok AS (SELECT score, count(DISTINCT n) = 1 AND count(DISTINCT coalesce(breaks, '')) = 1 AS aligned FROM v GROUP BY 1)
    SELECT score, voice, measure, page, aligned FROM p JOIN ok USING (score)""")
def page_breaks(spark, sf):
    """Pages by running count of break flags; voices of a score must agree in length and break positions."""
    m = N.row_measures(B.evt(spark, sf)).groupBy("seq_id", "measure").agg((F.min_by("k", "pos") % 4 == 0).alias("new_page"))
    m = m.select(F.expr("seq_id div 2").alias("score"), (F.col("seq_id") % 2).alias("voice"), "measure", "new_page")
    flag = (F.col("new_page") & (F.col("measure") > 0)).cast("int")
    paged = m.withColumn("page", F.sum(flag).over(W.partitionBy("score", "voice").orderBy("measure")).cast("int"))
    breaks = F.array_sort(F.collect_list(F.when(flag == 1, F.col("measure"))))
    voices = m.groupBy("score", "voice").agg(F.count("*").alias("n"), breaks.alias("breaks"))
    aligned = voices.groupBy("score").agg(
        ((F.min("n") == F.max("n")) & (F.size(F.collect_set("breaks")) == 1)).alias("aligned")
    )
    return paged.join(aligned, "score").select("score", "voice", "measure", "page", "aligned")


_RATIO = """tr AS (SELECT *, CAST(regexp_extract(rhythm, '^(?:note|rest)_([0-9]+)', 1) AS VARCHAR) AS bs FROM measures),
tr2 AS (SELECT *, TRY_CAST(bs AS BIGINT) AS b FROM tr),
tr3 AS (SELECT *, CASE WHEN b > 0 AND NOT contains(rhythm, 'G') AND (b & (b - 1)) <> 0 THEN b // gcd(b, CAST(pow(2, floor(log2(b))) AS BIGINT)) END AS actual,
  CASE WHEN b > 0 AND NOT contains(rhythm, 'G') AND (b & (b - 1)) <> 0 THEN CAST(pow(2, floor(log2(b))) AS BIGINT) // gcd(b, CAST(pow(2, floor(log2(b))) AS BIGINT)) END AS normal FROM tr2),
tc AS (SELECT seq_id, measure, chord_id, arg_min(actual, member) FILTER (actual IS NOT NULL) AS actual,
  arg_min(normal, member) FILTER (actual IS NOT NULL) AS normal FROM tr3 GROUP BY 1, 2, 3)"""


@query("wn13_tuplet_brackets", f"""WITH {MEASURES}, {_RATIO},
    r AS (SELECT *, CASE WHEN actual IS NOT DISTINCT FROM lag(actual) OVER w AND normal IS NOT DISTINCT FROM lag(normal) OVER w
      AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS nw FROM tc WINDOW w AS (PARTITION BY seq_id, measure ORDER BY chord_id)),
    r2 AS (SELECT *, sum(nw) OVER (PARTITION BY seq_id, measure ORDER BY chord_id) AS run FROM r),
    r3 AS (SELECT *, row_number() OVER (PARTITION BY seq_id, measure, run ORDER BY chord_id) - 1 AS i, count(*) OVER (PARTITION BY seq_id, measure, run) AS len FROM r2),
    r4 AS (SELECT *, bool_and(actual IS NULL OR len % actual = 0) OVER (PARTITION BY seq_id, measure) AS ok FROM r3)
    SELECT seq_id, measure, chord_id, CASE WHEN NOT ok OR actual IS NULL THEN '' WHEN i % actual = 0 THEN 'start' WHEN i % actual = actual - 1 THEN 'stop' ELSE '' END AS mark FROM r4""")
def tuplet_brackets(spark, sf):
    return N.tuplet_brackets(C.group_measures(C.group_chords(B.evt(spark, sf))))


@query("wn14_volta_numbers", f"""WITH {B.EVT}, {_RM},
    s AS (SELECT *, last_value(CASE WHEN rhythm = 'repeatEnd' THEN measure END IGNORE NULLS) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ls FROM rm),
    t AS (SELECT seq_id, pos, measure, coalesce(measure = ls + 1, false) AS chained FROM s WHERE rhythm = 'repeatStart' OR rhythm = 'note_2'),
    u AS (SELECT *, sum(CASE WHEN chained THEN 0 ELSE 1 END) OVER (PARTITION BY seq_id ORDER BY pos) AS isl FROM t)
    SELECT seq_id, pos, measure, CAST(row_number() OVER (PARTITION BY seq_id, isl ORDER BY pos) AS INTEGER) AS number FROM u""")
def volta_numbers(spark, sf):
    r = F.col("rhythm")
    measured = N.row_measures(B.evt(spark, sf))
    return N.volta_numbers(measured, r.isin("repeatStart", "note_2"), r == "repeatEnd")


@query("wn24_control_lines", f"""WITH {B.EVT}, c AS (SELECT seq_id, pos, {KIND} IS NOT NULL AS ctl FROM evt),
    d AS (SELECT *, CASE WHEN ctl AND coalesce(lag(ctl) OVER (PARTITION BY seq_id ORDER BY pos), true) THEN 0 ELSE 1 END AS st FROM c)
    SELECT seq_id, pos, CAST(sum(st) OVER (PARTITION BY seq_id ORDER BY pos) AS BIGINT) AS line_no FROM d""")
def control_lines(spark, sf):
    t = B.evt(spark, sf).select("seq_id", "pos", "rhythm")
    return N.control_line_numbers(t, N.signature_kind(F.col("rhythm")).isNotNull()).select("seq_id", "pos", "line_no")


@query("wn25_stride_pairing", f"""WITH {B.EVT}, {_RM}, i AS (SELECT seq_id, measure AS idx, 1 + count(*) % 2 AS measures FROM rm GROUP BY 1, 2),
    l AS (SELECT *, lead(idx) OVER w AS nx, lead(measures) OVER w AS nm FROM i WINDOW w AS (PARTITION BY seq_id ORDER BY idx)),
    x AS (SELECT *, bool_or(idx % 3 = 1 AND nx IS NULL) OVER (PARTITION BY seq_id) AS lost FROM l)
    SELECT seq_id, idx, CASE WHEN idx % 3 = 1 THEN nx END AS partner, measures, idx % 3 = 1 AND measures <> nm AS broken FROM x WHERE NOT lost AND idx % 3 <> 2""")
def stride_pairing(spark, sf):
    m = N.row_measures(B.evt(spark, sf)).groupBy("seq_id", F.col("measure").alias("idx")).agg((F.count("*") % 2 + 1).alias("measures"))
    return N.pair_in_stride(m, 3, 1)


@query("sq06_two_staff_merge", f"""WITH {CHORDS}, o AS (SELECT *, chord_id // 2 AS onset, CASE WHEN contains(rhythm, 'barline') OR contains(rhythm, 'repeat') THEN 0 WHEN starts_with(rhythm, 'clef') THEN 1
      WHEN starts_with(rhythm, 'key') THEN 2 WHEN starts_with(rhythm, 'time') THEN 3 ELSE 4 END AS rank FROM chords),
    d AS (SELECT *, row_number() OVER (PARTITION BY seq_id, onset, rank, {FIELDS} ORDER BY pos) AS cp FROM o),
    u AS (SELECT *, row_number() OVER (PARTITION BY seq_id, onset, rank ORDER BY pos) > 1 AND rank IN (1, 4) AS glued,
      row_number() OVER (PARTITION BY seq_id ORDER BY onset DESC, rank DESC, pos DESC) = 1 AS fin FROM d WHERE cp = 1 OR rank IN (1, 4))
    SELECT seq_id, CAST(onset AS INTEGER) AS onset, rank, pos, slot, rhythm, pitch FROM (
      SELECT seq_id, onset, rank, pos, 0 AS slot, 'chord' AS rhythm, '.' AS pitch FROM u WHERE glued
      UNION ALL SELECT seq_id, onset, rank, pos, 1, CASE WHEN fin AND rhythm = 'repeatEndStart' THEN 'repeatEnd' ELSE rhythm END, pitch FROM u
      UNION ALL SELECT seq_id, onset, rank, pos, 2, 'barline', '.' FROM u WHERE fin AND NOT (contains(rhythm, 'barline') OR starts_with(rhythm, 'repeat'))) x""")
def two_staff_merge(spark, sf):
    """Every token: chord markers are folded first, and two chords in turn share an onset."""
    rows = C.group_chords(B.evt(spark, sf)).withColumn("onset", F.expr("chord_id div 2").cast("int"))
    return N.merge_staves(rows).select("seq_id", "onset", "rank", "pos", "slot", "rhythm", "pitch")


# The twin walks the tokens one by one with a recursive query.
@query("sq07_bar_line_coalescing", f"""WITH RECURSIVE {B.EVT}, t AS (SELECT seq_id, pos, pos // 8 AS measure, rhythm, contains(rhythm, 'barline') OR contains(rhythm, 'repeat') AS is_end FROM evt),
    s AS (SELECT seq_id, CAST(-1 AS INTEGER) AS pos, CAST(-1 AS INTEGER) AS grp, '' AS cur, false AS last_end FROM (SELECT DISTINCT seq_id FROM t) q
      UNION ALL
      SELECT t.seq_id, t.pos,
        CASE WHEN t.is_end AND last_end AND NOT (contains(t.rhythm, 'barline') AND contains(cur, 'barline')) THEN grp ELSE t.pos END,
        CASE WHEN t.is_end AND last_end AND NOT (contains(t.rhythm, 'barline') AND contains(cur, 'barline')) THEN
          CASE WHEN (t.rhythm = 'repeatStart' AND cur = 'repeatEnd') OR (t.rhythm = 'repeatEnd' AND cur = 'repeatStart') THEN 'repeatEndStart'
            WHEN contains(t.rhythm, 'repeat') THEN t.rhythm ELSE cur END ELSE t.rhythm END, t.is_end
      FROM s JOIN t ON t.seq_id = s.seq_id AND t.pos = s.pos + 1),
    k AS (SELECT seq_id, grp AS pos, arg_max(cur, pos) AS rhythm FROM s WHERE pos >= 0 GROUP BY 1, 2),
    kept AS (SELECT seq_id, pos, pos // 8 AS measure, rhythm FROM k),
    cl AS (SELECT seq_id, measure, arg_max(contains(rhythm, 'barline') OR contains(rhythm, 'repeat'), pos) AS closed FROM kept GROUP BY 1, 2)
    SELECT seq_id, pos, measure, rhythm FROM kept UNION ALL
    SELECT m.seq_id, NULL, m.measure, 'barline' FROM (SELECT DISTINCT seq_id, measure FROM t) m LEFT JOIN cl USING (seq_id, measure) WHERE NOT coalesce(closed, false)""")
def bar_line_coalescing(spark, sf):
    rows = B.evt(spark, sf).select("seq_id", "pos", F.expr("pos div 8").cast("int").alias("measure"), "rhythm")
    return N.coalesce_bar_lines(rows)


@query("sq09_mark_fill", f"""WITH {B.EVT}, g AS (SELECT *, bool_or(contains(articulation, 'tenuto')) OVER (PARTITION BY seq_id, pos // 4, position) AS any_mark FROM evt)
    SELECT seq_id, pos, CASE WHEN any_mark AND regexp_matches(rhythm, '^(note|rest)') AND NOT contains(articulation, 'tenuto') AND NOT regexp_matches(rhythm, '^(note|rest)_0')
      THEN array_to_string(list_sort(list_concat(['tenuto'], [x FOR x IN string_split(articulation, '_') IF x <> ''])), '_') ELSE articulation END AS articulation FROM g""")
def mark_fill(spark, sf):
    rows = B.evt(spark, sf).withColumn("onset", F.expr("pos div 4"))
    return N.fill_mark(rows, "tenuto", ["seq_id", "onset", "position"]).select("seq_id", "pos", "articulation")


@query("sq15_periodic_core", f"""WITH {B.EVT}, l AS (SELECT event_id // 8 AS page, string_agg(CASE WHEN k % 2 = 0 THEN 'G' ELSE 's' END, '' ORDER BY event_id) AS layout FROM evt GROUP BY 1),
    c AS (SELECT page, layout, p, f, b, length(layout) - f - b AS size, substr(layout, f + 1, length(layout) - f - b) AS core
      FROM l, (SELECT CAST(p AS INTEGER) AS p FROM range(1, 5) r(p)) x, (SELECT CAST(f AS INTEGER) AS f FROM range(0, 5) r(f)) y, (SELECT CAST(b AS INTEGER) AS b FROM range(0, 5) r(b)) z
      WHERE f <= p AND b <= p AND p <= greatest(length(layout) // 2, 1)),
    ok AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY f + b, p, f) AS r FROM c WHERE size >= 2 * p AND size % p = 0 AND core = repeat(substr(core, 1, p), size // p))
    SELECT l.page, l.layout, f + b AS trim, p AS period, f AS front, b AS back FROM l LEFT JOIN ok ON ok.page = l.page AND r = 1""")
def periodic_core(spark, sf):
    letter = F.when(F.col("k") % 2 == 0, F.lit("G")).otherwise(F.lit("s"))
    rows = B.evt(spark, sf).select(F.expr("event_id div 8").alias("page"), "event_id", letter.alias("c"))
    layout = F.array_join(F.array_sort(F.collect_list(F.struct("event_id", "c"))).getField("c"), "")
    return N.periodic_core(rows.groupBy("page").agg(layout.alias("layout")), "layout")


@query("sq17_grand_staff_split", f"""WITH {B.EVT}, r AS (SELECT seq_id, pos, CAST(user_id % 3 AS INTEGER) AS part, CASE position WHEN 'upper' THEN 1 WHEN 'lower' THEN 2 END AS staff FROM evt),
    w AS (SELECT *, coalesce(bool_or(staff = 2) OVER (PARTITION BY seq_id, part), false) AS two FROM r),
    x AS (SELECT *, 1 AS s FROM w WHERE NOT two UNION ALL SELECT *, staff FROM w WHERE two AND staff IS NOT NULL UNION ALL
      SELECT *, 1 FROM w WHERE two AND staff IS NULL UNION ALL SELECT *, 2 FROM w WHERE two AND staff IS NULL)
    SELECT seq_id, pos, part, CAST(dense_rank() OVER (PARTITION BY seq_id ORDER BY part, s) AS INTEGER) AS new_part FROM x""")
def grand_staff_split(spark, sf):
    staff = F.when(F.col("position") == "upper", F.lit(1)).when(F.col("position") == "lower", F.lit(2))
    rows = B.evt(spark, sf).select(
        "seq_id", "pos", (F.col("user_id") % 3).cast("int").alias("part"), staff.alias("staff")
    )
    return N.split_grand_staff(rows).select("seq_id", "pos", "part", "new_part")


@query("sq18_interleave_check", f"""WITH {B.EVT}, {_RM}, a AS (SELECT seq_id, count(DISTINCT measure) AS measures, count(*) FILTER (starts_with(rhythm, 'note_4') OR starts_with(rhythm, 'rest_4') OR starts_with(rhythm, 'note_8')) AS drawn FROM rm GROUP BY 1)
    SELECT seq_id, measures, drawn FROM a WHERE measures = drawn""")
def interleave_check(spark, sf):
    """Pages whose measures times voices equal the drawn measures; the others are skipped."""
    m = N.row_measures(B.evt(spark, sf))
    written = m.groupBy("seq_id").agg((F.max("measure") + 1).cast("bigint").alias("measures"))
    drawn = m.where(F.col("rhythm").rlike("^(note_4|rest_4|note_8)")).groupBy("seq_id").agg(F.count("*").alias("drawn"))
    return written.join(drawn, "seq_id").where("measures = drawn")


@query("sq23_rhythmic_layers", f"""WITH {B.EVT}, m AS (SELECT seq_id, pos, pos // 4 AS chord, position, rhythm, pitch, {tick_sql('rhythm')} AS ticks FROM evt WHERE regexp_matches(rhythm, '^(note|rest)')),
    l AS (SELECT *, CASE WHEN contains(rhythm, 'G') THEN 0 WHEN ticks = 0 THEN max(ticks) OVER (PARTITION BY seq_id, chord, position) ELSE ticks END AS len FROM m),
    d AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY seq_id, chord, position ORDER BY len) AS INTEGER) - 1 AS layer FROM l),
    n AS (SELECT *, row_number() OVER (PARTITION BY seq_id, chord, position, layer, pitch IN ('_', '.') ORDER BY pos) AS nth FROM d)
    SELECT seq_id, pos, layer FROM n WHERE pitch NOT IN ('_', '.') OR nth = 1""")
def rhythmic_layers(spark, sf):
    rows = B.evt(spark, sf).where(T.is_sounding(F.col("rhythm"))).withColumn("chord", F.expr("pos div 4"))
    rows = rows.withColumn("ticks", T.duration_ticks(F.col("rhythm")))
    return N.rhythmic_layers(rows, ["seq_id", "chord", "position"]).select("seq_id", "pos", "layer")


@query("ag14_division_and_numerator", f"""WITH {TICKS}, c AS (SELECT seq_id, measure, chord_id, coalesce(min(ticks), 0) AS t FROM tk GROUP BY 1, 2, 3),
    m AS (SELECT seq_id, measure, sum(t) AS t FROM c GROUP BY 1, 2),
    med AS (SELECT seq_id, coalesce(median(CASE WHEN t > 0 THEN t / 392071680 END), 1.0) AS numerator FROM m GROUP BY 1),
    d AS (SELECT seq_id, list_distinct(list_concat(list(392071680 // gcd(CAST(t AS BIGINT), 392071680)), [4])) AS dens FROM c WHERE t > 0 GROUP BY 1)
    SELECT med.seq_id, numerator, CAST(coalesce(list_reduce(dens, lambda a, b: lcm(a, b)), 4) AS BIGINT) AS division FROM med LEFT JOIN d USING (seq_id)""")
def division_and_numerator(spark, sf):
    return N.division_and_numerator(C.group_measures(C.group_chords(B.evt(spark, sf))))


@query("ag24_leading_clefs", f"""WITH {B.EVT}, {_RM}, f AS (SELECT *, min(CASE WHEN measure = 0 AND regexp_matches(rhythm, '^(note|rest)') THEN pos END) OVER (PARTITION BY seq_id) AS fn FROM rm),
    c AS (SELECT seq_id, count(*) FILTER (measure = 0 AND {_CLEF} AND (fn IS NULL OR pos < fn)) AS clefs FROM f GROUP BY 1)
    SELECT seq_id, clefs, CASE WHEN clefs = 0 THEN 0 WHEN clefs >= 2 THEN 2 ELSE 1 END AS staffs, clefs >= 2 AS grand FROM c""")
def leading_clefs(spark, sf):
    m = N.row_measures(B.evt(spark, sf))
    r = F.col("rhythm")
    first = F.min(F.when((F.col("measure") == 0) & T.is_sounding(r), F.col("pos"))).over(W.partitionBy("seq_id"))
    hit = (F.col("measure") == 0) & r.startswith("clef") & (F.col("_fn").isNull() | (F.col("pos") < F.col("_fn")))
    c = m.withColumn("_fn", first).groupBy("seq_id").agg(F.count_if(hit).alias("clefs"))
    return c.select("seq_id", "clefs", F.least("clefs", F.lit(2)).cast("int").alias("staffs"), (F.col("clefs") >= 2).alias("grand"))


@query("ag25_part_classification", f"""WITH {B.EVT}, p AS (SELECT seq_id, user_id, bool_or(position = 'lower') AS two FROM evt GROUP BY 1, 2)
    SELECT seq_id, user_id, two, CASE WHEN two THEN 'Piano' ELSE 'Voice' END AS part_name, CASE WHEN two THEN 1 ELSE 54 END AS program FROM p""")
def part_classification(spark, sf):
    p = B.evt(spark, sf).groupBy("seq_id", "user_id").agg(F.bool_or(F.col("position") == "lower").alias("two"))
    name = F.when(F.col("two"), F.lit("Piano")).otherwise(F.lit("Voice"))
    return p.select("seq_id", "user_id", "two", name.alias("part_name"), F.when(F.col("two"), F.lit(1)).otherwise(F.lit(54)).alias("program"))


@query("wn21_running_average", f"""WITH {B.EVT} SELECT seq_id, pos, avg(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY seq_id ORDER BY pos) / 100 AS mean_so_far FROM evt""")
def running_average(spark, sf):
    return B.evt(spark, sf).select("seq_id", "pos", (F.avg(F.round(F.col("value") * 100).cast("bigint")).over(N.inclusive("seq_id")) / 100).alias("mean_so_far"))


@query("ag20_overlap_average", f"""WITH {B.EVT}, c AS (SELECT seq_id, pos + o AS cell, value FROM evt, (VALUES (0), (1), (2)) v(o)),
    s AS (SELECT seq_id, cell, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM c GROUP BY 1, 2),
    g AS (SELECT seq_id, max(pos) + 3 AS last FROM evt GROUP BY 1)
    SELECT g.seq_id, CAST(i AS INTEGER) AS cell, coalesce(total, 0) / greatest(coalesce(n, 0), 1) / 100 AS mean FROM g, LATERAL (SELECT unnest(range(0, last + 1)) AS i) r
    LEFT JOIN s ON s.seq_id = g.seq_id AND s.cell = i""")
def overlap_average(spark, sf):
    """Every value covers three cells; the mean per cell, 0 where nothing covers it."""
    e = B.evt(spark, sf)
    cells = e.select("seq_id", F.explode(F.sequence(F.col("pos"), F.col("pos") + 2)).alias("cell"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    sums = cells.groupBy("seq_id", "cell").agg(F.sum("cents").alias("total"), F.count("*").alias("n"))
    grid = e.groupBy("seq_id").agg(F.max("pos").alias("last")).select("seq_id", F.explode(F.sequence(F.lit(0), F.col("last") + 3)).alias("cell"))
    mean = F.coalesce("total", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)) / 100
    return grid.join(sums, ["seq_id", "cell"], "left").select("seq_id", "cell", mean.alias("mean"))


@query("ag16_three_sigma", f"""WITH {B.EVT}, s AS (SELECT *, avg(value) OVER (PARTITION BY seq_id) AS m, stddev_pop(value) OVER (PARTITION BY seq_id) AS sd FROM evt)
    SELECT seq_id, pos, value FROM s WHERE abs(value - m) <= 3 * sd""")
def three_sigma(spark, sf):
    part = W.partitionBy("seq_id")
    s = B.evt(spark, sf).select("seq_id", "pos", "value", F.avg("value").over(part).alias("_m"), F.stddev_pop("value").over(part).alias("_sd"))
    return s.where("abs(value - _m) <= 3 * _sd").select("seq_id", "pos", "value")


@query("ag15_robust_unit", f"""WITH g AS (SELECT event_id // 64 AS seq_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_id // 64 ORDER BY event_id) AS gap FROM events),
    r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY gap, event_id) AS rn, count(*) OVER (PARTITION BY seq_id) AS n FROM g WHERE gap IS NOT NULL)
    SELECT seq_id, avg(gap) / 1e6 AS unit FROM r WHERE rn <= greatest(5, round_even(0.2 * n, 0)) GROUP BY 1""")
def robust_unit(spark, sf):
    seq = B.block("event_id")
    e = B.table(spark, sf, "events").select(seq.alias("seq_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    gaps = e.withColumn("gap", F.col("t") - F.lag("t").over(W.partitionBy("seq_id").orderBy("event_id"))).where("gap is not null")
    part = W.partitionBy("seq_id")
    ranked = gaps.withColumn("rn", F.row_number().over(part.orderBy("gap", "event_id"))).withColumn("n", F.count("*").over(part))
    kept = ranked.where(F.col("rn") <= F.greatest(F.lit(5), F.bround(F.col("n") * 0.2)))
    return kept.groupBy("seq_id").agg((F.avg("gap") / 1e6).alias("unit"))


@query("wn15_gap_sessions", f"""WITH s AS (SELECT event_id // 64 AS seq_id, event_id, epoch_us(ts) AS t, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_id // 64 ORDER BY event_id) AS gap FROM events),
    g AS (SELECT *, sum(CASE WHEN gap > 600000000 * 1.5 THEN 1 ELSE 0 END) OVER (PARTITION BY seq_id ORDER BY event_id) AS grp FROM s)
    SELECT seq_id, CAST(grp AS BIGINT) AS grp, count(*) AS n, min(event_id) AS first_id FROM g GROUP BY 1, 2 HAVING count(*) = 5""")
def gap_sessions(spark, sf):
    """Groups split where the gap exceeds 1.5 units; only groups of exactly five stay."""
    seq = B.block("event_id")
    w = W.partitionBy("seq_id").orderBy("event_id")
    e = B.table(spark, sf, "events").select(seq.alias("seq_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    broke = F.coalesce(F.col("t") - F.lag("t").over(w) > 600_000_000 * 1.5, F.lit(False)).cast("int")
    grouped = e.withColumn("_b", broke).withColumn("grp", F.sum("_b").over(w))
    return grouped.groupBy("seq_id", "grp").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).where("n = 5")


@query("wn16_z_scores", f"""WITH {B.EVT}, p AS (SELECT seq_id, pos, value FROM evt UNION ALL SELECT DISTINCT seq_id, -1, 0.0 FROM evt UNION ALL SELECT seq_id, max(pos) + 1, 0.0 FROM evt GROUP BY 1)
    SELECT seq_id, CAST(pos AS INTEGER) AS pos, round((value - avg(value) OVER (PARTITION BY seq_id)) / nullif(stddev_pop(value) OVER (PARTITION BY seq_id), 0), 6) AS z FROM p""")
def z_scores(spark, sf):
    return SE.z_scores(SE.zero_padded(B.evt(spark, sf).select("seq_id", "pos", "value"))).select("seq_id", "pos", F.round("z", 6).alias("z"))


_PEAKS = """v AS (SELECT seq_id, pos, k % 10 AS h FROM evt),
rn AS (SELECT *, CASE WHEN h IS NOT DISTINCT FROM lag(h) OVER (PARTITION BY seq_id ORDER BY pos) THEN 0 ELSE 1 END AS nw FROM v),
rg AS (SELECT *, sum(nw) OVER (PARTITION BY seq_id ORDER BY pos) AS run FROM rn),
rr AS (SELECT seq_id, run, min(pos) AS lo, max(pos) AS hi, min(h) AS h FROM rg GROUP BY 1, 2),
pk AS (SELECT *, lag(h) OVER (PARTITION BY seq_id ORDER BY run) AS lh, lead(h) OVER (PARTITION BY seq_id ORDER BY run) AS rh FROM rr),
peaks AS (SELECT seq_id, (lo + hi) // 2 AS pos, h FROM pk WHERE h > lh AND h > rh)"""


@query("wn17_local_maxima", f"WITH {B.EVT}, {_PEAKS} SELECT seq_id, CAST(pos AS INTEGER) AS pos, h FROM peaks")
def local_maxima(spark, sf):
    return SE.local_maxima(B.evt(spark, sf).select("seq_id", "pos", (F.col("k") % 10).alias("h")), "h").select("seq_id", "pos", "h")


@query("wn18_peak_prominence", f"""WITH {B.EVT}, {_PEAKS},
    l AS (SELECT p.seq_id, p.pos, p.h, max(v.pos) AS wall FROM peaks p LEFT JOIN v ON v.seq_id = p.seq_id AND v.pos < p.pos AND v.h > p.h GROUP BY 1, 2, 3),
    r AS (SELECT p.seq_id, p.pos, min(v.pos) AS wall FROM peaks p LEFT JOIN v ON v.seq_id = p.seq_id AND v.pos > p.pos AND v.h > p.h GROUP BY 1, 2),
    m AS (SELECT l.seq_id, l.pos, l.h, (SELECT min(h) FROM v WHERE v.seq_id = l.seq_id AND v.pos <= l.pos AND v.pos > coalesce(l.wall, -1)) AS lm,
      (SELECT min(h) FROM v WHERE v.seq_id = l.seq_id AND v.pos >= l.pos AND v.pos < coalesce(r.wall, 99)) AS rm FROM l JOIN r ON r.seq_id = l.seq_id AND r.pos = l.pos)
    SELECT seq_id, CAST(pos AS INTEGER) AS pos, h, h - greatest(lm, rm) AS prominence FROM m""")
def peak_prominence(spark, sf):
    rows = B.evt(spark, sf).select("seq_id", "pos", (F.col("k") % 10).alias("h"))
    return SE.prominence(rows, SE.local_maxima(rows, "h"), "h").select("seq_id", "pos", "h", "prominence")
