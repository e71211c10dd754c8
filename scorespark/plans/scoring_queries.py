"""Scoring and error-analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import vocabulary as V
from ..operators import analytics as A
from ..operators import chords as C
from ..operators import neighbours as N
from ..operators import scoring as S
from ..sources import datasets as D
from ..sources import token_lines
from . import bindings as B
from .registry import query
from .sequence_queries import CHORDS

FIELDS = V.SCORED_FIELDS

# ---- bindings ------------------------------------------------------------------------------------------------------


def event_samples(spark, sf):
    """events as scored samples: even users speak the truth, odd users the prediction; two parts by parity of k."""
    return S.collect_parts(
        B.evt(spark, sf),
        "seq_id",
        F.when(F.col("user_id") % 2 == 0, F.lit("expected")).otherwise(F.lit("actual")),
        F.col("k") % 2,
        "pos",
        FIELDS,
    )


# Every token text of a sample becomes one ASCII letter, so the byte distance of DuckDB equals the token distance.
SAMPLES = B.EVT + """,
tx AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN 'e' ELSE 'a' END AS side, k % 2 AS part,
       concat_ws(' ', rhythm, pitch, lift, articulation, slur) AS txt FROM evt),
dr AS (SELECT *,
  chr(CAST(47 + dense_rank() OVER (PARTITION BY seq_id ORDER BY txt) AS INTEGER)) AS c0,
  chr(CAST(47 + dense_rank() OVER (PARTITION BY seq_id ORDER BY rhythm) AS INTEGER)) AS c1,
  chr(CAST(47 + dense_rank() OVER (PARTITION BY seq_id ORDER BY pitch) AS INTEGER)) AS c2,
  chr(CAST(47 + dense_rank() OVER (PARTITION BY seq_id ORDER BY lift) AS INTEGER)) AS c3,
  chr(CAST(47 + dense_rank() OVER (PARTITION BY seq_id ORDER BY articulation) AS INTEGER)) AS c4,
  chr(CAST(47 + dense_rank() OVER (PARTITION BY seq_id ORDER BY slur) AS INTEGER)) AS c5 FROM tx),
ps AS (SELECT seq_id, side, part, count(*) AS len,
  string_agg(c0, '' ORDER BY pos) AS s0, string_agg(c1, '' ORDER BY pos) AS s1, string_agg(c2, '' ORDER BY pos) AS s2,
  string_agg(c3, '' ORDER BY pos) AS s3, string_agg(c4, '' ORDER BY pos) AS s4, string_agg(c5, '' ORDER BY pos) AS s5
  FROM dr GROUP BY 1, 2, 3),
pi AS (SELECT *, row_number() OVER (PARTITION BY seq_id, side ORDER BY part) - 1 AS i FROM ps),
np AS (SELECT seq_id, max(i) + 1 AS n FROM pi GROUP BY 1),
grid AS (SELECT seq_id, n, i FROM np, (VALUES (0), (1)) g(i) WHERE i < n),
ex AS (SELECT g.seq_id, g.n, g.i, coalesce(len, 0) AS len, coalesce(s0,'') AS s0, coalesce(s1,'') AS s1, coalesce(s2,'') AS s2,
       coalesce(s3,'') AS s3, coalesce(s4,'') AS s4, coalesce(s5,'') AS s5
       FROM grid g LEFT JOIN pi ON pi.seq_id = g.seq_id AND pi.i = g.i AND side = 'e'),
ac AS (SELECT g.seq_id, g.n, g.i, coalesce(len, 0) AS len, coalesce(s0,'') AS s0, coalesce(s1,'') AS s1, coalesce(s2,'') AS s2,
       coalesce(s3,'') AS s3, coalesce(s4,'') AS s4, coalesce(s5,'') AS s5
       FROM grid g LEFT JOIN pi ON pi.seq_id = g.seq_id AND pi.i = g.i AND side = 'a'),
cost AS (SELECT ex.seq_id, ex.n, ex.i, ac.i AS j, levenshtein(ex.s0, ac.s0) AS c FROM ex JOIN ac USING (seq_id)),
sw AS (SELECT seq_id, sum(CASE WHEN i = j THEN c ELSE 0 END) > sum(CASE WHEN i <> j THEN c ELSE 0 END) AND max(n) = 2 AS swap
       FROM cost GROUP BY 1),
al AS (SELECT ex.seq_id, ex.n, ex.i, ac.i AS j, ex.len AS elen, ac.len AS alen,
  levenshtein(ex.s0, ac.s0) AS d0, levenshtein(ex.s1, ac.s1) AS d1, levenshtein(ex.s2, ac.s2) AS d2,
  levenshtein(ex.s3, ac.s3) AS d3, levenshtein(ex.s4, ac.s4) AS d4, levenshtein(ex.s5, ac.s5) AS d5
  FROM ex JOIN sw USING (seq_id) JOIN ac ON ac.seq_id = ex.seq_id AND ac.i = CASE WHEN swap THEN 1 - ex.i ELSE ex.i END),
scored AS (SELECT seq_id, CAST(sum(d0) AS INTEGER) AS distance, CAST(sum(elen) AS INTEGER) AS expected_len,
  CAST(sum(alen) AS INTEGER) AS actual_len, sum(d0) / greatest(sum(elen + alen), 1) AS ned,
  sum(d1) / greatest(sum(elen + alen), 1) AS rhythm_ned, sum(d2) / greatest(sum(elen + alen), 1) AS pitch_ned,
  sum(d3) / greatest(sum(elen + alen), 1) AS lift_ned, sum(d4) / greatest(sum(elen + alen), 1) AS articulation_ned,
  sum(d5) / greatest(sum(elen + alen), 1) AS slur_ned FROM al GROUP BY seq_id)"""

# Turns: words as tokens. The distance depends on equality only, so a word both sides have gets a character of its own, and
# the words of just one side share one character per side.
TURNS = B.TURN + f""",
tl AS (SELECT *, {B.TEXT_WORDS.format(text='expected_text')} AS e, {B.TEXT_WORDS.format(text='actual_text')} AS a
       FROM turn_pairs),
ts AS (SELECT *, list_intersect(e, a) AS sh FROM tl),
td AS (SELECT *, len(e) AS el, len(a) AS alen,
  array_to_string([CASE WHEN list_contains(sh, w) THEN chr(CAST(35 + list_position(sh, w) AS INTEGER)) ELSE '!' END FOR w IN e], '') AS es,
  array_to_string([CASE WHEN list_contains(sh, w) THEN chr(CAST(35 + list_position(sh, w) AS INTEGER)) ELSE '"' END FOR w IN a], '') AS acs FROM ts),
turn_scores AS (SELECT *, CAST(levenshtein(es, acs) AS INTEGER) AS distance FROM td)"""


def turn_scores(spark, sf):
    t = B.turns(spark, sf)
    worded = t.withColumn("e", B.text_words(F.col("expected_text"))).withColumn("a", B.text_words(F.col("actual_text")))
    return worded.withColumn("distance", S.token_distance(F.col("e"), F.col("a"))).withColumn("el", F.size("e").cast("bigint")).withColumn(
        "alen", F.when(F.col("a").isNotNull(), F.size("a").cast("bigint"))
    )


_TOKEN = ", ".join(FIELDS)
_SIDES = ", ".join([f"te.{f} AS exp_{f}" for f in FIELDS] + [f"ta.{f} AS act_{f}" for f in FIELDS])


def alignment_sql(keys: str) -> str:
    """Tables `te` and `ta` (keys, x, txt) and `ends` (keys, elen, alen) to `evn`: events with their indices ei and ai.

    The rule as a recursion: every level matches the best run of each open block and clips the others to both sides.
    """
    best = f"first_value({{'s': s, 'e': e, 'd': d}}) OVER (PARTITION BY {keys}, lvl, bi, bj ORDER BY e - s DESC, s, d DESC)"
    return f""",
hit AS (SELECT {keys}, te.x - ta.x AS d, te.x AS i FROM te JOIN ta USING ({keys}, txt)),
run AS (SELECT {keys}, d, min(i) AS s, max(i) AS e FROM
  (SELECT *, i - row_number() OVER (PARTITION BY {keys}, d ORDER BY i) AS g FROM hit) GROUP BY {keys}, d, g),
rec AS (SELECT {keys}, 0 AS lvl, CAST(0 AS BIGINT) AS bi, CAST(0 AS BIGINT) AS bj, d, s, e FROM run
  UNION ALL SELECT {keys}, lvl + 1, nbi, nbj, d, ns, ne FROM (
    SELECT *, CASE WHEN lft THEN bi ELSE b.e + 1 END AS nbi, CASE WHEN lft THEN bj ELSE b.e - b.d + 1 END AS nbj,
      CASE WHEN lft THEN s ELSE greatest(s, b.e + 1, b.e - b.d + 1 + d) END AS ns,
      CASE WHEN lft THEN least(e, b.s - 1, b.s - b.d - 1 + d) ELSE e END AS ne
    FROM (SELECT *, {best} AS b FROM rec) r, (VALUES (true), (false)) sides(lft)) WHERE ns <= ne),
blk AS (SELECT {keys}, b.s AS i, b.s - b.d AS j, b.e - b.s + 1 AS size FROM (SELECT DISTINCT {keys}, lvl, bi, bj, {best} AS b FROM rec)
  UNION ALL SELECT {keys}, elen, alen, 0 FROM ends),
gap AS (SELECT *, coalesce(lag(i + size) OVER w, 0) AS gi, coalesce(lag(j + size) OVER w, 0) AS gj FROM blk WINDOW w AS (PARTITION BY {keys} ORDER BY i, j)),
off AS (SELECT *, greatest(i - gi, j - gj) AS gm, sum(greatest(i - gi, j - gj) + size) OVER (PARTITION BY {keys} ORDER BY i, j)
  - greatest(i - gi, j - gj) - size AS o FROM gap),
evn AS (SELECT {keys}, CAST(o + x AS INTEGER) AS event_no,
    CASE WHEN x >= gm THEN 'match' WHEN x >= i - gi THEN 'insert' WHEN x >= j - gj THEN 'delete' ELSE 'substitute' END AS event_type,
    CASE WHEN x >= gm THEN i + x - gm WHEN x < i - gi THEN gi + x END AS ei, CASE WHEN x >= gm THEN j + x - gm WHEN x < j - gj THEN gj + x END AS ai
  FROM off, unnest(range(CAST(gm + size AS BIGINT))) r(x))"""


EVENTS = SAMPLES + f""",
tk AS (SELECT pi.seq_id, pi.side, pi.i AS p, row_number() OVER (PARTITION BY pi.seq_id, pi.side, pi.i ORDER BY pos) - 1 AS x, txt, {_TOKEN}
  FROM tx JOIN pi ON pi.seq_id = tx.seq_id AND pi.side = tx.side AND pi.part = tx.part),
te AS (SELECT al.seq_id, al.i AS part, x, txt, {_TOKEN} FROM al JOIN tk ON tk.seq_id = al.seq_id AND tk.side = 'e' AND tk.p = al.i),
ta AS (SELECT al.seq_id, al.i AS part, x, txt, {_TOKEN} FROM al JOIN tk ON tk.seq_id = al.seq_id AND tk.side = 'a' AND tk.p = al.j),
ends AS (SELECT seq_id, i AS part, elen, alen FROM al)""" + alignment_sql("seq_id, part") + f""",
tev AS (SELECT evn.seq_id, CAST(evn.part AS INTEGER) AS part, event_no, CASE WHEN n = 2 AND evn.part = 0 THEN 'upper' WHEN n = 2 THEN 'lower'
    ELSE 'part_' || evn.part END AS staff, event_type, {_SIDES}
  FROM evn JOIN np USING (seq_id) LEFT JOIN te ON te.seq_id = evn.seq_id AND te.part = evn.part AND te.x = ei
  LEFT JOIN ta ON ta.seq_id = evn.seq_id AND ta.part = evn.part AND ta.x = ai)"""

# Words of a turn against the words of its output.
TURN_EVENTS = TURNS + """,
scored_turns AS (SELECT sample_id, e, a, len(e) AS elen, len(a) AS alen FROM turn_scores WHERE actual_text IS NOT NULL),
te AS (SELECT sample_id, i - 1 AS x, e[i] AS txt FROM scored_turns, unnest(range(1, elen + 1)) r(i)),
ta AS (SELECT sample_id, i - 1 AS x, a[i] AS txt FROM scored_turns, unnest(range(1, alen + 1)) r(i)),
ends AS (SELECT sample_id, elen, alen FROM scored_turns)""" + alignment_sql("sample_id")

# ---- distances and scores ------------------------------------------------------------------------------------------


@query("sq01_token_edit_distance", f"WITH {TURNS} SELECT sample_id, distance, el, alen FROM turn_scores")
def token_edit_distance(spark, sf):
    return turn_scores(spark, sf).select("sample_id", "distance", "el", "alen")


_METRICS = "ned, distance, expected_len, actual_len, rhythm_ned, pitch_ned, lift_ned, articulation_ned, slur_ned"


@query("sq02_normalised_edit_distance", f"WITH {SAMPLES} SELECT seq_id, {_METRICS} FROM scored")
def normalised_edit_distance(spark, sf):
    return S.score_samples(event_samples(spark, sf), "seq_id")


@query("jn16_part_assignment", f"""WITH {SAMPLES} SELECT seq_id, CAST(i AS INTEGER) AS part, CAST(j AS INTEGER) AS matched,
    CAST(d0 AS INTEGER) AS cost FROM al""")
def part_assignment(spark, sf):
    parts = S.matched_parts(S.align_parts(event_samples(spark, sf)), ["seq_id"])
    return parts.select("seq_id", "part", "matched", "cost")


@query("sq04_part_naming", f"""WITH {SAMPLES} SELECT seq_id, CAST(i AS INTEGER) AS part, CASE WHEN n = 2 AND i = 0 THEN 'upper'
    WHEN n = 2 THEN 'lower' ELSE 'part_' || i END AS staff FROM grid""")
def part_naming(spark, sf):
    padded = S.pad_parts(event_samples(spark, sf))
    parts = padded.select("seq_id", "n_parts", F.posexplode("expected").alias("part", "_t"))
    return parts.select("seq_id", "part", S.part_name(F.col("part"), F.col("n_parts")).alias("staff"))


def alignment_events(spark, sf):
    parts = S.matched_parts(S.align_parts(event_samples(spark, sf)), ["seq_id"])
    return S.alignment_events(parts, ["seq_id"])


query("sq03_alignment_events", f"WITH RECURSIVE {EVENTS} SELECT * FROM tev")(alignment_events)


@query("sq03_alignment_totals", f"""WITH {SAMPLES} SELECT seq_id, CAST(sum(elen) AS BIGINT) AS expected_side,
    CAST(sum(alen) AS BIGINT) AS actual_side FROM al GROUP BY seq_id""")
def alignment_totals(spark, sf):
    """Conservation: every expected token is matched, substituted or deleted exactly once, every actual one likewise."""
    e = F.col("event_type")
    return alignment_events(spark, sf).groupBy("seq_id").agg(
        F.count_if(e.isin("match", "substitute", "delete")).alias("expected_side"),
        F.count_if(e.isin("match", "substitute", "insert")).alias("actual_side"),
    )


@query("ag09_weighted_difference", f"""WITH {SAMPLES},
    cls AS (SELECT *, CASE WHEN starts_with(rhythm, 'keySignature') THEN 'k' WHEN regexp_matches(rhythm, '^(note|rest)') THEN 'n' END AS cl,
            chr(CAST(47 + dense_rank() OVER (PARTITION BY seq_id ORDER BY concat_ws(' ', rhythm, pitch, lift)) AS INTEGER)) AS c FROM tx),
    st AS (SELECT seq_id, coalesce(string_agg(c, '' ORDER BY pos) FILTER (side = 'e' AND cl = 'k'), '') AS ek,
      coalesce(string_agg(c, '' ORDER BY pos) FILTER (side = 'a' AND cl = 'k'), '') AS ak,
      coalesce(string_agg(c, '' ORDER BY pos) FILTER (side = 'e' AND cl = 'n'), '') AS en,
      coalesce(string_agg(c, '' ORDER BY pos) FILTER (side = 'a' AND cl = 'n'), '') AS an FROM cls GROUP BY 1)
    SELECT seq_id, CAST(10 * levenshtein(ek, ak) + levenshtein(en, an) AS INTEGER) AS diff,
      CAST(levenshtein(ek || en, ak || an) AS INTEGER) AS distance, CAST(length(ek || en) AS INTEGER) AS expected_length FROM st""")
def weighted_difference(spark, sf):
    r = F.col("rhythm")
    kind = F.when(r.startswith("keySignature"), F.lit("k")).when(T.is_sounding(r), F.lit("n"))
    side = F.when(F.col("user_id") % 2 == 0, F.lit("e")).otherwise(F.lit("a"))
    rows = B.evt(spark, sf).select("seq_id", "pos", kind.alias("kind"), side.alias("side"), F.concat_ws(" ", "rhythm", "pitch", "lift").alias("t"))

    def tokens(s: str, k: str):
        own = F.collect_list(F.when((F.col("side") == s) & (F.col("kind") == k), F.struct("pos", "t")))
        return F.array_sort(own).getField("t").alias(s + k)

    lists = rows.groupBy("seq_id").agg(*[tokens(s, k) for s in "ea" for k in "kn"])
    expected, actual = F.concat("ek", "en"), F.concat("ak", "an")
    return lists.select(
        "seq_id",
        S.weighted_difference(
            S.token_distance(F.col("ek"), F.col("ak")), S.token_distance(F.col("en"), F.col("an"))
        ).alias("diff"),
        S.token_distance(expected, actual).alias("distance"),
        F.size(expected).alias("expected_length"),
    )


@query("ag08_micro_macro_rate", f"""WITH {TURNS} SELECT avg(distance / el) AS macro, sum(distance) / sum(el) AS micro, count(*) AS n
    FROM turn_scores WHERE distance IS NOT NULL""")
def micro_macro_rate(spark, sf):
    s = turn_scores(spark, sf).where("actual_text is not null")
    return s.agg(
        F.avg(F.try_divide("distance", "el")).alias("macro"),
        F.try_divide(F.sum("distance"), F.sum("el")).alias("micro"),
        F.count("*").alias("n"),
    )


@query("pf23_high_error_report", f"""WITH {TURNS} SELECT sample_id, round_even(100.0 * distance / el, 0) AS ser, expected_text, actual_text
    FROM turn_scores WHERE round_even(100.0 * distance / el, 0) > 25""")
def high_error_report(spark, sf):
    ser = F.bround(F.try_divide(F.col("distance") * 100.0, F.col("el")), 0)
    row = F.struct("sample_id", ser.alias("ser"), "expected_text", "actual_text")
    # a generator keeps the distance from being computed once for the filter and once for the output
    return turn_scores(spark, sf).select(F.inline(F.filter(F.array(row), lambda r: r["ser"] > 25)))


@query("sq19_rescoring", f"""WITH {TURNS} SELECT sample_id, distance, distance / greatest(el + alen, 1) AS ned FROM turn_scores
    WHERE actual_text IS NOT NULL""")
def rescoring(spark, sf):
    """Recompute scores from stored text; samples without output stay out."""
    stored = turn_scores(spark, sf).where("actual_text is not null")
    return stored.select("sample_id", "distance", S.normalised(F.col("distance"), F.col("el"), F.col("alen")).alias("ned"))


@query("sq20_producer_agreement", f"""WITH {TURNS} SELECT count(*) AS pairs,
    count(*) FILTER (expected_text IS NULL OR trim(expected_text) = '') AS empty_first,
    count(*) FILTER (actual_text IS NULL OR trim(actual_text) = '') AS empty_second,
    avg(distance / greatest(el + alen, 1)) AS mean_ned, min(distance / greatest(el + alen, 1)) AS min_ned,
    max(distance / greatest(el + alen, 1)) AS max_ned FROM turn_scores""")
def producer_agreement(spark, sf):
    s = turn_scores(spark, sf).withColumn("ned", S.normalised(F.col("distance"), F.col("el"), F.col("alen")))

    def empty(c: str):
        return F.count_if(F.col(c).isNull() | (F.trim(c) == ""))

    return s.agg(
        F.count("*").alias("pairs"),
        empty("expected_text").alias("empty_first"),
        empty("actual_text").alias("empty_second"),
        F.avg("ned").alias("mean_ned"),
        F.min("ned").alias("min_ned"),
        F.max("ned").alias("max_ned"),
    )


@query("sq21_round_trip", f"""WITH {CHORDS} SELECT seq_id, count(DISTINCT chord_id) AS lines, CAST(0 AS BIGINT) AS mismatches
    FROM chords GROUP BY seq_id""")
def round_trip(spark, sf):
    """Token lines read back and written again must be the same lines."""
    lines = C.chord_lines(C.group_chords(B.evt(spark, sf)))
    parsed = token_lines.parse_lines(lines.withColumnRenamed("chord_id", "line_no"), ["seq_id"], "line")
    again = C.chord_lines(
        C.group_chords(token_lines.with_markers(parsed, ["seq_id"])), ["seq_id"]
    ).withColumnRenamed("line", "second")
    joined = lines.join(again, ["seq_id", "chord_id"], "left")
    return joined.groupBy("seq_id").agg(
        F.count("*").alias("lines"), F.count_if(~F.col("line").eqNullSafe(F.col("second"))).alias("mismatches")
    )


@query("jn01_truth_prediction_join", f"""WITH {B.TURN} SELECT sample_id, CASE WHEN actual_text IS NULL THEN 'no output' END AS error,
    length(expected_text) AS expected_chars FROM turn_pairs""")
def truth_prediction_join(spark, sf):
    c = B.table(spark, sf, "conversations")
    key = F.concat_ws("_", "conv_id", F.col("turn"))
    truth = c.where("role = 'user'").select(key.alias("sample_id"), F.length("text").cast("bigint").alias("expected_chars"))
    out = c.where("role = 'assistant'").select(
        F.concat_ws("_", "conv_id", F.col("turn") - 1).alias("sample_id"), F.col("text").alias("output")
    )
    return A.attach_predictions(truth, out, "sample_id", "output").select("sample_id", "error", "expected_chars")


# Tokens of a pair of files as characters, in the way of the turns above.
_FILES = """
files AS (SELECT seq_id, seq_id // 4 AS folder, sum(k) % 4 = 0 AS is_ref,
  list(concat_ws(' ', rhythm, pitch, lift, articulation, slur, position) ORDER BY pos) FILTER (regexp_matches(rhythm, '^(note|rest)')) AS s0 FROM evt GROUP BY 1),
f1 AS (SELECT * REPLACE (coalesce(s0, CAST([] AS VARCHAR[])) AS s0), count(*) FILTER (is_ref) OVER (PARTITION BY folder) AS refs FROM files),
f2 AS (SELECT a.folder, a.seq_id, b.seq_id AS other, a.s0 AS x, b.s0 AS y, list_intersect(a.s0, b.s0) AS sh FROM f1 a JOIN f1 b
  ON a.folder = b.folder AND a.seq_id <> b.seq_id WHERE a.refs <> 1 OR (b.is_ref AND NOT a.is_ref)),
pairs AS (SELECT folder, seq_id, other, levenshtein(
  array_to_string([CASE WHEN list_contains(sh, t) THEN chr(CAST(35 + list_position(sh, t) AS INTEGER)) ELSE '!' END FOR t IN y], ''),
  array_to_string([CASE WHEN list_contains(sh, t) THEN chr(CAST(35 + list_position(sh, t) AS INTEGER)) ELSE '"' END FOR t IN x], '')) AS diff FROM f2),
best AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY diff, other) AS r FROM pairs)"""


@query("jn15_nearest_in_group", f"""WITH {B.EVT}, {_FILES} SELECT folder, seq_id, other, CAST(diff AS INTEGER) AS diff FROM best WHERE r = 1""")
def nearest_in_group(spark, sf):
    """Each file against its closest other file of the folder, or against the one reference. Folders hold four files.

    Whole tokens of notes and rests are compared, all six fields of them.
    """
    t = B.evt(spark, sf)
    token = F.concat_ws(" ", *V.TOKEN_FIELDS)
    files = t.groupBy("seq_id").agg(
        F.array_sort(
            F.collect_list(F.when(T.is_sounding(F.col("rhythm")), F.struct("pos", token.alias("t"))))
        ).getField("t").alias("notes"),
        (F.sum("k") % 4 == 0).alias("is_ref"),
    ).withColumn("folder", F.expr("seq_id div 4"))
    return N.nearest_in_folder(files, "folder", "seq_id", "notes", "is_ref")


# ---- analytics -----------------------------------------------------------------------------------------------------


@query("ag01_run_summary", f"""WITH {B.TURN} SELECT count(*) AS total, count(actual_text) AS succeeded,
    count(*) - count(actual_text) AS failed FROM turn_pairs""")
def run_summary(spark, sf):
    t = B.turns(spark, sf)
    return A.run_summary(t.withColumn("error", F.when(F.col("actual_text").isNull(), F.lit("no output"))))


_STATS = " UNION ALL ".join(
    f"SELECT '{m}' AS component, round(avg({m}), 9) AS mean, median({m}) AS median, min({m}) AS min, max({m}) AS max FROM scored"
    for m in A.COMPONENTS
)


@query("ag02_component_statistics", f"WITH {SAMPLES} {_STATS}")
def component_statistics(spark, sf):
    stats = A.component_statistics(S.score_samples(event_samples(spark, sf), "seq_id"))
    return stats.withColumn("mean", F.round("mean", 9))


@query("ag03_sample_variance", f"""WITH {SAMPLES} SELECT CASE WHEN count(*) > 1 THEN round(var_samp(100 * ned), 6) END AS variance,
    count(*) AS n FROM scored""")
def sample_variance(spark, sf):
    scored = S.score_samples(event_samples(spark, sf), "seq_id")
    return scored.agg(
        F.when(F.count("*") > 1, F.round(F.var_samp(F.col("ned") * 100), 6)).alias("variance"), F.count("*").alias("n")
    )


@query("ag04_score_histogram", """WITH b AS (SELECT least(CAST(floor(value / 50 * 10) AS INTEGER), 10) AS bucket FROM events)
    SELECT CAST(i AS INTEGER) AS bucket, CASE WHEN i = 10 THEN '>100%' ELSE (i * 10) || '-' || (i * 10 + 10) || '%' END AS label,
    count(bucket) AS n FROM range(11) g(i) LEFT JOIN b ON bucket = i GROUP BY i""")
def score_histogram(spark, sf):
    return A.score_histogram(B.table(spark, sf, "events"), F.col("value") / 50)


@query("ag05_event_breakdown", f"WITH RECURSIVE {EVENTS} SELECT event_type, count(*) AS n FROM tev GROUP BY 1")
def event_breakdown(spark, sf):
    return alignment_events(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"))


@query("ag06_error_rates", f"""WITH RECURSIVE {EVENTS} SELECT exp_pitch AS token, count(*) AS total,
    count(*) FILTER (event_type <> 'match') AS errors, round_even(count(*) FILTER (event_type <> 'match') / count(*) * 100, 1) AS rate
    FROM tev WHERE exp_pitch IS NOT NULL GROUP BY 1 HAVING count(*) >= 20
    ORDER BY count(*) FILTER (event_type <> 'match') / count(*) DESC, 1 LIMIT 20""")
def error_rates(spark, sf):
    return A.error_rates(alignment_events(spark, sf), "pitch")


@query("ag07_field_frequencies", f"WITH {B.EVT} " + " UNION ALL ".join(
    f"SELECT '{f}' AS field, {f} AS token, count(*) AS n FROM evt GROUP BY {f}" for f in FIELDS))
def field_frequencies(spark, sf):
    return A.field_frequencies(B.evt(spark, sf), FIELDS)


@query("ag07_longest_sequence", f"WITH {B.EVT} SELECT max(n) AS max_seq_len FROM (SELECT count(*) AS n FROM evt GROUP BY seq_id) x")
def longest_sequence(spark, sf):
    return B.evt(spark, sf).groupBy("seq_id").count().agg(F.max("count").alias("max_seq_len"))


@query("sl01_top_missing", f"""WITH RECURSIVE {EVENTS} SELECT exp_pitch AS token, count(*) AS n FROM tev WHERE event_type = 'delete'
    AND exp_pitch IS NOT NULL GROUP BY 1 ORDER BY n DESC, token LIMIT 20""")
def top_missing(spark, sf):
    return A.top_events(alignment_events(spark, sf), "delete", "pitch")


@query("sl01_top_hallucinated", f"""WITH RECURSIVE {EVENTS} SELECT act_rhythm AS token, count(*) AS n FROM tev WHERE event_type = 'insert'
    AND act_rhythm IS NOT NULL GROUP BY 1 ORDER BY n DESC, token LIMIT 20""")
def top_hallucinated(spark, sf):
    return A.top_events(alignment_events(spark, sf), "insert", "rhythm")


@query("sl02_top_confusions", f"""WITH RECURSIVE {EVENTS} SELECT exp_pitch AS expected, act_pitch AS actual, count(*) AS n FROM tev
    WHERE event_type = 'substitute' AND exp_pitch <> act_pitch GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 20""")
def top_confusions(spark, sf):
    return A.top_substitutions(alignment_events(spark, sf), "pitch")


@query("sc11_samples_upsert", """SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id,
    arg_max(value, {'t': ts, 'e': event_id}) AS value,
    arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END, {'t': ts, 'e': event_id}) AS status
    FROM events GROUP BY user_id""")
def samples_upsert(spark, sf):
    status = F.when(F.col("event_type") == "error", F.lit("failed")).otherwise(F.lit("ok"))
    runs = B.table(spark, sf, "events").select("user_id", "ts", "event_id", "value", status.alias("status"))
    return A.latest_rows(runs, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "value", "status")


@query("so05_resume_difference", f"""WITH {B.EVT} SELECT DISTINCT seq_id FROM evt WHERE seq_id NOT IN
    (SELECT seq_id FROM evt WHERE rhythm = 'repeatEndStart')""")
def resume_difference(spark, sf):
    """Pending ids: everything minus what the store holds. Both sides are distinct ids only."""
    t = B.evt(spark, sf)
    stored = t.where("rhythm = 'repeatEndStart'").select("seq_id").distinct()
    return t.select("seq_id").distinct().join(stored, "seq_id", "left_anti")


@query("sl04_offset_fetch", f"""WITH {B.TURN} SELECT sample_id, expected_text FROM turn_pairs ORDER BY conv_id, turn LIMIT 1 OFFSET 17""")
def offset_fetch(spark, sf):
    return B.turns(spark, sf).orderBy("conv_id", "turn").offset(17).limit(1).select("sample_id", "expected_text")


@query("sl05_ordered_listing", """SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NULL THEN 'ERROR' ELSE 'scored' END AS state
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY d.doc_id""")
def ordered_listing(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id")
    lab = B.table(spark, sf, "labels").select("doc_id", "quality")
    state = F.when(F.col("quality").isNull(), F.lit("ERROR")).otherwise(F.lit("scored"))
    return docs.join(lab, "doc_id", "left").select("doc_id", "quality", state.alias("state")).orderBy("doc_id")


@query("sl06_limit_before_skip", f"""WITH {B.EVT}, ids AS (SELECT DISTINCT seq_id FROM evt ORDER BY seq_id LIMIT 50)
    SELECT seq_id FROM ids WHERE seq_id NOT IN (SELECT seq_id FROM evt WHERE rhythm = 'repeatEndStart')""")
def limit_before_skip(spark, sf):
    t = B.evt(spark, sf)
    stored = t.where("rhythm = 'repeatEndStart'").select("seq_id").distinct()
    return t.select("seq_id").distinct().orderBy("seq_id").limit(50).join(stored, "seq_id", "left_anti")


def _report_sql() -> str:
    def top(section: str, field: str | None, where: str, token: str, other: str = "NULL", having: str = "true", order: str = "count(*)") -> str:
        rate = "round_even(count(*) FILTER (event_type <> 'match') / count(*) * 100, 1)" if section == "error_rates" else "NULL"
        label = f"'{field}'" if field else "NULL"
        return f"""SELECT '{section}' AS section, CAST({label} AS VARCHAR) AS field, CAST(row_number() OVER (ORDER BY {order} DESC, {token}, {other}) AS INTEGER) AS rank,
          {token} AS token, CAST({other} AS VARCHAR) AS other, count(*) AS n, count(*) FILTER (event_type <> 'match') AS errors, CAST({rate} AS DOUBLE) AS rate
          FROM tev WHERE {where} GROUP BY {token}, {other} HAVING {having}"""

    parts = [top("event_breakdown", None, "true", "event_type")]
    parts += [top("missing", f, f"event_type = 'delete' AND exp_{f} IS NOT NULL", f"exp_{f}") for f in ("rhythm", "pitch", "lift")]
    parts += [top("hallucinated", f, f"event_type = 'insert' AND act_{f} IS NOT NULL", f"act_{f}") for f in ("rhythm", "pitch", "lift")]
    parts += [top("substitutions", f, f"event_type = 'substitute' AND exp_{f} <> act_{f}", f"exp_{f}", f"act_{f}") for f in ("rhythm", "pitch")]
    parts += [top("error_rates", f, f"exp_{f} IS NOT NULL", f"exp_{f}", having="count(*) >= 20", order="count(*) FILTER (event_type <> 'match') / count(*)") for f in ("rhythm", "pitch")]
    return f"WITH RECURSIVE {EVENTS}, report AS ({' UNION ALL '.join(parts)}) SELECT * FROM report WHERE rank <= 20"


@query("sc15_report_rows", _report_sql())
def report_rows(spark, sf):
    """Every token table of the report from the aligned events, in one pass."""
    return A.report_rows(alignment_events(spark, sf))


@query("sc15_report_dataset")
def report_dataset(spark, sf):
    """All report tables as one row; the aligned events are read once."""
    return A.report(alignment_events(spark, sf), summary=run_summary(spark, sf), ned_distribution=score_histogram(spark, sf))


@query("sc16_diff_export", f"""WITH {B.TURN}, l AS (SELECT sample_id, actual_text,
      regexp_extract(regexp_replace(actual_text, '^\\s+', ''), '(?m)^([^!\\n][^\\n]*|!([^!\\n][^\\n]*)?)$', 1) AS line FROM turn_pairs)
    SELECT sample_id, 'expected' AS side, expected_text AS content, 'krn' AS extension FROM turn_pairs WHERE expected_text <> ''
    UNION ALL SELECT sample_id, 'actual', actual_text, CASE WHEN starts_with(line, '**') OR contains(line, chr(9) || '**kern') THEN 'krn' ELSE 'musicxml' END
    FROM l WHERE actual_text <> ''""")
def diff_export(spark, sf):
    """Written as a bundle and read back."""
    folder = B.work_folder(spark, "diff")
    D.export_diff(B.turns(spark, sf).withColumnRenamed("expected_text", "kern_text"), folder)
    return D.read_diff(spark, folder)


def _pad(x, n):
    return f"CASE WHEN length({x}) < {n} THEN rpad({x}, {n}, ' ') ELSE {x} END"


def _col_sql(side):
    v = {f: f"coalesce({side}_{f}, '.')" for f in FIELDS}
    parts = [_pad(v["rhythm"], 22), _pad(v["pitch"], 6), _pad(v["lift"], 4), _pad(v["articulation"], 12), v["slur"]]
    return " || ' ' || ".join(f"({p})" for p in parts)


@query("sf25_side_by_side", f"""WITH RECURSIVE {EVENTS}, x AS (SELECT *, {_col_sql('exp')} AS e0, {_col_sql('act')} AS a FROM tev),
    y AS (SELECT *, {_pad('e0', 47)} AS e FROM x)
    SELECT seq_id, part, event_no, event_type, CASE event_type WHEN 'match' THEN '  ' || e || '  ' || a WHEN 'delete' THEN '< ' || e
      WHEN 'insert' THEN '  ' || repeat(' ', 47) || '> ' || a ELSE '! ' || e || '! ' || a END AS line FROM y""")
def side_by_side(spark, sf):
    return A.side_by_side(alignment_events(spark, sf), FIELDS).select("seq_id", "part", "event_no", "event_type", "line")
