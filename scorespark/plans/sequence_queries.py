"""Token-sequence queries: chords, measures, carried state, durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import vocabulary as V
from ..operators import chords as C
from ..sources import token_lines
from . import bindings as B
from .registry import query

# ---- SQL building blocks -------------------------------------------------------------------------------------------

CHORDS = B.EVT + """,
ch1 AS (SELECT *, coalesce(lag(rhythm = 'chord') OVER (PARTITION BY seq_id ORDER BY pos), false) AS marked FROM evt),
ch2 AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS n FROM ch1 WHERE rhythm <> 'chord'),
ch3 AS (SELECT *, CASE WHEN n = 1 THEN 1
                       WHEN marked OR (n = 2 AND lag(marked) OVER (PARTITION BY seq_id ORDER BY pos)) THEN 0
                       ELSE 1 END AS st FROM ch2),
ch4 AS (SELECT *, CAST(sum(st) OVER (PARTITION BY seq_id ORDER BY pos) AS INTEGER) - 1 AS chord_id FROM ch3),
chords AS (SELECT *, CAST(row_number() OVER (PARTITION BY seq_id, chord_id ORDER BY pos) AS INTEGER) AS member FROM ch4)"""

MEASURES = CHORDS + """,
me1 AS (SELECT *, CASE WHEN member = 1 AND (contains(rhythm, 'barline') OR contains(rhythm, 'repeat')) THEN 1 ELSE 0 END
        AS closes FROM chords),
measures AS (SELECT *, CAST(sum(closes) OVER (PARTITION BY seq_id ORDER BY pos)
                    - max(closes) OVER (PARTITION BY seq_id, chord_id) AS INTEGER) AS measure FROM me1)"""


def tick_sql(rhythm: str) -> str:
    """Length in ticks, written with plain arithmetic."""
    base = f"CAST(regexp_extract({rhythm}, '^(?:note|rest)_([0-9]+)', 1) AS BIGINT)"
    dots = f"(length({rhythm}) - length(replace({rhythm}, '.', '')))"
    return (
        f"CASE WHEN NOT regexp_matches({rhythm}, '^(note|rest)') THEN NULL WHEN contains({rhythm}, 'G') THEN 0 "
        f"ELSE CAST(392071680 // greatest({base}, 1) * (2 * CAST(pow(2, {dots}) AS BIGINT) - 1) "
        f"// CAST(pow(2, {dots}) AS BIGINT) AS BIGINT) END"
    )


TICKS = MEASURES + f""",
tk AS (SELECT *, {tick_sql('rhythm')} AS ticks FROM measures),
durs AS (SELECT seq_id, measure, CAST(coalesce(sum(t), 0) AS BIGINT) AS ticks FROM
         (SELECT seq_id, measure, chord_id, min(CASE WHEN ticks > 0 THEN ticks END) AS t FROM tk GROUP BY 1, 2, 3) x
         GROUP BY 1, 2),
typ AS (SELECT seq_id, ticks AS typical FROM
        (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY ticks) AS r, count(*) OVER (PARTITION BY seq_id) AS n
         FROM durs) x WHERE r = n // 2 + 1)"""


def no_tuplet_sql(rhythm: str) -> str:
    base = f"CAST(regexp_extract({rhythm}, '^(?:note|rest)_([0-9]+)', 1) AS BIGINT)"
    rebuilt = (
        f"regexp_extract({rhythm}, '^(note|rest)_', 1) || '_' || CAST({{n}} AS VARCHAR) || "
        f"regexp_extract({rhythm}, '^(?:note|rest)_[0-9]+(.*)$', 1)"
    )
    return (
        f"CASE WHEN NOT regexp_matches({rhythm}, '^(note|rest)_[0-9]+') THEN {rhythm} "
        f"WHEN {base} % 3 = 0 THEN {rebuilt.format(n=base + ' // 3 * 2')} "
        f"WHEN {base} % 5 = 0 THEN {rebuilt.format(n=base + ' // 5 * 4')} "
        f"WHEN {base} % 7 = 0 THEN {rebuilt.format(n=base + ' // 7 * 4')} ELSE {rhythm} END"
    )


def map_sql(values: dict, key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} = '{k}' THEN {v!r}" for k, v in values.items()) + " END"


def step_sql(pitch: str) -> str:
    return (
        f"CASE WHEN regexp_matches({pitch}, '^[A-G][#bN]*[0-9]$') THEN CAST(right({pitch}, 1) AS INTEGER) * 7 + "
        f"strpos('CDEFGAB', left({pitch}, 1)) - 1 END"
    )


LEDGER = B.EVT + f""",
lg1 AS (SELECT *, CASE WHEN starts_with(rhythm, 'clef') THEN {map_sql(V.CLEF_MIDDLE_PITCH, 'rhythm')} END AS mid FROM evt),
lg2 AS (SELECT *,
  last_value(CASE WHEN position <> 'lower' THEN {step_sql('mid')} END IGNORE NULLS)
     OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up,
  last_value(CASE WHEN position <> 'upper' THEN {step_sql('mid')} END IGNORE NULLS)
     OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM lg1),
ledger AS (SELECT *, CASE WHEN starts_with(rhythm, 'note') THEN greatest(0, CAST(floor((abs({step_sql('pitch')} -
  CASE WHEN position = 'lower' THEN coalesce(low, 22) ELSE coalesce(up, 34) END) - 3) / 2.0) AS INTEGER)) END AS ledger
  FROM lg2)"""

RHYTHM_IDS = "(VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(V.rhythm_tokens())) + ") rv(rt, rid)"
PITCH_IDS = "(VALUES " + ", ".join(f"('{t}', {i})" for i, t in enumerate(V.pitch_tokens())) + ") pv(pt, pid)"
N_RHYTHM = len(V.rhythm_tokens())

KEYED = CHORDS + f""",
keyed AS (SELECT c.*, concat_ws(' ', rhythm, pitch, lift, articulation, slur, position) AS txt,
  CAST(CASE WHEN contains(rhythm, 'note') THEN pid * {N_RHYTHM} + rid WHEN contains(rhythm, 'rest') THEN 100000 + rid
       ELSE 1000000 END + CASE WHEN position = 'lower' THEN 10000000 ELSE 0 END AS INTEGER) AS sort_key
  FROM chords c LEFT JOIN {RHYTHM_IDS} ON rt = rhythm LEFT JOIN {PITCH_IDS} ON pt = pitch)"""

HOISTED = KEYED + """,
h1 AS (SELECT *, row_number() OVER (PARTITION BY seq_id, chord_id ORDER BY sort_key, txt DESC, member) AS rank,
       position = 'lower' AS low, regexp_matches(rhythm, '^(note|rest|clef)') AS placed FROM keyed),
h2 AS (SELECT *, min(rank) OVER (PARTITION BY seq_id, chord_id, low) = rank AS is_lead,
  CASE WHEN articulation = '.' AND NOT placed THEN [] ELSE [x FOR x IN string_split(articulation, '_') IF x <> ''] END AS oa,
  CASE WHEN slur = '.' AND NOT placed THEN [] ELSE [x FOR x IN string_split(slur, '_') IF x <> ''] END AS os FROM h1),
h3 AS (SELECT seq_id, chord_id, low, list_distinct(flatten(list(oa))) AS ua, list_distinct(flatten(list(os))) AS us
       FROM h2 GROUP BY 1, 2, 3),
h4 AS (SELECT h2.*,
  CASE WHEN len(ua) > 1 THEN [x FOR x IN ua IF x <> '.'] ELSE ua END AS ma,
  CASE WHEN len(us) > 1 THEN [x FOR x IN us IF x <> '.'] ELSE us END AS ms,
  CASE WHEN articulation = '.' AND NOT placed THEN '.' ELSE '_' END AS ba,
  CASE WHEN slur = '.' AND NOT placed THEN '.' ELSE '_' END AS bs
  FROM h2 JOIN h3 USING (seq_id, chord_id, low)),
hoisted AS (SELECT seq_id, chord_id, CAST(rank AS INTEGER) AS rank, rhythm, pitch, lift, position,
  CASE WHEN is_lead AND len(ma) > 0 THEN array_to_string(list_sort(list_concat(ma, CASE WHEN ba = '.' THEN ['.'] ELSE [] END)), '_')
       ELSE ba END AS articulation,
  CASE WHEN is_lead AND len(ms) > 0 THEN array_to_string(list_sort(list_concat(ms, CASE WHEN bs = '.' THEN ['.'] ELSE [] END)), '_')
       ELSE bs END AS slur FROM h4)"""

FIELDS = ", ".join(V.TOKEN_FIELDS)

# ---- queries -------------------------------------------------------------------------------------------------------


@query("wn01_chord_grouping", f"WITH {CHORDS} SELECT seq_id, pos, chord_id, member, rhythm, pitch FROM chords")
def chord_grouping(spark, sf):
    return C.group_chords(B.evt(spark, sf)).select("seq_id", "pos", "chord_id", "member", "rhythm", "pitch")


@query("wn02_measure_grouping", f"WITH {MEASURES} SELECT seq_id, pos, chord_id, measure FROM measures")
def measure_grouping(spark, sf):
    return C.group_measures(C.group_chords(B.evt(spark, sf))).select("seq_id", "pos", "chord_id", "measure")


@query(
    "wn03_redundant_signatures",
    f"""WITH {CHORDS}, cl AS (SELECT *, CASE WHEN starts_with(rhythm, 'clef') AND position = 'upper' THEN 'cu'
      WHEN starts_with(rhythm, 'clef') THEN 'cl' WHEN starts_with(rhythm, 'key') THEN 'k'
      WHEN starts_with(rhythm, 'time') THEN 't' END AS cls FROM chords),
    lg AS (SELECT *, lag(rhythm) OVER (PARTITION BY seq_id, cls ORDER BY pos) AS prev FROM cl)
    SELECT seq_id, pos, chord_id, rhythm, position FROM lg WHERE cls IS NULL OR prev IS DISTINCT FROM rhythm""",
)
def redundant_signatures(spark, sf):
    kept = C.drop_redundant_signatures(C.group_chords(B.evt(spark, sf)))
    return kept.select("seq_id", "pos", "chord_id", "rhythm", "position")


@query(
    "wn04_adjacent_keys",
    f"""WITH {B.EVT}, lg AS (SELECT *, lag(rhythm) OVER (PARTITION BY seq_id ORDER BY pos) AS prev FROM evt)
    SELECT seq_id, pos, rhythm FROM lg WHERE NOT (starts_with(rhythm, 'keySignature') AND prev IS NOT DISTINCT FROM rhythm)""",
)
def adjacent_keys(spark, sf):
    return C.collapse_adjacent_keys(B.evt(spark, sf)).select("seq_id", "pos", "rhythm")


@query(
    "wn05_accidental_carry",
    f"""WITH {B.EVT}, b AS (SELECT *, sum(CASE WHEN contains(rhythm, 'barline') THEN 1 ELSE 0 END)
        OVER (PARTITION BY seq_id ORDER BY pos) AS bar, CASE WHEN lift IN ('#', 'b', 'N') THEN lift END AS ex FROM evt),
    c AS (SELECT *, last_value(ex IGNORE NULLS) OVER (PARTITION BY seq_id, bar, pitch ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM b)
    SELECT seq_id, pos, pitch, CASE WHEN lift = '.' THEN '.' WHEN ex IS NOT NULL THEN ex
        WHEN held IN ('#', 'b') THEN held ELSE '_' END AS lift FROM c""",
)
def accidental_carry(spark, sf):
    return C.carry_accidentals(B.evt(spark, sf)).select("seq_id", "pos", "pitch", "lift")


@query("sq25_chord_serialisation", f"""WITH {CHORDS},
    fl AS (SELECT seq_id, pos, 1 AS slot, {FIELDS} FROM chords UNION ALL
           SELECT seq_id, pos, 0, 'chord', '.', '.', '.', '.', '.' FROM chords WHERE member > 1)
    SELECT seq_id, pos, slot, rhythm, pitch, position FROM fl""")
def chord_serialisation(spark, sf):
    flat = C.flatten_chords(C.group_chords(B.evt(spark, sf)))
    return flat.select("seq_id", "pos", "slot", "rhythm", "pitch", "position")


@query("sl08_chord_text_order", f"""WITH {CHORDS}, t AS (SELECT *, concat_ws(' ', {FIELDS}) AS txt FROM chords)
    SELECT seq_id, chord_id, txt, CAST(row_number() OVER (PARTITION BY seq_id, chord_id ORDER BY txt DESC, member) AS INTEGER)
    AS rank FROM t""")
def chord_text_order(spark, sf):
    ranked = C.sort_within_chords(C.group_chords(B.evt(spark, sf)))
    return ranked.select("seq_id", "chord_id", T.token_text().alias("txt"), "rank")


@query("sl10_canonical_sort_key", f"WITH {KEYED} SELECT seq_id, pos, sort_key FROM keyed")
def canonical_sort_key(spark, sf):
    return C.with_canonical_key(C.group_chords(B.evt(spark, sf))).select("seq_id", "pos", "sort_key")


@query("so09_chord_duplicates", f"""WITH {CHORDS}, f AS (SELECT *,
      first_value(rhythm) OVER (PARTITION BY seq_id, chord_id ORDER BY member) AS head,
      row_number() OVER (PARTITION BY seq_id, chord_id, pitch, position ORDER BY member) AS r FROM chords)
    SELECT seq_id, pos, chord_id, pitch, position FROM f WHERE r = 1 OR NOT regexp_matches(head, '^(note|rest)')""")
def chord_duplicates(spark, sf):
    return C.drop_repeated_pitches(C.group_chords(B.evt(spark, sf))).select(
        "seq_id", "pos", "chord_id", "pitch", "position"
    )


@query("ag11_max_ledger_lines",
       f"WITH {LEDGER} SELECT seq_id, coalesce(max(ledger), 0) AS max_ledger FROM ledger GROUP BY seq_id")
def max_ledger_lines(spark, sf):
    return C.max_ledger_lines(B.evt(spark, sf))


@query("ag12_measure_duration", f"WITH {TICKS} SELECT seq_id, measure, ticks FROM durs")
def measure_duration(spark, sf):
    return C.measure_durations(C.group_measures(C.group_chords(B.evt(spark, sf))))


@query("ag13_typical_duration", f"WITH {TICKS} SELECT seq_id, typical FROM typ")
def typical_duration(spark, sf):
    return C.typical_durations(C.measure_durations(C.group_measures(C.group_chords(B.evt(spark, sf)))))


REPAIRED = TICKS + f""",
rep AS (SELECT tk.* EXCLUDE (rhythm), CASE WHEN d.ticks < typical THEN {no_tuplet_sql('rhythm')} ELSE rhythm END AS rhythm
        FROM tk JOIN durs d USING (seq_id, measure) JOIN typ USING (seq_id))"""


@query("sq05_tuplet_repair", f"WITH {REPAIRED} SELECT seq_id, pos, measure, rhythm FROM rep")
def tuplet_repair(spark, sf):
    measured = C.group_measures(C.group_chords(B.evt(spark, sf)))
    return C.repair_tuplets(measured).select("seq_id", "pos", "measure", "rhythm")


@query("sq08_annotation_hoisting", f"WITH {HOISTED} SELECT seq_id, chord_id, rank, {FIELDS} FROM hoisted")
def annotation_hoisting(spark, sf):
    return C.hoist_annotations(C.group_chords(B.evt(spark, sf))).select(
        "seq_id", "chord_id", "rank", *V.TOKEN_FIELDS
    )


@query("sc02_token_line_sink", f"""WITH {HOISTED} SELECT seq_id, chord_id,
    string_agg(concat_ws(' ', {FIELDS}), '&' ORDER BY rank) AS line FROM hoisted GROUP BY 1, 2""")
def token_line_sink(spark, sf):
    """Written as a bundle and read back."""
    folder = B.work_folder(spark, "token-lines")
    token_lines.write_lines(C.chord_lines(C.group_chords(B.evt(spark, sf))), folder, "seq_id")
    lines = token_lines.read_bundle(spark, folder)
    return lines.select(F.col("score").cast("long").alias("seq_id"), F.col("line_no").cast("int").alias("chord_id"), "line")


GATE = """min(CASE WHEN chord_id < 5 AND starts_with(rhythm, 'clef') AND position = 'lower' THEN pos END)
    OVER (PARTITION BY seq_id)"""


@query("sq10_lower_staff_gate", f"""WITH {CHORDS}, g AS (SELECT *, {GATE} AS gate FROM chords)
    SELECT seq_id, pos, CASE WHEN pos >= gate THEN position WHEN position = 'lower' THEN 'upper' ELSE position END AS position
    FROM g""")
def lower_staff_gate(spark, sf):
    return C.gate_lower_staff(C.group_chords(B.evt(spark, sf))).select("seq_id", "pos", "position")


@query("sq22_clean_up", f"""WITH {REPAIRED},
    g AS (SELECT *, {GATE} AS gate FROM rep),
    g2 AS (SELECT * REPLACE (CASE WHEN pos >= gate THEN position WHEN position = 'lower' THEN 'upper' ELSE position END AS position) FROM g),
    f AS (SELECT *, first_value(rhythm) OVER (PARTITION BY seq_id, chord_id ORDER BY member) AS head,
      row_number() OVER (PARTITION BY seq_id, chord_id, pitch, position ORDER BY member) AS r FROM g2),
    d AS (SELECT *, CASE WHEN starts_with(rhythm, 'clef') AND position = 'upper' THEN 'cu'
      WHEN starts_with(rhythm, 'clef') THEN 'cl' WHEN starts_with(rhythm, 'key') THEN 'k'
      WHEN starts_with(rhythm, 'time') THEN 't' END AS cls FROM f WHERE r = 1 OR NOT regexp_matches(head, '^(note|rest)')),
    lg AS (SELECT *, lag(rhythm) OVER (PARTITION BY seq_id, cls ORDER BY pos) AS prev FROM d)
    SELECT seq_id, pos, chord_id, rhythm, pitch, position FROM lg WHERE cls IS NULL OR prev IS DISTINCT FROM rhythm""")
def clean_up(spark, sf):
    return C.clean_up(B.evt(spark, sf)).select("seq_id", "pos", "chord_id", "rhythm", "pitch", "position")
