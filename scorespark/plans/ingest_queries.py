"""Ingest queries: score texts that Spark writes from the tables, read back by the format scans; producers; streams."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import tokens as T
from ..functions import vocabulary as V
from ..operators import alignment
from ..operators import analytics as A
from ..operators import producers, table_functions
from ..operators import scoring as S
from ..operators import windows as N
from ..sources import archives, kern, musicxml, semantic
from ..streaming import incremental
from . import bindings as B
from .registry import query
from .scoring_queries import EVENTS, TURN_EVENTS, TURNS, alignment_events, turn_scores

# ---- texts derived from the events ---------------------------------------------------------------------------------

_LETTER = "CDEFGAB"


def kern_cell():
    """One kern note, rest or null token per event."""
    k, e = F.col("k"), F.col("event_id")
    base = B.pick(["4", "8", "16", "2.", "12", ""], k % 6)
    letter = B.pick(list("cdefgab"), k % 7)
    size = (F.floor(k / 30) % 3 + 1).cast("int")
    name = F.when(e % 3 == 0, F.upper(F.repeat(letter, size))).otherwise(F.repeat(letter, size))
    accidental = B.pick(["", "#", "-", "n"], e % 4)
    suffix = B.pick(["", "'", "^L", ";", "[", "]J", "(", ")"], e % 8)
    grace = F.when(k % 11 == 0, F.lit("q")).otherwise(F.lit(""))
    return F.when(k % 9 == 0, F.concat(base, F.lit("r"))).otherwise(F.concat(base, grace, name, accidental, suffix))


def kern_texts(spark, sf):
    """Two-spine kern: a line per event, the event on one spine by its user; four documents per sequence."""
    t = B.evt(spark, sf)
    cell, other = kern_cell(), F.lit(".")
    sign = F.when(F.col("rhythm").startswith("keySignature"), B.pick(["*k[]", "*k[b-]", "*k[f#c#]"], F.col("k") % 3)).when(
        F.col("rhythm").startswith("clef"), B.pick(["*clefG2", "*clefF4", "*clefC3"], F.col("k") % 3)
    ).when(F.col("rhythm").startswith("timeSignature"), B.pick(["*M4/4", "*M3/8"], F.col("k") % 2))
    bar = F.when(T.is_measure_end(F.col("rhythm")), B.pick(["=", "==", "=:|!", "=!|:", "=||", "=:|!|:"], F.col("k") % 6))
    low = F.col("user_id") % 2 == 0
    data = F.concat(F.when(low, cell).otherwise(other), F.lit("\t"), F.when(low, other).otherwise(cell))
    split = F.concat_ws("\n", F.lit("*^\t*"), F.concat_ws("\t", cell, F.lit("4r"), F.lit(".")), F.lit("*v\t*v\t*"))
    line = (
        F.when(sign.isNotNull(), F.concat_ws("\t", sign, sign)).when(bar.isNotNull(), F.concat_ws("\t", bar, bar)).when(F.col("k") % 13 == 0, split).otherwise(data)
    )
    rows = t.select("seq_id", F.expr("pos div 16").alias("doc"), "pos", line.alias("line")).repartition("seq_id")  # serves both steps
    docs = rows.groupBy("seq_id", "doc").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line"))).getField("line"), "\n").alias("body"))
    head = "**kern\t**kern\n*clefF4\t*clefG2\n*k[]\t*k[]\n*M4/4\t*M4/4\n"
    whole = docs.select("seq_id", "doc", F.concat(F.lit(head), "body", F.lit("\n*-\t*-")).alias("text"))
    return whole.groupBy(F.col("seq_id").alias("score")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("doc", "text"))).getField("text"), "\n").alias("text"))


def stored(spark, texts):
    """Score texts through a bundle on disk and back."""
    folder = B.work_folder(spark, "scores")
    kern.write_bundle(texts, folder)
    return kern.read_bundle(spark, folder).where("error IS NULL").select(F.col("score").cast("long").alias("score"), "text")


@query("sc03_kern_ingest")
def kern_ingest(spark, sf):
    tokens = kern.kern_tokens(stored(spark, kern_texts(spark, sf)))
    return tokens.groupBy("score", "part", *V.TOKEN_FIELDS).agg(F.count("*").alias("n"))


@query("sc03_kern_merged")
def kern_merged(spark, sf):
    """Both staffs as one sequence of upper and lower tokens."""
    tokens = kern.kern_tokens(stored(spark, kern_texts(spark, sf)), merged=True)
    return tokens.groupBy("score", *V.TOKEN_FIELDS).agg(F.count("*").alias("n"))


@query("sc03_kern_note_count", f"""WITH {B.EVT}, r AS (SELECT seq_id, CASE WHEN starts_with(rhythm, 'key') OR starts_with(rhythm, 'clef') OR starts_with(rhythm, 'time') OR contains(rhythm, 'barline') OR contains(rhythm, 'repeat') THEN 0
      WHEN k % 13 = 0 THEN 2 ELSE 1 END AS notes FROM evt) SELECT seq_id AS score, CAST(sum(notes) AS BIGINT) AS notes FROM r GROUP BY 1""")
def kern_note_count(spark, sf):
    """Conservation: every sounding cell of the text gives one note or rest."""
    tokens = kern.kern_tokens(stored(spark, kern_texts(spark, sf)))
    return tokens.groupBy("score").agg(F.count_if(T.is_sounding(F.col("rhythm"))).alias("notes"))


# Every sounding cell of the kern text as SQL states it from the event columns: fields and place.
_KERN_NOTES = B.EVT + """,
cells AS (SELECT *, user_id % 2 AS odd, ['4', '8', '16', '2.', '12', ''][k % 6 + 1] AS base, (k // 30) % 3 + 1 AS reps,
    CASE WHEN k % 13 = 0 THEN 1 WHEN user_id % 2 = 0 THEN 1 ELSE 0 END AS part FROM evt
  WHERE NOT (starts_with(rhythm, 'key') OR starts_with(rhythm, 'clef') OR starts_with(rhythm, 'time') OR contains(rhythm, 'barline') OR contains(rhythm, 'repeat'))),
notes AS (SELECT seq_id AS score, part, pos, 0 AS member, k % 9 = 0 AS rests,
    CASE WHEN k % 9 = 0 THEN 'rest_' ELSE 'note_' END || CASE WHEN base = '' THEN '4' ELSE replace(base, '.', '') END
      || CASE WHEN k % 9 <> 0 AND k % 11 = 0 THEN 'G' ELSE '' END || CASE WHEN base = '2.' THEN '.' ELSE '' END AS rhythm,
    ['C', 'D', 'E', 'F', 'G', 'A', 'B'][(k + 0) % 7 + 1] || CASE WHEN event_id % 3 = 0 THEN 4 - reps ELSE reps + 3 END AS pitch,
    ['_', '#', 'b', '_'][event_id % 4 + 1] AS lift, ['_', 'staccato', 'accent', 'fermata', '_', '_', '_', '_'][event_id % 8 + 1] AS articulation,
    ['_', '_', '_', '_', 'slurStart', 'slurStop', 'slurStart', 'slurStop'][event_id % 8 + 1] AS slur FROM cells
  UNION ALL SELECT seq_id, 1, pos, 1, true, 'rest_4', '_', '_', '_', '_' FROM cells WHERE k % 13 = 0),
placed AS (SELECT score, CAST(part AS INTEGER) AS part, CAST(row_number() OVER (PARTITION BY score, part ORDER BY pos, member) - 1 AS INTEGER) AS n, rhythm,
    CASE WHEN rests THEN '_' ELSE pitch END AS pitch, CASE WHEN rests THEN '_' ELSE lift END AS lift,
    CASE WHEN rests THEN '_' ELSE articulation END AS articulation, CASE WHEN rests THEN '_' ELSE slur END AS slur FROM notes)"""


@query("sc03_kern_notes", f"WITH {_KERN_NOTES} SELECT score, part, n, rhythm, pitch, lift, articulation, slur FROM placed")
def kern_notes(spark, sf):
    """Notes and rests of every staff in order, with all their fields."""
    tokens = kern.kern_tokens(stored(spark, kern_texts(spark, sf))).where(T.is_sounding(F.col("rhythm")))
    n = F.row_number().over(N.ordered("score", "part", by="ord")) - 1
    return tokens.select("score", "part", n.alias("n"), "rhythm", "pitch", "lift", "articulation", "slur")


def musicxml_texts(spark, sf):
    """One part per sequence, a measure per eight events, some notes in chords, on the second staff or after a backup."""
    t = B.evt(spark, sf)
    k, e = F.col("k"), F.col("event_id")
    kind = B.pick(["quarter", "eighth", "16th", "half"], k % 4)
    length = B.pick(["4", "2", "1", "8"], k % 4)
    staff = (e % 2 + 1).cast("string")
    pitch = F.concat(F.lit("<pitch><step>"), B.pick(list(_LETTER), k % 7), F.lit("</step>"), F.when(e % 5 == 0, F.lit("<alter>1</alter>")).otherwise(F.lit("")), F.lit("<octave>"), (F.floor(k / 20) + 2).cast("string"), F.lit("</octave></pitch>"))
    body = F.when(k % 9 == 0, F.lit("<rest/>")).otherwise(pitch)
    chord = F.when((e % 7 == 1) & (F.col("pos") % 8 > 0), F.lit("<chord/>")).otherwise(F.lit(""))
    mark = B.pick(["", "<notations><articulations><staccato/></articulations></notations>", "<notations><slur type='start'/></notations>", "<notations><fermata/></notations>"], e % 4)
    note = F.concat(F.lit("<note>"), chord, body, F.lit("<duration>"), length, F.lit("</duration><type>"), kind, F.lit("</type><staff>"), staff, F.lit("</staff>"), mark, F.lit("</note>"))
    back = F.when(k % 10 == 3, F.concat(note, F.lit("<backup><duration>"), length, F.lit("</duration></backup>"))).otherwise(note)
    first = "<attributes><divisions>4</divisions><key><fifths>2</fifths></key><time><beat-type>4</beat-type></time><clef number='1'><sign>G</sign><line>2</line></clef><clef number='2'><sign>F</sign><line>4</line></clef></attributes>"
    element = (
        F.when(F.col("pos") == 0, F.lit(first)).when(T.is_measure_end(F.col("rhythm")), F.lit("<barline><bar-style>light-light</bar-style></barline>")).otherwise(back)
    )
    rows = t.select("seq_id", F.expr("pos div 8").alias("measure"), "pos", element.alias("x"))
    measures = rows.groupBy("seq_id", "measure").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "x"))).getField("x"), "").alias("x"))
    parts = measures.select("seq_id", "measure", F.concat(F.lit("<measure>"), "x", F.lit("</measure>")).alias("x"))
    body = F.array_join(F.array_sort(F.collect_list(F.struct("measure", "x"))).getField("x"), "")
    return parts.groupBy(F.col("seq_id").alias("score")).agg(F.concat(F.lit("<score-partwise><part id='P1'>"), body, F.lit("</part></score-partwise>")).alias("text"))


@query("sc04_musicxml_ingest")
def musicxml_ingest(spark, sf):
    tokens = musicxml.musicxml_tokens(stored(spark, musicxml_texts(spark, sf)))
    return tokens.groupBy("score", "part", "measure", *V.TOKEN_FIELDS).agg(F.count("*").alias("n"))


@query("sc04_musicxml_notes", f"""WITH {B.EVT}, x AS (SELECT seq_id AS score, CAST(pos // 8 AS INTEGER) AS measure, k % 9 = 0 AS rests,
      ['4', '8', '16', '2'][k % 4 + 1] AS base, ['C', 'D', 'E', 'F', 'G', 'A', 'B'][k % 7 + 1] || ((k // 20) + 2) AS pitch, CASE WHEN event_id % 5 = 0 THEN '#' ELSE '_' END AS lift,
      ['_', 'staccato', '_', 'fermata'][event_id % 4 + 1] AS articulation, ['_', '_', 'slurStart', '_'][event_id % 4 + 1] AS slur, ['upper', 'lower'][event_id % 2 + 1] AS position
    FROM evt WHERE pos > 0 AND NOT (contains(rhythm, 'barline') OR contains(rhythm, 'repeat')))
    SELECT score, measure, CASE WHEN rests THEN 'rest_' ELSE 'note_' END || base AS rhythm, CASE WHEN rests THEN '_' ELSE pitch END AS pitch,
      CASE WHEN rests THEN '_' ELSE lift END AS lift, articulation, slur, position, count(*) AS n FROM x GROUP BY ALL""")
def musicxml_notes(spark, sf):
    """Notes and rests of every measure with all their fields."""
    tokens = musicxml.musicxml_tokens(stored(spark, musicxml_texts(spark, sf))).where(T.is_sounding(F.col("rhythm")))
    return tokens.groupBy("score", "measure", *V.TOKEN_FIELDS).agg(F.count("*").alias("n"))


@query("sc04_musicxml_note_count", f"""WITH {B.EVT} SELECT seq_id AS score, count(*) FILTER (pos > 0 AND NOT (contains(rhythm, 'barline') OR contains(rhythm, 'repeat'))) AS notes FROM evt GROUP BY 1""")
def musicxml_note_count(spark, sf):
    tokens = musicxml.musicxml_tokens(stored(spark, musicxml_texts(spark, sf)))
    return tokens.groupBy("score").agg(F.count_if(T.is_sounding(F.col("rhythm"))).alias("notes"))


def semantic_word():
    k, e, r = F.col("k"), F.col("event_id"), F.col("rhythm")
    length = B.pick(["quarter", "eighth", "half.", "sixteenth", "whole", "quarter_fermata"], k % 6)
    note = F.concat(F.when(k % 11 == 0, F.lit("gracenote-")).otherwise(F.lit("note-")), B.pick(list(_LETTER), k % 7), B.pick(["", "b", "#", ""], e % 4), (F.floor(k / 20) + 2).cast("string"), F.lit("_"), length)
    return (
        F.when(T.is_measure_end(r), F.lit("barline")).when(r == "chord", F.lit("tie")).when(r.startswith("clef"), F.replace(r, F.lit("_"), F.lit("-")))
        .when(r.startswith("key"), F.concat(F.lit("keySignature-"), B.pick(list(V.KEY_FIFTHS), k % 15))).when(r.startswith("time"), B.pick(["timeSignature-C", "timeSignature-C/", "timeSignature-6/8"], k % 3))
        .when(r.startswith("rest"), F.when(k % 2 == 0, F.concat(F.lit("rest-"), length)).otherwise(F.concat(F.lit("multirest-"), (k % 14 + 1).cast("string")))).otherwise(note)
    )


_SEMANTIC = f"""w AS (SELECT *, ['quarter','eighth','half.','sixteenth','whole','quarter_fermata'][k % 6 + 1] AS ln FROM evt),
sw AS (SELECT *, CASE WHEN contains(rhythm, 'barline') OR contains(rhythm, 'repeat') THEN 'barline' WHEN rhythm = 'chord' THEN 'tie' WHEN starts_with(rhythm, 'clef') THEN replace(rhythm, '_', '-')
  WHEN starts_with(rhythm, 'key') THEN 'keySignature-' || [{", ".join(repr(x) for x in V.KEY_FIFTHS)}][k % 15 + 1] WHEN starts_with(rhythm, 'time') THEN ['timeSignature-C','timeSignature-C/','timeSignature-6/8'][k % 3 + 1]
  WHEN starts_with(rhythm, 'rest') THEN CASE WHEN k % 2 = 0 THEN 'rest-' || ln ELSE 'multirest-' || (k % 14 + 1) END
  ELSE CASE WHEN k % 11 = 0 THEN 'gracenote-' ELSE 'note-' END || substr('CDEFGAB', k % 7 + 1, 1) || ['','b','#',''][event_id % 4 + 1] || (k // 20 + 2) || '_' || ln END AS word FROM w)"""


def semantic_texts(spark, sf):
    words = B.evt(spark, sf).select("seq_id", "pos", semantic_word().alias("word"))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("pos", "word"))).getField("word"), " ")
    return words.groupBy(F.col("seq_id").alias("score")).agg(text.alias("text"))


_NAMES = "CASE regexp_replace(replace(replace(ln, '_fermata', ''), '.', ''), '', '') WHEN 'whole' THEN '1' WHEN 'half' THEN '2' WHEN 'quarter' THEN '4' WHEN 'eighth' THEN '8' ELSE '16' END"


SEMANTIC_FIELDS = f"""CASE WHEN regexp_matches(word, '^(grace)?note-') THEN 'note_' || {_NAMES} || CASE WHEN starts_with(word, 'grace') THEN 'G' ELSE '' END || CASE WHEN contains(ln, '.') THEN '.' ELSE '' END
      WHEN starts_with(word, 'rest-') THEN 'rest_' || {_NAMES} || CASE WHEN contains(ln, '.') THEN '.' ELSE '' END
      WHEN starts_with(word, 'multirest') THEN CASE WHEN k % 14 = 0 THEN 'rest_0' ELSE 'rest_' || least(k % 14 + 1, 10) || 'm' END
      WHEN starts_with(word, 'clef') THEN replace(word, '-', '_') WHEN starts_with(word, 'key') THEN 'keySignature_' || (k % 15 - 7)
      WHEN starts_with(word, 'time') THEN ['timeSignature/4','timeSignature/2','timeSignature/8'][k % 3 + 1] WHEN word = 'tie' THEN 'tieSlur' ELSE word END AS rhythm,
    CASE WHEN regexp_matches(word, '^(grace)?note-') THEN substr('CDEFGAB', k % 7 + 1, 1) || (k // 20 + 2) WHEN regexp_matches(word, '^(multi)?rest|^clef') THEN '_' ELSE '.' END AS pitch,
    CASE WHEN regexp_matches(word, '^(grace)?note-') THEN ['_','b','#','_'][event_id % 4 + 1] WHEN regexp_matches(word, '^(multi)?rest|^clef') THEN '_' ELSE '.' END AS lift,
    CASE WHEN regexp_matches(word, '^(grace)?note-|^rest-') AND contains(ln, 'fermata') THEN 'fermata' WHEN regexp_matches(word, '^(grace)?note-|^(multi)?rest|^clef') THEN '_' ELSE '.' END AS articulation"""


@query("sf31_semantic_words", f"""WITH {B.EVT}, {_SEMANTIC} SELECT seq_id, pos, word,
    {SEMANTIC_FIELDS} FROM sw""")
def semantic_words(spark, sf):
    words = B.evt(spark, sf).select("seq_id", "pos", semantic_word().alias("word"))
    return words.select("seq_id", "pos", "word", semantic.word_token(F.col("word")).alias("_t")).select("seq_id", "pos", "word", "_t.rhythm", "_t.pitch", "_t.lift", "_t.articulation")


def _zip(text: str, name: str) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("META-INF/container.xml", "<container/>")
        archive.writestr(name, text)
    return buffer.getvalue()


_TIED = f"""t0 AS (SELECT seq_id AS score, pos, {SEMANTIC_FIELDS} FROM sw),
la AS (SELECT score, max(pos) AS lp, arg_max(rhythm, pos) AS lr FROM t0 GROUP BY 1),
tt AS (SELECT * FROM t0 UNION ALL SELECT score, lp + 1, 'barline', '.', '.', '.' FROM la WHERE lr <> 'barline'),
ti AS (SELECT *, count(*) OVER (PARTITION BY score) AS n, starts_with(rhythm, 'note') AS isn FROM tt),
tm AS (SELECT score, pos AS t FROM ti WHERE rhythm = 'tieSlur' AND pos BETWEEN 1 AND n - 2),
nx AS (SELECT DISTINCT score, m FROM (SELECT tm.score, t, min(ti.pos) AS m FROM tm JOIN ti ON ti.score = tm.score AND ti.pos > t AND isn GROUP BY 1, 2) x),
pv AS (SELECT score, m, count(*) AS c FROM (SELECT tm.score, t, max(ti.pos) AS m FROM tm JOIN ti ON ti.score = tm.score AND ti.pos < t AND ti.pos >= 1 AND isn GROUP BY 1, 2) x GROUP BY 1, 2)"""


@query("sc05_semantic_ingest", f"""WITH {B.EVT}, {_SEMANTIC}, {_TIED} SELECT ti.score, CAST(pos AS INTEGER) AS pos, rhythm, pitch, lift, articulation,
    CASE WHEN isn THEN CASE WHEN pv.c IS NULL THEN CASE WHEN nx.m IS NULL THEN '_' ELSE 'slurStop' END WHEN pv.c = 1 AND nx.m IS NOT NULL THEN 'slurStart_slurStop' ELSE 'slurStart' END
      WHEN regexp_matches(rhythm, '^(rest|clef)') THEN '_' ELSE '.' END AS slur, CASE WHEN regexp_matches(rhythm, '^(note|rest|clef)') THEN 'upper' ELSE '.' END AS position
    FROM ti LEFT JOIN nx ON nx.score = ti.score AND nx.m = pos LEFT JOIN pv ON pv.score = ti.score AND pv.m = pos WHERE rhythm <> 'tieSlur' OR pos >= n - 2""")
def semantic_ingest(spark, sf):
    return semantic.semantic_tokens(semantic_texts(spark, sf)).select("score", "pos", *V.TOKEN_FIELDS)


@F.arrow_udf(TY.BinaryType())
def _zipped(text: pa.Array, folder: pa.Array) -> pa.Array:
    return pa.array((_zip(t.as_py(), "inner/score.xml" if f.as_py() else "score.xml") for t, f in zip(text, folder)), pa.binary())


@query("sc06_archive_scan", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '<container/>' WHEN page_id % 7 = 3 THEN NULL ELSE html END AS text, page_id % 2 = 1 AND page_id % 7 = 3 AS failed FROM pages""")
def archive_scan(spark, sf):
    """Pages packed as archives: without a top-level score the first .xml anywhere counts; every seventh is damaged."""
    p = B.table(spark, sf, "pages").select("page_id", "html")
    packed = p.select("page_id", _zipped("html", F.col("page_id") % 2 == 0).alias("content"))
    hurt = (F.col("page_id") % 7 == 3) & (F.col("page_id") % 2 == 1)
    read = packed.withColumn("content", F.when(hurt, F.lit(b"broken")).otherwise(F.col("content")))
    return read.select("page_id", archives.unpack_score("content").alias("_s")).select("page_id", "_s.text", F.col("_s.error").isNotNull().alias("failed"))


# ---- scalar decoding -----------------------------------------------------------------------------------------------


@query("sf07_clef_defaults", f"""WITH {B.EVT}, c AS (SELECT DISTINCT ['*clefF','*clefG','*clefC','*clefG2','*clefF3 x','*clefC1'][k % 6 + 1] AS cell FROM evt)
    SELECT cell, CASE cell WHEN '*clefF' THEN 'clef_F4' WHEN '*clefG' THEN 'clef_G2' WHEN '*clefC' THEN 'clef_C3' WHEN '*clefG2' THEN 'clef_G2' WHEN '*clefF3 x' THEN 'clef_F3' ELSE 'clef_C1' END AS clef FROM c""")
def clef_defaults(spark, sf):
    cells = B.evt(spark, sf).select(B.pick(["*clefF", "*clefG", "*clefC", "*clefG2", "*clefF3 x", "*clefC1"], F.col("k") % 6).alias("cell")).distinct()
    return cells.select("cell", kern.clef_token(F.col("cell")).alias("clef"))


@query("sf10_kern_notes", f"""WITH {B.EVT}, c AS (SELECT *, ['4','8','16','2.','12',''][k % 6 + 1] AS b FROM evt)
    SELECT event_id, CASE WHEN k % 9 = 0 THEN 'rest_' ELSE 'note_' END || CASE WHEN b = '' THEN '4' ELSE replace(b, '.', '') END || CASE WHEN k % 9 <> 0 AND k % 11 = 0 THEN 'G' ELSE '' END || CASE WHEN b = '2.' THEN '.' ELSE '' END AS rhythm,
      CASE WHEN k % 9 = 0 THEN '_' ELSE substr('CDEFGAB', k % 7 + 1, 1) || CASE WHEN event_id % 3 = 0 THEN 4 - ((k // 30) % 3 + 1) ELSE 3 + (k // 30) % 3 + 1 END END AS pitch,
      CASE WHEN k % 9 = 0 THEN '_' ELSE ['_','#','b','N'][event_id % 4 + 1] END AS lift FROM c""")
def kern_notes(spark, sf):
    cells = B.evt(spark, sf).select("event_id", kern.note_token(kern_cell(), F.lit("4")).alias("_t"))
    return cells.select("event_id", "_t.rhythm", "_t.pitch", "_t.lift")


@query("sf11_kern_pitch", f"""WITH {B.EVT}, c AS (SELECT DISTINCT repeat(CASE WHEN event_id % 2 = 0 THEN lower(substr('CDEFGAB', k % 7 + 1, 1)) ELSE substr('CDEFGAB', k % 7 + 1, 1) END, (k // 30) % 3 + 1) AS name FROM evt)
    SELECT name, upper(left(name, 1)) || CASE WHEN name = lower(name) THEN 3 + length(name) ELSE 4 - length(name) END AS pitch FROM c""")
def kern_pitch(spark, sf):
    letter = B.pick(list(_LETTER), F.col("k") % 7)
    name = F.repeat(F.when(F.col("event_id") % 2 == 0, F.lower(letter)).otherwise(letter), (F.floor(F.col("k") / 30) % 3 + 1).cast("int"))
    return B.evt(spark, sf).select(name.alias("name")).distinct().select("name", kern.pitch_name(F.col("name")).alias("pitch"))


@query("sf12_kern_marks", f"""WITH {B.EVT}, c AS (SELECT event_id, [c FOR c IN string_split(['''L', '^(', ';)J', '[:', 't]', 'Sm', 'x', ''][event_id % 8 + 1] || ['''', '(', ''][k % 3 + 1], '')] AS s FROM evt),
    m AS (SELECT event_id, [CASE c WHEN ':' THEN 'arpeggiate' WHEN '''' THEN 'staccato' WHEN 't' THEN 'trill' WHEN 'm' THEN 'mordent' WHEN 'S' THEN 'turn' WHEN '^' THEN 'accent' ELSE 'fermata' END FOR c IN s IF c IN (':', '''', 't', 'm', 'S', '^', ';')] AS a,
      [CASE WHEN c IN ('[', '(') THEN 'slurStart' ELSE 'slurStop' END FOR c IN s IF c IN ('[', ']', '(', ')')] AS l FROM c)
    SELECT event_id, CASE WHEN len(a) = 0 THEN '_' ELSE array_to_string(a, '_') END AS articulation, CASE WHEN len(l) = 0 THEN '_' ELSE array_to_string(l, '_') END AS slur FROM m""")
def kern_marks(spark, sf):
    suffix = F.concat(B.pick(["'L", "^(", ";)J", "[:", "t]", "Sm", "x", ""], F.col("event_id") % 8), B.pick(["'", "(", ""], F.col("k") % 3))
    rows = B.evt(spark, sf).select("event_id", suffix.alias("s"))
    return rows.select("event_id", kern.marks(F.col("s"), kern.ARTICULATIONS).alias("articulation"), kern.marks(F.col("s"), kern.SLURS).alias("slur"))


@query("sf13_kern_signatures", f"""WITH {B.EVT}, c AS (SELECT event_id, ['*k[]','*k[b-]','*k[b-e-a-]','*k[f#c#]','*kcancel','*k[x]'][k % 6 + 1] AS key, ['*M4/4','*M3/8','*M6/16'][k % 3 + 1] AS tim, ['=','==','=-','=:|!|:','=|!','=?'][k % 6 + 1] AS bar FROM evt)
    SELECT event_id, 'keySignature_' || CASE key WHEN '*k[]' THEN 0 WHEN '*k[b-]' THEN -1 WHEN '*k[b-e-a-]' THEN -3 WHEN '*k[f#c#]' THEN 2 WHEN '*kcancel' THEN 0 END AS key, 'timeSignature/' || split_part(tim, '/', 2) AS time,
      CASE bar WHEN '=' THEN 'barline' WHEN '==' THEN 'bolddoublebarline' WHEN '=-' THEN '' WHEN '=:|!|:' THEN 'repeatEndStart' WHEN '=|!' THEN 'barline' END AS bar FROM c""")
def kern_signatures(spark, sf):
    k = F.col("k")
    key = B.pick(["*k[]", "*k[b-]", "*k[b-e-a-]", "*k[f#c#]", "*kcancel", "*k[x]"], k % 6)
    rows = B.evt(spark, sf).select("event_id", key.alias("key"), B.pick(["*M4/4", "*M3/8", "*M6/16"], k % 3).alias("time"), B.pick(["=", "==", "=-", "=:|!|:", "=|!", "=?"], k % 6).alias("bar"))
    return rows.select("event_id", kern.key_token(F.col("key")).alias("key"), kern.time_token(F.col("time")).alias("time"), kern.bar_token(F.col("bar")).alias("bar"))


@query("sf14_written_lift", f"""WITH {B.EVT}, c AS (SELECT event_id, ['sharp','flat','natural','double-sharp',NULL,NULL,NULL][k % 7 + 1] AS acc, CASE WHEN event_id % 7 < 6 THEN event_id % 7 - 3 END AS alt FROM evt)
    SELECT event_id, CASE WHEN acc IS NOT NULL THEN CASE acc WHEN 'sharp' THEN '#' WHEN 'flat' THEN 'b' WHEN 'natural' THEN 'N' ELSE '_' END WHEN alt IS NULL THEN '_' WHEN alt < -1 THEN 'bb' WHEN alt = -1 THEN 'b' WHEN alt = 1 THEN '#' WHEN alt > 1 THEN '##' ELSE 'N' END AS lift FROM c""")
def written_lift(spark, sf):
    written = F.nullif(B.pick(["sharp", "flat", "natural", "double-sharp", "", "", ""], F.col("k") % 7), F.lit(""))
    alter = F.when(F.col("event_id") % 7 < 6, (F.col("event_id") % 7 - 3).cast("string"))
    rows = B.evt(spark, sf).select("event_id", written.alias("acc"), alter.alias("alt"))
    return rows.select("event_id", musicxml.lift(F.col("acc"), F.col("alt")).alias("lift"))


@query("sf29_bar_line_tokens", f"""WITH {B.EVT}, c AS (SELECT event_id, ['light-heavy','light-light','','heavy'][k % 4 + 1] AS st, ['','forward','backward',''][event_id % 4 + 1] AS dir, ['','start','stop','discontinue'][k % 3 + 1] AS en FROM evt)
    SELECT event_id, concat_ws(' ', CASE WHEN dir = 'forward' THEN 'repeatStart' WHEN dir = 'backward' THEN 'repeatEnd' WHEN contains(st, 'heavy') THEN 'bolddoublebarline' WHEN contains(st, 'light') THEN 'doublebarline' END,
      CASE en WHEN 'stop' THEN 'voltaStop' WHEN 'discontinue' THEN 'voltaDiscontinue' WHEN 'start' THEN 'voltaStart' END) AS tokens FROM c""")
def bar_line_tokens(spark, sf):
    k = F.col("k")
    rows = B.evt(spark, sf).select(
        "event_id", B.pick(["light-heavy", "light-light", "", "heavy"], k % 4).alias("st"), B.pick(["", "forward", "backward", ""], F.col("event_id") % 4).alias("dir"), B.pick(["", "start", "stop", "discontinue"], k % 3).alias("en")
    )
    return rows.select("event_id", F.array_join(musicxml.bar_line_tokens(F.col("st"), F.col("dir"), F.col("en")), " ").alias("tokens"))


# ---- producers -----------------------------------------------------------------------------------------------------


@producers.register("underscore")
def _underscore(text: str) -> str:
    if "." not in text:
        raise ValueError("no sentence")
    return text.replace(" ", "_")


@query("ud01_producer_run", f"""WITH {B.TURN} SELECT sample_id, 'underscore' AS tool, CASE WHEN contains(expected_text, '.') THEN replace(expected_text, ' ', '_') END AS output,
    CASE WHEN expected_text IS NULL THEN 'no input' WHEN NOT contains(expected_text, '.') THEN 'ValueError: no sentence' END AS error FROM turn_pairs""")
def producer_run(spark, sf):
    """UD1 and UD3: a registered function over all samples, errors as rows, a time limit per row."""
    return producers.run(B.turns(spark, sf), "underscore", seconds=60.0)


@producers.register_batch("exclaim")
def _exclaim(texts: list[str]) -> list[str]:
    if any("." not in t for t in texts):
        raise ValueError("a text without a sentence")
    return [t.replace(".", "!") for t in texts]


@query("ud01_batch_producer", f"""WITH {B.TURN} SELECT sample_id, 'exclaim' AS tool, CASE WHEN contains(expected_text, '.') THEN replace(expected_text, '.', '!') END AS output,
    CASE WHEN expected_text IS NULL THEN 'no input' WHEN NOT contains(expected_text, '.') THEN 'ValueError: a text without a sentence' END AS error FROM turn_pairs""")
def batch_producer(spark, sf):
    """Ten texts a call; a batch with a bad text is run again one by one."""
    return producers.run(B.turns(spark, sf), "exclaim", seconds=60.0)


def aligned_turns(spark, sf):
    """Matched blocks of turns and outputs, by joins and windows, expanded by a table function in SQL."""
    t = alignment.cut(turn_scores(spark, sf).where("actual_text is not null").select("sample_id", "e", "a"))
    blocks = alignment.matching_blocks(t, ["sample_id"], "e", "a")
    ends = t.select("sample_id", F.size("e").alias("i"), F.size("a").alias("j"), F.lit(0).alias("size"))
    table_functions.register(spark)
    rows = blocks.unionByName(ends).withColumnRenamed("sample_id", "pair").select("pair", "i", "j", "size")
    return spark.sql("SELECT * FROM aligned_events(TABLE({blocks}) PARTITION BY pair ORDER BY (i, j))", blocks=rows)


@query("ud05_aligned_rows", f"WITH RECURSIVE {TURN_EVENTS} SELECT sample_id AS pair, event_no, event_type, CAST(ei AS INTEGER) AS i, CAST(ai AS INTEGER) AS j FROM evn")
def aligned_rows(spark, sf):
    return aligned_turns(spark, sf)


@query("ud05_alignment_table_function", f"""WITH {TURNS} SELECT CAST(sum(el) AS BIGINT) AS expected_tokens, CAST(sum(alen) AS BIGINT) AS actual_tokens FROM turn_scores WHERE actual_text IS NOT NULL""")
def alignment_table_function(spark, sf):
    """One pair to many rows: match, substitute and delete rows cover the truth, match, substitute and insert the output."""
    kind = F.col("event_type")
    return aligned_turns(spark, sf).agg(F.count_if(kind != "insert").alias("expected_tokens"), F.count_if(kind != "delete").alias("actual_tokens"))


@query("sq03_event_breakdown_by_staff", f"WITH RECURSIVE {EVENTS} SELECT staff, event_type, count(*) AS n FROM tev GROUP BY 1, 2")
def event_breakdown_by_staff(spark, sf):
    return alignment_events(spark, sf).groupBy("staff", "event_type").agg(F.count("*").alias("n"))


# ---- streams -------------------------------------------------------------------------------------------------------


@query("st01_incremental_scoring", f"""WITH {TURNS} SELECT sample_id, distance FROM turn_scores WHERE actual_text IS NOT NULL""")
def incremental_scoring(spark, sf):
    """Turns written as arriving files, scored by a file stream into a store; equals the batch result."""
    folder = B.work_folder(spark, "scoring")
    pairs = B.turns(spark, sf).where("actual_text is not null").select("sample_id", "expected_text", "actual_text")
    pairs.write.parquet(f"{folder}/in")

    def score(batch):
        e, a = B.text_words(F.col("expected_text")), B.text_words(F.col("actual_text"))
        return batch.select("sample_id", S.token_distance(e, a).alias("distance"))

    arrivals = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/in")
    incremental.score_arrivals(arrivals, score, f"{folder}/store", f"{folder}/cp")
    return incremental.read_store(spark, f"{folder}/store").select("sample_id", "distance")


@query("st02_running_counts", "SELECT 'event_type' AS field, event_type AS token, count(*) AS n FROM events GROUP BY 2 UNION ALL SELECT 'props', props, count(*) FROM events GROUP BY 2")
def running_counts(spark, sf):
    """Events arrive in several files, two a batch; the counts are those of the whole table."""
    folder = B.work_folder(spark, "counts")
    events = B.table(spark, sf, "events").select("event_type", "props", "event_id")
    events.repartition(9, F.floor(F.col("event_id") / 100)).select("event_type", "props").write.parquet(f"{folder}/in")
    arrivals = spark.readStream.schema("event_type string, props string").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    incremental.running_counts(arrivals, ["event_type", "props"], f"{folder}/out", f"{folder}/cp", compact_every=3)
    return incremental.read_counts(spark, f"{folder}/out")


@query("st03_signature_stream", f"""WITH {B.EVT}, s AS (SELECT seq_id AS score, CAST(user_id % 2 AS INTEGER) AS part, CAST(pos // 16 AS INTEGER) AS doc, pos, CASE WHEN starts_with(rhythm, 'clef') THEN 'clef' WHEN starts_with(rhythm, 'key') THEN 'key' WHEN starts_with(rhythm, 'time') THEN 'time' END AS kind, rhythm FROM evt),
    l AS (SELECT *, lag(rhythm) OVER (PARTITION BY score, part, kind ORDER BY doc, pos) AS prev FROM s WHERE kind IS NOT NULL)
    SELECT score, part, doc, pos, kind, rhythm FROM l WHERE prev IS DISTINCT FROM rhythm""")
def signature_stream(spark, sf):
    folder = B.work_folder(spark, "signatures")
    t = B.evt(spark, sf).select(
        F.col("seq_id").alias("score"), (F.col("user_id") % 2).cast("int").alias("part"), F.expr("cast(pos div 16 as int)").alias("doc"), "pos", N.signature_kind(F.col("rhythm")).alias("kind"), "rhythm"
    ).where("kind is not null")
    t.repartition(5, F.hash("doc", "score")).write.parquet(f"{folder}/in")  # documents of a score arrive in any order
    arrivals = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    incremental.carry_stream(arrivals, f"{folder}/out", f"{folder}/cp")
    return incremental.read_changes(spark, f"{folder}/out")
