"""Humdrum kern text to tokens, all in DataFrame operations.

Spines split and join, so a cell's staff depends on earlier lines. Only the few manipulator lines of a document are
folded (an array per document); every other line looks up the map in force, and its tokens are decoded as columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tokens as T
from ..functions import vocabulary as V
from ..operators import chords as C
from ..operators import windows as N
from ..session import ensure_checkpoint_dir
from . import bundles

# Kern key signatures, bar lines, slur and articulation marks, ignored signs.
_SHARPS, _FLATS = "f#c#g#d#a#e#b#", "b-e-a-d-g-c-f-"
KEYS = {f"*k[{_SHARPS[: 2 * n]}]": n for n in range(8)} | {f"*k[{_FLATS[: 2 * n]}]": -n for n in range(1, 8)} | {"*kcancel": 0}
BAR_LINES = {
    "=:|!|:": "repeatEndStart", "=": "barline", "=-": "", "==:|!": "repeatEnd", "==": "bolddoublebarline",
    "=:|!": "repeatEnd", "=!|:": "repeatStart", "=||": "doublebarline", "=|!": "barline",
}
SLURS = {"[": "slurStart", "]": "slurStop", "(": "slurStart", ")": "slurStop"}
ARTICULATIONS = {
    ":": "arpeggiate", "'": "staccato", "`": "staccatissimo", "t": "trill", "T": "trill", "m": "mordent",
    "M": "trill", "S": "turn", "$": "turn", "^": "accent", ";": "fermata",
}
LIFTS = {"-": "b", "--": "bb", "#": "#", "##": "##", "n": "N"}
CLEF_DEFAULTS = {"clef_F": "clef_F4", "clef_G": "clef_G2", "clef_C": "clef_C3"}
# Fixed patterns of the format: prefix signs, duration; then duration, pitch or rest, accidental, suffix.
_PREFIX = r"^[()\[\]<>&/\\^~yYxXiIjZN]*"
DURATION = _PREFIX + r"(\d+\.?)"
NOTE = _PREFIX + r"(\d*\.*)(?:[^a-grA-GR#]*)([a-grA-GR]+)(--|-|n|##|#)?([^#]*)"


def read_kern(spark: SparkSession, path: str) -> DataFrame:
    """(score, text), one row per file; a filter on the path prunes files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("score"), F.col("value").alias("text"))


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(score, text, error) of a text bundle: many scores a file, read by byte ranges; a filter on score prunes buckets."""
    return bundles.read(spark, path).select(F.col("entry").alias("score"), F.col("value").alias("text"), "error")


def write_bundle(texts: DataFrame, path: str, score: str = "score", **options: object) -> None:
    """Whole score texts of any format as a text bundle."""
    bundles.write(texts, path, score, F.lit(0), "text", **options)


# ---- scalar decoding -----------------------------------------------------------------------------------------------


def first_word(text: Column) -> Column:
    return F.regexp_extract(text, r"^(\S*)", 1)


def clef_token(cell: Column) -> Column:
    name = F.regexp_replace(first_word(cell), r"\*clef", "clef_")
    return F.coalesce(T.literal_map(CLEF_DEFAULTS, name), name)


def key_token(cell: Column) -> Column:
    """NULL for an unknown signature."""
    return F.concat(F.lit("keySignature_"), T.literal_map(KEYS, first_word(cell)).cast("string"))


def time_token(cell: Column) -> Column:
    lower = F.try_element_at(F.split(F.replace(first_word(cell), F.lit("*M"), F.lit("")), "/"), F.lit(2))
    return F.concat(F.lit("timeSignature/"), lower)


def bar_token(cell: Column) -> Column:
    """'' draws nothing, NULL is unknown."""
    return T.literal_map(BAR_LINES, F.regexp_extract(cell, r"^([^ ]*)", 1))


def pitch_name(letters: Column) -> Column:
    n = F.length(letters)
    octave = F.when(letters == F.lower(letters), n + 3).otherwise(F.lit(4) - n)
    return F.concat(F.upper(F.substring(letters, 1, 1)), octave.cast("string"))


def marks(suffix: Column, names: dict[str, str]) -> Column:
    """Marks named by single characters, in order of appearance; `_` when there are none."""
    found = F.filter(F.transform(F.split(suffix, ""), lambda c: T.literal_map(names, c)), lambda m: m.isNotNull())
    return F.when(suffix == "", F.lit(V.EMPTY)).when(F.size(found) > 0, F.array_join(found, "_")).otherwise(F.lit(V.EMPTY))


def note_parts(cell: Column) -> Column:
    """The groups of `NOTE` by one match, as an array; any other size when the cell is no note. A cell holds no tab."""
    return F.split(F.regexp_replace(cell, NOTE + r"[\s\S]*", "$1\t$2\t$3\t$4"), "\t")


def note_token(cell: Column, chord_duration: Column, parts: Column | None = None) -> Column:
    """One kern note or rest as token fields; rhythm is NULL when the cell is no note. `parts` are its `note_parts`, where a
    column holds them."""
    parts = note_parts(cell) if parts is None else parts
    known = F.size(parts) == 4
    part = [F.when(known, F.get(parts, i)).otherwise(F.lit("")) for i in range(4)]
    length = F.when(part[0] == "", chord_duration).otherwise(part[0])
    digits = F.replace(length, F.lit("."), F.lit("")).try_cast("int").cast("string")
    rest = part[1] == "r"
    rhythm = F.concat(
        F.when(rest, F.lit("rest_")).otherwise(F.lit("note_")), digits, F.when(cell.contains("q"), F.lit("G")).otherwise(F.lit("")),
        F.when(length.endswith("."), F.lit(".")).otherwise(F.lit("")),
    )
    suffix = F.regexp_replace(part[3], r"[qLJKkxXiIjZyY<>_]", "")

    def unless_rest(value: Column) -> Column:
        return F.when(rest, F.lit(V.EMPTY)).otherwise(value)

    return F.struct(
        F.when(known, rhythm).alias("rhythm"),
        unless_rest(pitch_name(part[1])).alias("pitch"),
        unless_rest(F.coalesce(T.literal_map(LIFTS, part[2]), F.lit(V.EMPTY))).alias("lift"),
        unless_rest(marks(suffix, ARTICULATIONS)).alias("articulation"),
        unless_rest(marks(suffix, SLURS)).alias("slur"),
    )


# ---- documents, spines, staffs -------------------------------------------------------------------------------------


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by key in as many parts as the session shuffles into. Texts grow many times over when they become tokens, so parts
    that adaptive execution joins by their compressed size would be too large to sort in memory."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def split_documents(texts: DataFrame, key: str = "score") -> DataFrame:
    """(key, doc, line_no, line): a text may hold several documents, each closed by a line of `*-` cells only."""
    lines = texts.select(key, F.posexplode(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("line_no", "line"))
    closes = F.trim("line").rlike(r"^\*-(\s*\t\s*\*-)*$").cast("int")
    doc = F.coalesce(F.sum(closes).over(N.exclusive(key, by="line_no")), F.lit(0)).cast("int")
    return lines.withColumn("doc", doc)


def _next_map(now: Column, cells: Column) -> Column:
    """Staff of each spine after a manipulator line."""
    header = F.forall(cells, lambda c: c.startswith("**"))
    split = F.flatten(F.zip_with(cells, now, lambda c, s: F.when(c == "*^", F.array(s, s)).otherwise(F.array(s))))

    def kept(c: Column, i: Column) -> Column:
        # every second `*v` of a run disappears
        others = F.filter(F.sequence(F.lit(0), i), lambda j: F.get(cells, j) != "*v")
        run = i - F.coalesce(F.array_max(others), F.lit(-1))
        return (c != "*v") | (run % 2 == 1)

    numbered = F.transform(cells, lambda c, i: F.when(kept(c, i), F.get(now, i)))
    joined = F.filter(numbered, lambda s: s.isNotNull())
    return (
        F.when(header, F.sequence(F.lit(0), F.size(cells) - 1))
        .when(F.array_contains(cells, "*^"), split)
        .otherwise(joined)
    )


def staff_cells(lines: DataFrame, key: str = "score", merged: bool = False) -> DataFrame:
    """(key, doc, part, parts, pos, cell): the text of one staff on one line, cells of its spines joined by blanks.

    With two staffs, and always where they are to be merged, the upper one (the last spine) comes first.
    """
    cells = F.split("line", "\t")
    manipulates = F.forall(cells, lambda c: c.startswith("**")) | F.array_contains(cells, "*^") | F.array_contains(cells, "*v")
    tagged = lines.withColumn("_cells", cells).withColumn("_moves", manipulates & (F.trim("line") != ""))
    moves = tagged.where("_moves").groupBy(key, "doc").agg(
        F.array_sort(F.collect_list(F.struct("line_no", F.col("_cells").alias("cells")))).alias("_m")
    )
    start = F.array(F.struct(F.lit(-1).alias("line_no"), F.array().cast("array<int>").alias("map")))

    def step(acc: Column, move: Column) -> Column:
        state = _next_map(F.element_at(acc, -1)["map"], move["cells"])
        return F.concat(acc, F.array(F.struct(move["line_no"].alias("line_no"), state.alias("map"))))

    maps = moves.select(key, "doc", F.aggregate("_m", start, step).alias("_maps"))
    maps = maps.withColumn("parts", F.array_max(F.transform("_maps", lambda m: F.coalesce(F.array_max(m["map"]), F.lit(-1)))) + 1)
    # the map in force on a line is the last one before it: a running frame over lines and maps together
    changes = maps.select(key, "doc", "parts", F.explode("_maps").alias("_c")).select(
        key, "doc", "_c.line_no", F.lit(None).cast("array<string>").alias("_cells"), F.lit(False).alias("_blank"),
        F.col("_c.map").alias("_map"), "parts",
    )
    data = tagged.where("not _moves").select(
        key, "doc", "line_no", "_cells", (F.trim("line") == "").alias("_blank"), F.lit(None).cast("array<int>").alias("_map"),
        F.lit(None).cast("int").alias("parts"),
    )
    document = W.partitionBy(key, "doc")
    running = document.orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    data = (
        data.unionByName(changes)
        .withColumns({"_map": F.last("_map", ignorenulls=True).over(running), "parts": F.max("parts").over(document)})
        .where("_cells is not null and parts is not null")
    )
    staffs = F.when(F.col("_blank"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
        F.array_distinct(F.slice("_map", F.lit(1), F.size("_cells")))
    )
    rows = data.withColumn("_staff", F.explode(staffs))
    own = F.filter(F.col("_cells"), lambda c, i: F.get(F.col("_map"), i) == F.col("_staff"))
    upwards = F.lit(merged) | (F.col("parts") == 2)
    part = F.when(upwards, F.col("parts") - 1 - F.col("_staff")).otherwise(F.col("_staff"))
    return rows.select(key, "doc", part.alias("part"), "parts", F.col("line_no").alias("pos"), F.when(F.col("_blank"), F.lit("")).otherwise(F.array_join(own, " ")).alias("cell"))


def kern_tokens(texts: DataFrame, key: str = "score", merged: bool = False) -> DataFrame:
    """kern text -> tokens, ordered by `ord` within (key, part).

    `merged=False` gives one sequence per staff (all on the upper position) with signatures carried from document to
    document; `merged=True` merges the staffs into one sequence of upper and lower tokens. A text with anything that
    cannot be decoded is left out whole; see `kern_errors`.
    """
    ensure_checkpoint_dir(texts.sparkSession)
    decoded = _decode(texts, key, merged).checkpoint()  # read four times below; parsed once
    rows = decoded.join(_faults(decoded, key).select(key), key, "left_anti")
    part_keys = [key, "part"]
    fields = V.TOKEN_FIELDS
    # signatures: what the carry keeps; the opening ones sit before everything else of their document
    signs = rows.where("kind in ('clef', 'key', 'time')").withColumn("_open", F.coalesce(F.col("line") < F.col("_first"), F.lit(True)))
    parts = rows.groupBy(*part_keys).agg(F.min("doc").alias("doc"))
    clef = F.when(F.col("part") == 0, F.lit("clef_G2")).otherwise(F.lit("clef_F4"))
    side = F.when(F.col("part") == 0, F.lit("upper")).otherwise(F.lit("lower"))
    default = F.explode(F.array(
        F.struct(F.lit("clef").alias("kind"), clef.alias("rhythm"), side.alias("position")),
        F.struct(F.lit("key").alias("kind"), F.lit("keySignature_0").alias("rhythm"), F.lit(".").alias("position")),
        F.struct(F.lit("time").alias("kind"), F.lit("timeSignature/4").alias("rhythm"), F.lit(".").alias("position")),
    ))
    defaults = parts.select(*part_keys, "doc", default.alias("_d")).select(*part_keys, "doc", F.lit(-1).alias("line"), F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("nth")).alias("slot"), "_d.*", F.lit(True).alias("_open"))
    signs = signs.select(*part_keys, "doc", "line", "slot", "kind", F.col("token.rhythm").alias("rhythm"), F.lit(".").alias("position"), "_open").unionByName(defaults).repartition(*part_keys)
    order = F.struct("line", "slot")
    latest = F.max(F.when(F.col("_open"), order)).over(W.partitionBy(*part_keys, "doc", "kind"))
    counted = signs.withColumn("_latest", latest).where(~F.col("_open") | (order == F.col("_latest")))
    state = F.struct("rhythm", "position")
    before = F.lag(state).over(W.partitionBy(*part_keys, "kind").orderBy("doc", "line", "slot"))
    changed = counted.withColumn("_state", state).withColumn("_before", before).where(~F.col("_state").eqNullSafe(F.col("_before")))
    opening = {"clef": -10, "key": -9, "time": -8}
    at = F.when(F.col("_open"), T.literal_map(opening, F.col("kind"))).otherwise(F.col("line"))
    filler = F.when(F.col("kind") == "clef", F.lit(V.EMPTY)).otherwise(F.lit(V.NOT_APPLICABLE))
    sign_rows = changed.select(*part_keys, "doc", at.alias("onset"), F.col("line"), F.col("slot"), "rhythm", *[filler.alias(f) for f in fields[1:5]], "position")
    music = rows.where("(kind = 'bar' and line > _first and token.rhythm <> '') or (kind = 'data' and token is not null)")
    music_rows = music.select(*part_keys, "doc", F.col("line").alias("onset"), "line", "slot", *[F.col("token").getField(f).alias(f) for f in fields[:5]], F.lit(".").alias("position"))
    every = sign_rows.unionByName(music_rows)
    if merged:
        staff, group = side, [key, "doc"]
    else:
        staff, group = F.lit("upper"), [key, "part", "doc"]
    placed = every.withColumn("position", F.when(T.has_position(F.col("rhythm")) & (F.col("position") == "."), staff).otherwise(F.col("position")))
    # one exchange for all windows of the merge: each of their keys holds the group
    flat = placed.withColumn("pos", F.struct("part", "line", "slot"))
    one = N.merge_staves(dealt(flat, *group), tuple(group), "onset")
    one = one.withColumn("ord", F.struct("onset", "rank", "pos", "slot"))
    out_keys = [key] if merged else part_keys
    one = _collapse(one, group)
    final = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("ord"))) == 1
    rhythm = F.when(F.col("_final") & (F.col("rhythm") == "repeatStart"), F.lit("barline")).otherwise(F.col("rhythm"))
    one = one.withColumn("_final", final).withColumn("rhythm", rhythm).withColumn("lift", T.without_natural(F.col("lift")))
    return one.select(*out_keys, F.struct("doc", "ord").alias("ord"), *fields)


def _collapse(tokens: DataFrame, group) -> DataFrame:
    return C.collapse_adjacent_keys(tokens.withColumnRenamed("pos", "_p").withColumnRenamed("ord", "pos"), tuple(group)).withColumnRenamed("pos", "ord").drop("_p")


def _decode(texts: DataFrame, key: str, merged: bool = False) -> DataFrame:
    """One row per decoded cell entry: kind, line (shared by neighbouring control lines), slot, token; with the first data
    line of its staff and document."""
    cells = staff_cells(split_documents(dealt(texts, key), key), key, merged)
    numbered = N.control_line_numbers(cells, F.col("cell").startswith("*"), (key, "part", "doc"))
    c = F.col("cell")
    kind = (
        F.when(c.startswith("="), F.lit("bar")).when(c.startswith("*k"), F.lit("key")).when(c.startswith("*M"), F.lit("time"))
        .when(c.startswith("*clef"), F.lit("clef")).when(c.startswith("*"), F.lit("other")).otherwise(F.lit("data"))
    )
    first_data = F.min(F.when(F.col("kind") == "data", F.col("line_no").cast("int"))).over(W.partitionBy(key, "part", "doc"))
    rows = numbered.withColumn("kind", kind).withColumn("_first", first_data).where("kind <> 'other'")
    names = F.filter(F.split(c, r"\s+"), lambda x: (x != "") & (x != "."))
    chord = F.regexp_extract(F.coalesce(F.try_element_at(names, F.lit(1)), F.lit("")), DURATION, 1)
    rows = rows.withColumn("_names", names).withColumn("_chord", F.when(chord == "", F.lit("4")).otherwise(chord))
    entries = F.when(F.col("kind") == "data", F.when(F.size("_names") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.col("_names"))).otherwise(F.array(c))
    rows = rows.select(key, "doc", "part", F.col("line_no").cast("int").alias("line"), F.col("pos"), "kind", "_first", "_chord", F.posexplode(entries).alias("_i", "entry"))
    e = F.col("entry")
    rows = rows.withColumn("_parts", F.when(F.col("kind") == "data", note_parts(e)))

    def plain(rhythm: Column) -> Column:
        return F.struct(rhythm.alias("rhythm"), *[F.lit(V.NOT_APPLICABLE).alias(f) for f in V.TOKEN_FIELDS[1:5]])

    token = (
        F.when((F.col("kind") == "data") & e.isNotNull(), note_token(e, F.col("_chord"), F.col("_parts")))
        .when(F.col("kind") == "bar", plain(bar_token(e))).when(F.col("kind") == "key", plain(key_token(e)))
        .when(F.col("kind") == "time", plain(time_token(e))).when(F.col("kind") == "clef", plain(clef_token(e)))
    )
    # slot keeps the order of lines that share a number, and of the notes on a line
    slot = F.struct(F.col("pos").cast("bigint").alias("at"), F.col("_i").cast("bigint").alias("nth"))
    return rows.select(key, "doc", "part", "line", slot.alias("slot"), "kind", "_first", "entry", token.alias("token"))


def _faults(decoded: DataFrame, key: str) -> DataFrame:
    bad = decoded.where("entry is not null and (token is null or token.rhythm is null)")
    return bad.groupBy(key).agg(F.min(F.concat_ws(": ", "kind", "entry")).alias("error"))


def kern_errors(texts: DataFrame, key: str = "score") -> DataFrame:
    """(key, error) of every text that `kern_tokens` leaves out."""
    return _faults(_decode(texts, key), key)
