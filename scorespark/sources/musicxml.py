"""MusicXML text to tokens.

Spark's XML reader groups children by tag and so loses their order. A small Arrow-batched function therefore lists the
children of each measure in document order as flat rows of raw values; everything that gives them a meaning (onsets,
tuplets, clefs, bar lines, chords) is DataFrame work on those rows.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as TY
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window as W

from ..functions import durations as DU
from ..functions import text as X
from ..functions import tokens as T
from ..functions import vocabulary as V
from ..operators import windows as N
from ..session import ensure_checkpoint_dir

# Note type names and accidentals.
TYPE_NUMBERS = {"breve": 0, "whole": 1, "half": 2, "quarter": 4, "eighth": 8, "16th": 16, "32nd": 32, "64th": 64, "128th": 128}
ACCIDENTALS = {"sharp": "#", "flat": "b", "natural": "N"}

ROW = (
    "part int, measure int, ord int, tag string, staff int, duration int, chord boolean, grace boolean, hidden boolean, pitched boolean, "
    "rest string, type string, dots int, step string, octave string, alter string, accidental string, actual int, normal int, "
    "tuplet array<string>, noted boolean, marks array<string>, slurs array<string>, tremolo array<string>, value string, line string, late boolean, fault string"
)
_TYPES = {
    "int": TY.IntegerType(), "string": TY.StringType(), "boolean": TY.BooleanType(), "array<string>": TY.ArrayType(TY.StringType()),
}
_FIELDS = [TY.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in ROW.split(", "))]
_NAMES = [field.name for field in _FIELDS]
#: Texts parsed at a time, and rows of a batch that leaves.
TEXTS, ROWS = 16, 4096


def _note(node: ET.Element) -> dict:
    """Raw values of a note element."""
    def text(path: str, default=None):
        return (node.findtext(path) or "").strip() or default

    notations = node.find("notations")
    shown = notations is not None and notations.get("print-object") != "no"
    marks, slurs, tremolo = [], [], []
    for child in notations if shown else ():
        visible = child.get("print-object") != "no"
        if child.tag in ("articulations", "ornaments") and visible:
            for mark in child:
                if mark.tag == "tremolo" and child.tag == "articulations":
                    tremolo.append(mark.get("type", ""))
                else:
                    marks.append(mark.tag)
        elif child.tag == "arpeggiate" or (child.tag == "fermata" and visible):
            marks.append(child.tag)
        elif child.tag in ("tied", "slur"):
            slurs.append("slur" + child.get("type", "").capitalize())
    brackets = []
    for t in notations.findall("tuplet") if notations is not None else ():
        hidden = t.get("show-number") == "none" or notations.get("print-object") == "no"
        if t.get("type") == "stop" or not hidden:
            brackets.append(t.get("type", ""))
    rest = node.find("rest")
    return {
        "staff": int(text("staff", "1")) - 1, "duration": int(text("duration", "0")), "chord": node.find("chord") is not None,
        "grace": node.find("grace") is not None, "hidden": node.get("print-object") == "no", "pitched": node.find("pitch") is not None,
        "rest": None if rest is None else ("measure" if rest.get("measure") else "plain"), "type": text("type", "eighth"), "dots": len(node.findall("dot")),
        "step": text("pitch/step"), "octave": text("pitch/octave"), "alter": text("pitch/alter"), "accidental": text("accidental"),
        "actual": int(text("time-modification/actual-notes", "0")), "normal": int(text("time-modification/normal-notes", "0")),
        "tuplet": brackets, "noted": shown, "marks": marks, "slurs": slurs, "tremolo": tremolo,
    }


def _attributes(node: ET.Element) -> list[dict]:
    rows = [{"tag": "divisions", "value": node.findtext("divisions")}] if node.find("divisions") is not None else []
    for i, clef in enumerate(node.findall("clef")):
        number = int(clef.get("number", "1")) - 1
        rows.append({
            "tag": "clef", "staff": number if number >= 0 else i, "value": (clef.findtext("sign") or "").strip(), "line": (clef.findtext("line") or "").strip(),
            "late": clef.get("after-barline") == "yes", "fault": "octave clef" if clef.find("clef-octave-change") is not None else None,
        })
    rows += [{"tag": "key", "value": (n.findtext("fifths") or "0").strip()} for n in node.findall("key")[:1]]
    rows += [{"tag": "time", "value": (n.findtext("beat-type") or "").strip()} for n in node.findall("time")[:1]]
    rows += [{"tag": "multirest", "value": n.text} for n in node.findall("measure-style/multiple-rest")[:1]]
    return rows


def _children(text: str) -> list[dict]:
    rows = []
    for p, part in enumerate(ET.fromstring(text).findall("part")):
        for m, measure in enumerate(part.findall("measure")):
            rows.append({"part": p, "measure": m, "tag": "measure"})
            for child in measure:
                if child.tag == "note":
                    if any((h.text or "").strip() == "none" for h in child.findall("notehead")):
                        continue
                    found = [{"tag": "note", **_note(child)}]
                elif child.tag == "attributes":
                    found = _attributes(child)
                elif child.tag in ("backup", "forward"):
                    length = int(child.findtext("duration") or 0)
                    found = [{"tag": "move", "duration": -length if child.tag == "backup" else length}]
                elif child.tag == "barline":
                    repeat, ending = child.find("repeat"), child.find("ending")
                    found = [{
                        "tag": "barline", "value": (child.findtext("bar-style") or "").strip(), "type": "" if repeat is None else repeat.get("direction", ""),
                        "line": "" if ending is None else ending.get("type", ""),
                    }]
                elif child.tag == "print" and child.get("new-page") == "yes":
                    found = [{"tag": "page"}]
                elif child.tag == "direction" and child.find("direction-type/octave-shift") is not None:
                    found = [{"tag": "direction", "fault": "octave shift"}]
                else:
                    continue
                rows += [{"part": p, "measure": m, **row} for row in found]
    for i, row in enumerate(rows):
        row["ord"] = i
    return rows


def shred(batches: Iterator[pa.RecordBatch], key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(key, error, raw columns) of batches of (key, text). What is held does not grow with the batch: a few texts at a time
    are taken out of it, and their rows leave in batches of ``ROWS``."""
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS):
            piece = batch.slice(start, TEXTS)
            rows = []
            for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                try:
                    found, error = _children(text), None
                except Exception as exc:  # a broken score is a row, not a failed job
                    found, error = [], f"{type(exc).__name__}: {exc}"
                rows += [(key, error, row) for row in found or [{}]]
            for first in range(0, len(rows), ROWS):
                part = rows[first : first + ROWS]
                columns = [pa.array([key for key, _, _ in part], key_type), pa.array([error for _, error, _ in part], pa.string())]
                columns += [pa.array([row.get(f.name) for _, _, row in part], to_arrow_type(f.dataType)) for f in _FIELDS]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "error", *_NAMES])


def event_rows(texts: DataFrame, key: str = "score") -> DataFrame:
    """(key, error, raw columns): one row per child element; a text that cannot be read gives one row with an error."""
    kind = texts.schema[key].dataType
    schema = TY.StructType([TY.StructField("key", kind), TY.StructField("error", TY.StringType()), *_FIELDS])
    key_type = to_arrow_type(kind)
    return texts.select(key, "text").mapInArrow(lambda batches: shred(batches, key_type), schema).withColumnRenamed("key", key)


def read_musicxml(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("score"), F.col("value").alias("text"))


# ---- meaning of the rows -------------------------------------------------------------------------------------------


def alter_lift(alter: Column) -> Column:
    return (
        F.when(alter < -1, F.lit("bb")).when(alter == -1, F.lit("b")).when(alter == 1, F.lit("#")).when(alter > 1, F.lit("##")).otherwise(F.lit("N"))
    )


def lift(accidental: Column, alter: Column) -> Column:
    """A written accidental beats the sounding one."""
    written = F.coalesce(T.literal_map(ACCIDENTALS, accidental), F.lit(V.EMPTY))
    sounding = F.when(alter.isNull(), F.lit(V.EMPTY)).otherwise(alter_lift(alter.try_cast("double").cast("int")))
    return F.when(accidental.isNotNull(), written).otherwise(sounding)


def bar_line_tokens(style: Column, direction: Column, ending: Column) -> Column:
    """Tokens of a barline element: repeat first, then heavy, then light; an ending adds its volta token."""
    bar = (
        F.when(direction == "forward", F.lit("repeatStart")).when(direction == "backward", F.lit("repeatEnd"))
        .when(style.contains("heavy"), F.lit("bolddoublebarline")).when(style.contains("light"), F.lit("doublebarline"))
    )
    volta = (
        F.when(ending == "stop", F.lit("voltaStop")).when(ending == "discontinue", F.lit("voltaDiscontinue")).when(ending == "start", F.lit("voltaStart"))
    )
    return F.array_compact(F.array(bar, volta))


def _faults(rows: DataFrame, key: str) -> DataFrame:
    bad_time = (F.col("tag") == "time") & ~F.col("value").isin([str(d) for d in V.TIME_DENOMINATORS])
    bad_type = (F.col("tag") == "note") & ~F.col("type").isin(list(TYPE_NUMBERS))
    reason = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("fault").isNotNull(), F.col("fault"))
        .when(bad_time, F.lit("unsupported time signature")).when(bad_type, F.lit("unknown note type"))
    )
    return rows.withColumn("_reason", reason).where("_reason is not null").groupBy(key).agg(F.min("_reason").alias("error"))


def _symbols(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a clock kind and their token: notes, clefs, signatures, bar lines, moves."""
    part, measure = (key, "part"), (key, "part", "measure")
    tag = F.col("tag")
    w = W.partitionBy(*part).orderBy("ord")
    divisions = F.last(F.when(tag == "divisions", F.col("value").try_cast("int")), ignorenulls=True).over(w)
    state = rows.withColumn("_div", F.coalesce(divisions, F.lit(1)))
    tremolo = F.last(F.when(F.size("tremolo") > 0, F.element_at("tremolo", -1) == "start"), ignorenulls=True).over(w)
    state = state.withColumn("_tremolo", F.coalesce(tremolo, F.lit(False)))
    # clefs printed after a bar line move to the start of the next measure, unless it opens with its own
    other = F.min(F.when(~((tag == "clef") & ~F.col("late")) & ~tag.isin("measure", "divisions"), F.col("ord"))).over(W.partitionBy(*measure))
    state = state.withColumn("_other", other)
    late = state.where("tag = 'clef' and late").withColumn("pos", F.col("ord")).withColumn("rhythm", F.concat(F.lit("clef_"), "value", "line"))
    leading = state.where("tag = 'clef' and not late and ord < coalesce(_other, 2147483647)")
    moved = N.pending_clefs(late, leading, part)
    starts = rows.where("tag = 'measure'").select(key, "part", "measure", F.col("ord").alias("_at"))
    pending = moved.join(starts, [key, "part", "measure"])
    kept = state.where("not (tag = 'clef' and late)")
    # a bar line element may give two tokens
    tokens = F.when(tag == "barline", bar_line_tokens(F.col("value"), F.col("type"), F.col("line"))).otherwise(F.array(F.lit("")))
    kept = kept.where("tag not in ('measure', 'divisions', 'page', 'direction')").select("*", F.posexplode(tokens).alias("_i", "_bar"))
    number = F.coalesce(F.col("value").try_cast("int"), F.lit(0))
    rhythm = (
        F.when(tag == "barline", F.col("_bar")).when(tag == "clef", F.concat(F.lit("clef_"), "value", "line"))
        .when(tag == "key", F.concat(F.lit("keySignature_"), number.cast("string"))).when(tag == "time", F.concat(F.lit("timeSignature/"), "value"))
        .when(tag == "multirest", DU.multirest_token(number))
    )
    note = tag == "note"
    kind = (
        F.when(note & F.col("chord"), F.lit("chord")).when(note, F.lit("note")).when(tag == "move", F.lit("move")).when(tag == "clef", F.lit("clef"))
        .when(rhythm.contains("barline"), F.lit("bar")).otherwise(F.lit("symbol"))
    )
    kept = kept.where("not (tag = 'note' and not pitched and rest is null)").select(
        "*", rhythm.alias("rhythm"), kind.alias("kind"), F.struct(F.col("ord"), F.col("_i")).alias("pos")
    )
    extra = pending.select(
        key, "part", "measure", F.lit("clef").alias("tag"), "staff", "rhythm", F.lit("clef").alias("kind"),
        F.struct(F.col("_at").alias("ord"), F.col("staff").alias("_i")).alias("pos"),
    )
    return kept.drop("ord").unionByName(extra, allowMissingColumns=True)


def _clocked(symbols: DataFrame, key: str) -> DataFrame:
    raw = F.coalesce("duration", F.lit(0))
    step = F.when((F.col("tag") == "note") & F.col("pitched"), F.greatest(raw, F.lit(1))).otherwise(raw)
    timed = symbols.withColumn("duration", step).withColumn("visible", ~F.coalesce("hidden", F.lit(False)))
    return N.onsets(timed, (key, "part", "measure"))


def _notes(clocked: DataFrame, key: str) -> DataFrame:
    """Token fields of the notes and rests; the others pass through."""
    note = F.col("tag") == "note"
    w = W.partitionBy(key, "part").orderBy("pos")
    inside = W.partitionBy(key, "part", "measure").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    signal = F.when(F.size("tuplet") > 0, F.element_at("tuplet", -1) == "start")
    after = F.coalesce(F.last(signal, ignorenulls=True).over(w), F.lit(False))
    before = F.coalesce(F.last(signal, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    last_stop = F.last(F.when(F.array_contains("tuplet", "stop"), F.col("onset")), ignorenulls=True).over(inside)
    in_tuplet = after | before | F.coalesce(last_stop == F.col("onset"), F.lit(False))
    rows = clocked.withColumn("_in", in_tuplet)
    ratio = F.when(F.col("_in") & (F.col("actual") > 0) & (F.col("normal") > 0), F.col("actual") / F.col("normal")).otherwise(F.lit(1.0))
    number = T.literal_map(TYPE_NUMBERS, F.col("type"))
    grace = F.coalesce("grace", F.lit(False))

    def token(base: str) -> Column:
        return DU.rhythm_token(base, number, ratio, F.coalesce("dots", F.lit(0)), grace)

    whole = F.coalesce(F.col("rest") == "measure", F.lit(False))
    rhythm = (
        F.when(~note, F.col("rhythm")).when(whole, DU.measure_rest(F.col("duration"), F.col("_div"))).when(F.col("rest").isNotNull(), token("rest"))
        .otherwise(token("note"))
    )
    camel = F.transform(F.coalesce("marks", F.array().cast("array<string>")), lambda m: DU.articulation_name(X.camel_case(m)))
    trem = F.when(F.col("_tremolo") & F.col("noted"), F.array(F.lit("tremolo"))).otherwise(F.array().cast("array<string>"))
    marks = F.array_sort(F.array_distinct(F.concat(F.filter(camel, lambda m: m.isNotNull()), trem)))
    slurs = F.array_sort(F.coalesce("slurs", F.array().cast("array<string>")))

    def joined(values: Column) -> Column:
        return F.when(~whole & (F.size(values) > 0), F.array_join(values, "_")).otherwise(F.lit(V.EMPTY))

    pitched = note & F.col("pitched") & F.col("rest").isNull()
    rows = rows.withColumn("_rhythm", rhythm)
    placed = T.has_position(F.col("_rhythm"))
    filler = F.when(placed, F.lit(V.EMPTY)).otherwise(F.lit(V.NOT_APPLICABLE))
    position = F.when(~placed, F.lit(V.NOT_APPLICABLE)).when(F.coalesce("staff", F.lit(0)) == 0, F.lit("upper")).otherwise(F.lit("lower"))
    return rows.select(
        key, "part", "measure", "pos", "onset", "kind", "visible", "broken", F.col("_rhythm").alias("rhythm"),
        F.when(pitched, F.concat("step", "octave")).otherwise(filler).alias("pitch"),
        F.when(pitched, lift(F.col("accidental"), F.col("alter"))).otherwise(filler).alias("lift"),
        F.when(note, joined(marks)).otherwise(filler).alias("articulation"),
        F.when(note, joined(slurs)).otherwise(filler).alias("slur"),
        position.alias("position"),
    )


def musicxml_tokens(texts: DataFrame, key: str = "score") -> DataFrame:
    """(key, part, measure, ord, fields) in score order; faulty scores are left out, see `musicxml_errors`."""
    ensure_checkpoint_dir(texts.sparkSession)
    rows = event_rows(texts, key).checkpoint()  # parsed once, read several times below
    good = rows.join(_faults(rows, key).select(key), key, "left_anti")
    tokens = _notes(_clocked(_symbols(good, key), key), key).checkpoint()  # the clock check reads it too
    broken = tokens.where("broken").select(key).distinct()
    sounding = tokens.join(broken, key, "left_anti").where("visible and kind <> 'move'")
    filled = N.fill_mark(sounding, "arpeggiate", [key, "part", "measure", "onset", "position"])
    grace = F.col("rhythm").contains("G") & T.is_sounding(F.col("rhythm"))
    early = ~T.is_sounding(F.col("rhythm")) | F.col("rhythm").endswith("m") | grace
    order = F.col("onset") * 2 - early.cast("int")
    low = (F.col("position") == "lower").cast("int")
    placed = filled.withColumn("sort_order", order).withColumn("pos", F.struct(low.alias("low"), F.col("pos").alias("at")))
    merged = N.merge_staves(placed, (key, "part", "measure"), "sort_order")
    flat = merged.withColumn("pos", F.struct("measure", "sort_order", "rank", "pos", "slot"))
    measures = good.where("tag = 'measure'").select(key, "part", "measure")
    closed = N.coalesce_bar_lines(flat, (key, "part"), V.TOKEN_FIELDS[1:], measures)
    ord_ = F.struct("measure", F.col("pos").isNull().alias("added"), "pos")
    return closed.join(broken, key, "left_anti").select(key, "part", "measure", ord_.alias("ord"), *V.TOKEN_FIELDS)


def musicxml_errors(texts: DataFrame, key: str = "score") -> DataFrame:
    """(key, error) of every text that `musicxml_tokens` leaves out."""
    ensure_checkpoint_dir(texts.sparkSession)
    rows = event_rows(texts, key).checkpoint()
    faults = _faults(rows, key)
    good = rows.join(faults.select(key), key, "left_anti")
    broken = _clocked(_symbols(good, key), key).where("broken").select(key).distinct()
    return faults.unionByName(broken.withColumn("error", F.lit("backup before the start of the measure")))
