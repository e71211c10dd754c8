"""Semantic text (`kind-value` words of one staff) to tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..functions import vocabulary as V
from ..operators import windows as N

# Duration names.
DURATIONS = {
    "quadruple_whole": "1", "double_whole": "1", "whole": "1", "half": "2", "quarter": "4", "eighth": "8", "sixteenth": "16",
    "thirty_second": "32", "sixty_fourth": "64", "hundred_twenty_eighth": "128",
}


def _duration(name: Column, grace: Column) -> Column:
    dots = F.length(name) - F.length(F.replace(name, F.lit("."), F.lit("")))
    base = T.literal_map(DURATIONS, F.replace(name, F.lit("."), F.lit("")))
    return F.concat(base, F.when(grace, F.lit("G")).otherwise(F.lit("")), F.repeat(F.lit("."), dots))


def word_token(word: Column) -> Column:
    """Fields of one word; rhythm is NULL where a note or rest cannot be read."""
    note = word.rlike("^(grace)?note-")
    rest = word.startswith("rest-")
    body = F.regexp_extract(word, r"^(?:grace)?(?:note|rest)-(.*)$", 1)
    fermata = body.endswith("fermata")
    length = F.replace(F.when(note, F.regexp_extract(body, r"^[^_]*_(.*)$", 1)).otherwise(body), F.lit("_fermata"), F.lit(""))
    pitch = [F.regexp_extract(body, r"^([A-G])([b#N]*)(\d)", i) for i in (1, 2, 3)]
    measures = F.regexp_extract(word, r"^multirest-(\d+)$", 1).try_cast("int")
    value = F.regexp_extract(word, r"^[^-]*-(.*)$", 1)
    time = F.when(value == "C", F.lit("4")).when(value == "C/", F.lit("2")).otherwise(F.try_element_at(F.split(value, "/"), F.lit(2)))
    rhythm = (
        F.when(note & (pitch[0] == ""), F.lit(None).cast("string"))
        .when(note, F.concat(F.lit("note_"), _duration(length, word.startswith("grace"))))
        .when(rest, F.concat(F.lit("rest_"), _duration(length, F.lit(False))))
        .when(word.startswith("multirest-"), F.when(measures == 1, F.lit("rest_0")).otherwise(F.concat(F.lit("rest_"), F.least(measures, F.lit(10)).cast("string"), F.lit("m"))))
        .when(word.startswith("clef-"), F.replace(word, F.lit("-"), F.lit("_")))
        .when(word.startswith("keySignature-"), F.concat(F.lit("keySignature_"), T.key_fifths(value).cast("string")))
        .when(word.startswith("timeSignature-"), F.concat(F.lit("timeSignature/"), time))
        .when(word == "tie", F.lit("tieSlur"))
        .otherwise(word)
    )
    placed = T.has_position(rhythm)

    def field(of_note: Column) -> Column:
        return F.when(note, of_note).when(placed, F.lit(V.EMPTY)).otherwise(F.lit(V.NOT_APPLICABLE))

    lift = F.when(pitch[1] == "", F.lit(V.EMPTY)).otherwise(pitch[1])
    mark = F.when((note | rest) & fermata, F.lit("fermata")).when(placed, F.lit(V.EMPTY)).otherwise(F.lit(V.NOT_APPLICABLE))
    return F.struct(
        rhythm.alias("rhythm"), field(F.concat(pitch[0], pitch[2])).alias("pitch"), field(lift).alias("lift"), mark.alias("articulation"),
        field(F.lit(V.EMPTY)).alias("slur"), F.when(placed, F.lit("upper")).otherwise(F.lit(V.NOT_APPLICABLE)).alias("position"),
    )


def semantic_tokens(texts: DataFrame, key: str = "score") -> DataFrame:
    """(key, pos, fields): words decoded, a closing bar line ensured, ties folded into slurs."""
    words = F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")
    closed = F.when(F.element_at(words, -1) == "barline", words).otherwise(F.concat(words, F.array(F.lit("barline"))))
    rows = texts.select(key, F.posexplode(closed).alias("pos", "word")).select(key, "pos", word_token(F.col("word")).alias("_t")).select(key, "pos", "_t.*")
    bad = rows.where("rhythm is null").select(key).distinct()
    return N.fold_ties(rows.join(bad, key, "left_anti"), (key,))
