"""Column expressions for note values, page sizes and source-text rewriting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tokens as T

# Names other formats use for the same articulation; empty means ignore.
ARTICULATION_SYNONYMS = {
    "strongAccent": "accent", "softAccent": "accent", "invertedTurn": "turn", "trillMark": "trill",
    "wavyLine": "trill", "invertedMordent": "trill", "accidentalMark": "", "scoop": "", "doit": "", "caesura": "",
    "otherOrnament": "", "otherArticulation": "",
}

# Quarters of a whole-measure rest and its token.
MEASURE_RESTS = {
    4.0: "rest_1", 3.0: "rest_2.", 2.0: "rest_2", 1.5: "rest_4.", 1.0: "rest_4", 0.75: "rest_8.", 0.5: "rest_8",
}

CANVAS_WIDTH, CANVAS_HEIGHT, PAGE_WIDTH = 1280, 256, 1920


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative longs: 64 Euclid steps over a tiny array, enough for any long."""
    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))

    def step(s: Column, _: Column) -> Column:
        rest = F.when(s["b"] == 0, F.lit(0).cast("bigint")).otherwise(s["a"] % F.nullif(s["b"], F.lit(0)))
        return F.struct(
            F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), rest.alias("b")
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(90)), start, step, lambda s: s["a"])


def prime_powers(n: int) -> dict[int, int]:
    """Prime factors of a number with their exponents."""
    found, p = {}, 2
    while n > 1:
        while n % p == 0:
            found[p] = found.get(p, 0) + 1
            n //= p
        p += 1
    return found


def exponent(value: Column, prime: int, most: int) -> Column:
    """How often a prime divides a positive long, counted up to ``most``."""
    out = F.lit(0)
    for k in range(1, most + 1):
        out = out + (value % prime**k == 0).cast("int")
    return out


def power(prime: int, exponent: Column, most: int) -> Column:
    return F.element_at(F.array(*[F.lit(prime**k).cast("bigint") for k in range(most + 1)]), exponent + 1)


def duration(kern: Column) -> Column:
    return T.duration_struct(kern)


def measure_rest(length: Column, divisions: Column) -> Column:
    """Rest token for a whole-measure rest given in divisions of a quarter."""
    quarters = F.try_divide(length, divisions)
    out = F.when(divisions <= 0, F.lit("rest_1"))
    for value, token in MEASURE_RESTS.items():
        out = out.when(F.abs(quarters - value) < 0.01, F.lit(token))
    return out.otherwise(F.lit("rest_1"))


def articulation_name(camel: Column) -> Column:
    """Common name of an articulation; NULL when it is to be ignored."""
    return F.nullif(F.coalesce(T.literal_map(ARTICULATION_SYNONYMS, camel), camel), F.lit(""))


def voice_number(staff: Column, layer: Column) -> Column:
    return (staff - 1) * 4 + layer + 1


def rhythm_token(kind: str, number: Column, tuplet_factor: Column, dots: Column, grace: Column) -> Column:
    base = F.bround(number * tuplet_factor).cast("int").cast("string")
    mark = F.when(grace, F.lit("G")).otherwise(F.lit(""))
    dotted = F.substring(F.lit(".."), F.lit(1), F.least(dots, F.lit(2)).cast("int"))
    return F.concat(F.lit(kind + "_"), base, mark, dotted)


def multirest_token(measures: Column) -> Column:
    return F.concat(F.lit("rest_"), F.least(measures, F.lit(10)).cast("string"), F.lit("m"))


def canvas_size(width: Column, height: Column) -> tuple[Column, Column]:
    """Largest size of the same aspect inside the fixed canvas, truncated."""
    tall = height / width > CANVAS_HEIGHT / CANVAS_WIDTH
    return (
        F.when(tall, (width / height * CANVAS_HEIGHT).cast("int")).otherwise(F.lit(CANVAS_WIDTH)),
        F.when(tall, F.lit(CANVAS_HEIGHT)).otherwise((height / width * CANVAS_WIDTH).cast("int")),
    )


def page_size(width: Column, height: Column) -> tuple[Column, Column]:
    scaled = F.bround(height * (F.lit(float(PAGE_WIDTH)) / width)).cast("int")
    return F.lit(PAGE_WIDTH), F.when(width == PAGE_WIDTH, height.cast("int")).otherwise(scaled)


def replace_suffix(path: Column, suffix: str) -> Column:
    """First known image ending in the path, replaced; NULL when there is none."""
    endings = [".jpg", ".jpeg", ".png"]
    if suffix == ".semantic":
        endings.insert(0, "_distorted.jpg")
    out = None
    for ending in endings:
        hit = path.contains(ending)
        value = F.replace(path, F.lit(ending), F.lit(suffix))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def make_staves_visible(text: Column) -> Column:
    for flag in ("hideEmptyStaves", "hideWhenEmpty", "cutaway"):
        text = F.replace(text, F.lit(f"<{flag}>1</{flag}>"), F.lit(f"<{flag}>0</{flag}>"))
    return text


def reset_note_positions(text: Column) -> Column:
    """Drop a position override that is the very first child of a note, never a nested one."""
    return F.regexp_replace(text, r"(<Note>\s*)<pos\b[^>]*(?:/>|>\s*</pos>)\s*", "$1")
