"""Column expressions over token fields. Everything here stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocabulary as V

# Least common multiple of all vocabulary bases times 4 (two dots): every duration is a whole number of ticks.
TICKS_PER_WHOLE = 392_071_680


def literal_map(values: dict, key: Column) -> Column:
    """Look a key up in a small constant map; NULL when absent."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def has_position(rhythm: Column) -> Column:
    return rhythm.startswith("note") | rhythm.startswith("rest") | rhythm.startswith("clef")


def is_sounding(rhythm: Column) -> Column:
    return rhythm.startswith("note") | rhythm.startswith("rest")


def is_measure_end(rhythm: Column) -> Column:
    return rhythm.contains("barline") | rhythm.contains("repeat")


def is_control(rhythm: Column) -> Column:
    return rhythm.isin("BOS", "EOS", "PAD")


def is_valid_combination(t: str = "") -> Column:
    """Each of the five fields is filled exactly when the rhythm class carries a position."""
    filled = has_position(F.col(f"{t}rhythm"))
    checks = [(F.col(f"{t}{name}") != V.NOT_APPLICABLE) == filled for name in V.TOKEN_FIELDS[1:]]
    result = checks[0]
    for check in checks[1:]:
        result = result & check
    return result


def token_text(t: str = "") -> Column:
    return F.concat_ws(" ", *[F.col(f"{t}{name}") for name in V.TOKEN_FIELDS])


def base_number(rhythm: Column) -> Column:
    """Leading digits of the duration of a note or rest, NULL otherwise."""
    return F.nullif(F.regexp_extract(rhythm, r"^(?:note|rest)_(\d+)", 1), F.lit("")).cast("bigint")


def without_tuplet(rhythm: Column) -> Column:
    """Shorten a tuplet base to the plain one: thirds first, then fifths, then sevenths.

    Multi-rests count as tuplets too, and a zero base stays zero, as in the source material.
    """
    n = base_number(rhythm)
    plain = (
        F.when(n % 3 == 0, F.floor(n / 3) * 2)
        .when(n % 5 == 0, F.floor(n / 5) * 4)
        .when(n % 7 == 0, F.floor(n / 7) * 4)
    )
    rebuilt = F.concat(
        F.regexp_extract(rhythm, r"^(note|rest)_", 1),
        F.lit("_"),
        plain.cast("string"),
        F.regexp_extract(rhythm, r"^(?:note|rest)_\d+(.*)$", 1),
    )
    return F.when(plain.isNotNull(), rebuilt).otherwise(rhythm)


def is_tuplet(rhythm: Column) -> Column:
    return without_tuplet(rhythm) != rhythm


def prior_power_of_two(n: Column) -> Column:
    """Largest power of two not above n; 1 for everything below 1."""
    top_bit = F.pow(F.lit(2.0), F.length(F.bin(n)) - 1).cast("bigint")
    return F.when(n < 1, F.lit(1).cast("bigint")).otherwise(top_bit)


def duration_struct(kern: Column) -> Column:
    """kern duration text -> struct<base, dots, actual, normal, num, den> with num/den in lowest terms.

    A missing number means a quarter, ``G`` marks a grace note of length 0, 0 is a whole bar, a base that is no
    power of two is a tuplet over the next smaller one. A multi-rest (``4m``) reads its digits as a plain base.
    """
    digits = F.nullif(F.regexp_extract(kern, r"^(\d+)", 1), F.lit(""))
    base = F.coalesce(digits.cast("bigint"), F.lit(4).cast("bigint"))
    dots = F.length(kern) - F.length(F.replace(kern, F.lit("."), F.lit("")))
    grace = kern.contains("G")
    power = prior_power_of_two(base)
    plain = (base == 0) | grace | (base == power)
    normal = F.when(plain, F.lit(1).cast("bigint")).otherwise(power)
    actual = F.when(plain, F.lit(1).cast("bigint")).otherwise(base)
    # base duration 1/normal times normal/actual is 1/base for tuplets too; dots add (2^(d+1)-1)/2^d
    den_base = F.when(base == 0, F.lit(1).cast("bigint")).otherwise(base)
    dot_den = F.pow(F.lit(2.0), dots).cast("bigint")
    raw_num = F.when(grace, F.lit(0).cast("bigint")).otherwise(dot_den * 2 - 1)
    raw_den = F.when(grace, F.lit(1).cast("bigint")).otherwise(den_base * dot_den)
    # raw_num is odd or zero, so only odd factors can cancel: 3 (one dot) and 7 (two dots)
    cut = (
        F.when((raw_num == 3) & (raw_den % 3 == 0), F.lit(3))
        .when((raw_num == 7) & (raw_den % 7 == 0), F.lit(7))
        .when((raw_num == 15) & (raw_den % 15 == 0), F.lit(15))
        .when((raw_num == 15) & (raw_den % 5 == 0), F.lit(5))
        .when((raw_num == 15) & (raw_den % 3 == 0), F.lit(3))
        .otherwise(F.lit(1))
    )
    common = reduce_power(actual, normal)
    return F.struct(
        base.alias("base"),
        dots.alias("dots"),
        common.getField("num").alias("actual"),
        common.getField("den").alias("normal"),
        (raw_num / cut).cast("bigint").alias("num"),
        (raw_den / cut).cast("bigint").alias("den"),
    )


def reduce_power(num: Column, den: Column) -> Column:
    """Lowest terms of num/den where den is a power of two: divide by the lowest set bit the two share."""
    low = F.least(num.bitwiseAND(-num), den.bitwiseAND(-den))
    return F.struct((num / low).cast("bigint").alias("num"), (den / low).cast("bigint").alias("den"))


def duration_ticks(rhythm: Column) -> Column:
    """Exact length of a note or rest in ticks; NULL for every other token, 0 for grace notes."""
    digits = F.nullif(F.regexp_extract(rhythm, r"^(?:note|rest)_(\d*)", 1), F.lit(""))
    base = F.greatest(F.coalesce(digits.cast("double"), F.lit(4.0)), F.lit(1.0))
    dotted = F.lit(2.0) - F.pow(F.lit(2.0), F.length(F.replace(rhythm, F.lit("."), F.lit(""))) - F.length(rhythm))
    ticks = F.when(rhythm.contains("G"), F.lit(0.0)).otherwise(F.lit(float(TICKS_PER_WHOLE)) / base * dotted)
    return F.when(is_sounding(rhythm), ticks.cast("bigint"))


def diatonic_step(pitch: Column) -> Column:
    letter = F.regexp_extract(pitch, r"^([A-G])[#bN]*([0-9])$", 1)
    octave = F.regexp_extract(pitch, r"^([A-G])[#bN]*([0-9])$", 2)
    return F.when(letter != "", (octave.try_cast("int") * 7 + F.instr(F.lit(V.PITCH_LETTERS), letter) - 1).cast("int"))


def clef_anchor(rhythm: Column) -> Column:
    return diatonic_step(F.coalesce(literal_map(V.CLEF_MIDDLE_PITCH, rhythm), F.lit("")))


def key_fifths(name: Column) -> Column:
    return F.coalesce(literal_map(V.KEY_FIFTHS, name), F.lit(0))


def add_marks(value: Column, marks: Column) -> Column:
    """Union of the `_`-separated value with an array of marks, sorted and rejoined (duplicates kept)."""
    own = F.filter(F.split(value, "_"), lambda x: x != "")
    return F.array_join(F.array_sort(F.concat(marks, own)), "_")


def strip_marks(value: Column, marks: list[str]) -> Column:
    """Remove the given marks from the `_`-separated value; `_` when nothing is left."""
    kept = F.filter(F.split(value, "_"), lambda x: (x != "") & ~x.isin(marks))
    return F.when(F.size(kept) > 0, F.array_join(kept, "_")).otherwise(F.lit(V.EMPTY))


def without_unreliable(articulation: Column) -> Column:
    return F.when(articulation.isin(V.NOT_APPLICABLE, V.EMPTY), articulation).otherwise(
        strip_marks(articulation, V.UNRELIABLE_ARTICULATIONS)
    )


def without_natural(lift: Column) -> Column:
    return F.when(lift == "N", F.lit(V.EMPTY)).otherwise(lift)


def to_upper_staff(position: Column) -> Column:
    return F.when(position == "lower", F.lit("upper")).otherwise(position)
