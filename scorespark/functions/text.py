"""Column expressions over raw text: sniffing, clean-up, naming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\u000b"


def left_stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+", "")


def is_xml(text: Column) -> Column:
    """An XML declaration, or a score as the first element; comments do not count, however long."""
    stripped = left_stripped(text)
    bare = left_stripped(F.regexp_replace(stripped, r"(?s)<!--.*?-->", ""))
    first = F.regexp_extract(bare, r"<([A-Za-z][^\s/>]*)", 1)
    return stripped.startswith("<?xml") | (bare.startswith("<") & (first == "score-partwise"))


def is_kern(text: Column) -> Column:
    """The first line that is no `!!` comment opens spines, one of them kern or the first of any kind."""
    line = F.regexp_extract(left_stripped(text), r"(?md)^([^!\n][^\n]*|!(?:[^!\n][^\n]*)?)$", 1)
    return line.startswith("**") | line.contains("\t**kern")


def is_tempo_marking(text: Column) -> Column:
    """Too short, or fewer than four ASCII letters: a tempo, not a title."""
    return (F.length(text) < 4) | (F.length(F.regexp_replace(text, "[^A-Za-z]", "")) < 4)


def clean_title(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[^A-Za-z0-9]+", " "))


def occurrences(text: Column, term: str) -> Column:
    removed = F.replace(text, F.lit(term), F.lit(""))
    return F.floor((F.length(text) - F.length(removed)) / len(term)).cast("int")


def camel_case(name: Column) -> Column:
    """inverted-mordent -> invertedMordent."""
    parts = F.split(name, "-")
    tail = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2))))
    return F.concat(F.element_at(parts, 1), F.array_join(tail, ""))


def hash_choice(key: Column, n: int) -> Column:
    """SHA-256 of the key as a number, mod n, for n dividing 15: 16 is 1 mod n, so the digit sum decides."""
    if 15 % n:
        raise ValueError("n must divide 15")
    digits = F.split(F.sha2(key, 256), "")
    total = F.aggregate(
        F.filter(digits, lambda c: c != ""), F.lit(0), lambda s, c: s + F.instr(F.lit("0123456789abcdef"), c) - 1
    )
    return total % n
