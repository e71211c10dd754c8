"""Scoring predictions against the truth: token edit distance, part assignment, alignment events.

A sample (one page or one turn) is the unit of work; its token lists live in one row, and rows spread over all tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from ..functions import vocabulary as V
from . import alignment


def encode(tokens: Column, dictionary: Column) -> Column:
    """An array of tokens as a string of one character per token, so that character distance is token distance.

    Codes start at U+10000: room for a million distinct tokens in one sample.
    """
    codes = F.transform(
        tokens, lambda t: F.lpad(F.hex(F.array_position(dictionary, t) + 0x10000), 8, "0")
    )
    return F.decode(F.unhex(F.array_join(codes, "")), "UTF-32")


def let(value: Column, body) -> Column:
    """Bind a value once inside an expression: a lambda body would recompute an outer expression per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def token_distance(expected: Column, actual: Column) -> Column:
    """Levenshtein distance between two token arrays."""
    return let(
        F.struct(expected.alias("e"), actual.alias("a")),
        lambda p: let(
            F.array_distinct(F.concat(p["e"], p["a"])),
            lambda d: F.levenshtein(encode(p["e"], d), encode(p["a"], d)),
        ),
    )


def normalised(distance: Column, expected_len: Column, actual_len: Column) -> Column:
    return distance / F.greatest(expected_len + actual_len, F.lit(1))


def collect_parts(tokens: DataFrame, sample: str, side: Column, part: Column, order: str, fields) -> DataFrame:
    """Token rows -> one row per sample with `expected` and `actual`: arrays of parts, each an array of tokens.

    One shuffle: hashing on the sample serves both grouping levels.
    """
    rows = tokens.select(
        sample, side.alias("_side"), part.alias("_part"), F.col(order).alias("_o"), F.struct(*fields).alias("_t")
    ).repartition(sample)
    parts = rows.groupBy(sample, "_side", "_part").agg(
        F.array_sort(F.collect_list(F.struct("_o", "_t"))).getField("_t").alias("_tokens")
    )

    def parts_of(name: str) -> Column:
        own = F.collect_list(F.when(F.col("_side") == name, F.struct("_part", "_tokens")))
        return F.array_sort(own).getField("_tokens").alias(name)

    return parts.groupBy(sample).agg(parts_of("expected"), parts_of("actual"))


def pad_parts(samples: DataFrame) -> DataFrame:
    """Pad both sides with empty parts to the same number (at least one)."""
    n = F.greatest(F.size("expected"), F.size("actual"), F.lit(1))
    empty = F.filter(F.flatten(F.col("expected")), lambda _: F.lit(False))

    def padded(name: str) -> Column:
        return F.concat(F.col(name), F.array_repeat(empty, F.col("n_parts") - F.size(name))).alias(name)

    out = samples.withColumn("n_parts", n)
    rest = [c for c in out.columns if c not in ("expected", "actual")]
    return out.select(*rest, padded("expected"), padded("actual"))


def _field_text(tokens: Column, fields) -> Column:
    return F.transform(tokens, lambda t: F.concat_ws(" ", *[t.getField(f) for f in fields]))


def _encoded_parts(parts: Column, fields, dictionary: Column) -> Column:
    return F.transform(parts, lambda p: encode(_field_text(p, fields), dictionary))


@F.pandas_udf(TY.ArrayType(TY.IntegerType()))
def assign_parts(costs: pd.Series) -> pd.Series:
    """Cheapest assignment of each cost matrix, the first in lexicographic order on ties."""
    return costs.map(_assignment)


def _assignment(cost) -> list[int]:
    """Shortest augmenting paths give a cheapest assignment and prices under which every cheapest one uses only tight
    cells (cost = row price + column price). Among the tight ones the first in lexicographic order is taken."""
    n = len(cost)
    row_price, column_price = [0] * n, [0] * n
    row_of: list[int | None] = [None] * n
    for start in range(n):
        slack, came, done = [None] * n, [None] * n, [False] * n
        row, last = start, None
        while True:
            for j in range(n):
                if not done[j]:
                    left = int(cost[row][j]) - row_price[row] - column_price[j]
                    if slack[j] is None or left < slack[j]:
                        slack[j], came[j] = left, last
            column = min((j for j in range(n) if not done[j]), key=lambda j: slack[j])
            step = slack[column]
            row_price[start] += step
            for j in range(n):
                if done[j]:
                    row_price[row_of[j]] += step
                    column_price[j] -= step
                elif slack[j] is not None:
                    slack[j] -= step
            done[column], last = True, column
            if row_of[column] is None:
                break
            row = row_of[column]
        while column is not None:
            before = came[column]
            row_of[column] = start if before is None else row_of[before]
            column = before
    tight = [[j for j in range(n) if cost[i][j] == row_price[i] + column_price[j]] for i in range(n)]
    chosen = [0] * n
    for j, i in enumerate(row_of):
        chosen[i] = j
    fixed: set[int] = set()

    def move(i: int, taken: set[int], free: int) -> bool:
        """Give row ``i`` another tight column, moving other rows on; ``free`` is the one column without a row."""
        for j in tight[i]:
            if j in taken:
                continue
            taken.add(j)
            if j == free or move(chosen.index(j), taken, free):
                chosen[i] = j
                return True
        return False

    for i in range(n):
        for j in tight[i]:
            if j in fixed:
                continue
            if j == chosen[i]:
                break
            kept, other, free = list(chosen), chosen.index(j), chosen[i]
            chosen[i] = -1
            if move(other, fixed | {j}, free):
                chosen[i] = j
                break
            chosen[:] = kept
        fixed.add(chosen[i])
    return chosen


def align_parts(samples: DataFrame, fields=V.SCORED_FIELDS) -> DataFrame:
    """Adds cost (matrix of token distances) and perm: the actual part that belongs to each expected part."""
    padded = pad_parts(samples)
    everything = _field_text(F.flatten(F.concat("expected", "actual")), fields)
    coded = (
        padded.withColumn("_dict", F.array_distinct(everything))
        .withColumn("_e", _encoded_parts(F.col("expected"), fields, F.col("_dict")))
        .withColumn("_a", _encoded_parts(F.col("actual"), fields, F.col("_dict")))
    )
    cost = F.transform(F.col("_e"), lambda e: F.transform(F.col("_a"), lambda a: F.levenshtein(e, a)))
    return coded.withColumn("cost", cost).withColumn("perm", assign_parts("cost")).drop("_dict", "_e", "_a")


def matched_parts(aligned: DataFrame, keep) -> DataFrame:
    """One row per aligned part: part, matched, cost and both token arrays."""
    part = F.posexplode(F.arrays_zip("expected", "cost", "perm"))
    rows = aligned.select(*keep, "n_parts", "actual", part.alias("part", "_z"))
    j = F.col("_z.perm")
    return rows.select(
        *keep,
        "n_parts",
        "part",
        j.alias("matched"),
        F.element_at("_z.cost", j + 1).alias("cost"),
        F.col("_z.expected").alias("expected"),
        F.element_at("actual", j + 1).alias("actual"),
    )


def part_name(part: Column, n_parts: Column) -> Column:
    return (
        F.when((n_parts == 2) & (part == 0), F.lit("upper"))
        .when(n_parts == 2, F.lit("lower"))
        .otherwise(F.concat(F.lit("part_"), part.cast("string")))
    )


def score_samples(samples: DataFrame, sample: str, fields=V.SCORED_FIELDS) -> DataFrame:
    """Normalised edit distance per sample with the component scores; all share the total length as denominator."""
    aligned = align_parts(samples, fields)
    in_order = F.transform("perm", lambda j: F.element_at("actual", j + 1))
    paired = aligned.withColumn("_pairs", F.arrays_zip(F.col("expected").alias("e"), in_order.alias("a")))
    distance = F.aggregate(
        F.zip_with("perm", "cost", lambda j, row: F.element_at(row, j + 1)), F.lit(0), lambda s, x: s + x
    )
    total = {
        side: F.aggregate(F.transform(side, F.size), F.lit(0), lambda s, x: s + x) for side in ("expected", "actual")
    }

    def component(field: str) -> Column:
        parts = F.transform(
            "_pairs",
            lambda p: token_distance(
                F.transform(p["e"], lambda t: t.getField(field)), F.transform(p["a"], lambda t: t.getField(field))
            ),
        )
        return F.aggregate(parts, F.lit(0), lambda s, x: s + x)

    measured = paired.select(
        sample,
        distance.alias("distance"),
        total["expected"].alias("expected_len"),
        total["actual"].alias("actual_len"),
        *[component(f).alias(f"_{f}") for f in fields],
    )
    lengths = F.col("expected_len"), F.col("actual_len")
    return measured.select(
        sample,
        normalised(F.col("distance"), *lengths).alias("ned"),
        "distance",
        "expected_len",
        "actual_len",
        *[normalised(F.col(f"_{f}"), *lengths).alias(f"{f}_ned") for f in fields],
    )


# ---- alignment events ----------------------------------------------------------------------------------------------


def alignment_events(parts: DataFrame, keep, fields=V.SCORED_FIELDS) -> DataFrame:
    """Matched parts as match / substitute / delete / insert rows.

    The matching is by longest common blocks of whole tokens, so the number of errors need not equal the edit distance.
    """
    texts = parts.withColumns({"_e": _field_text(F.col("expected"), fields), "_a": _field_text(F.col("actual"), fields)})
    rows = alignment.aligned(texts, [*keep, "part"], "_e", "_a")
    exp = F.try_element_at("expected", F.col("i") + 1)
    act = F.try_element_at("actual", F.col("j") + 1)
    return rows.select(
        *keep,
        "part",
        "event_no",
        part_name(F.col("part"), F.col("n_parts")).alias("staff"),
        "event_type",
        *[exp.getField(f).alias(f"exp_{f}") for f in fields],
        *[act.getField(f).alias(f"act_{f}") for f in fields],
    )


def weighted_difference(key_distance: Column, note_distance: Column) -> Column:
    """A wrong key counts ten times a wrong note."""
    return key_distance * 10 + note_distance
