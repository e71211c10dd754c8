"""Corpus filters: per-token rules, per-sequence rules, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tokens as T
from ..functions import vocabulary as V
from . import chords as C

SEQ = ("seq_id",)


def unknown_fields() -> Column:
    """Names of the fields whose value is not in its vocabulary, comma-separated; '' when all are known.

    Constant sets, checked in the scan: no join, no shuffle.
    """
    return F.concat_ws(",", *[F.when(~F.col(f).isin(tokens), F.lit(f)) for f, tokens in V.branch_tokens().items()])


def known_symbol() -> Column:
    checks = [F.col(f).isin(tokens) for f, tokens in V.branch_tokens().items()]
    result = checks[0]
    for check in checks[1:]:
        result = result & check
    return result


def rejection_reason() -> Column:
    """NULL for a good token, otherwise why it is bad."""
    return F.when(~known_symbol(), F.lit("invalid symbol")).when(~T.is_valid_combination(), F.lit("invalid combination"))


def quarantine(tokens: DataFrame, keys=SEQ) -> tuple[DataFrame, DataFrame]:
    """(accepted tokens, rejected sequences with first reason). One bad token rejects its sequence."""
    tagged = tokens.withColumn("_reason", rejection_reason())
    rejected = tagged.groupBy(*keys).agg(
        F.min_by("_reason", F.when(F.col("_reason").isNotNull(), F.col("pos"))).alias("reason"),
        F.count("_reason").alias("bad_tokens"),
    ).where("bad_tokens > 0")
    return tokens.join(rejected.select(*keys), list(keys), "left_anti"), rejected


def keep_sequences(tokens: DataFrame, condition: Column, keys=SEQ) -> DataFrame:
    """Sequences whose aggregate condition holds, as a table of their keys."""
    return tokens.groupBy(*keys).agg(condition.alias("_keep")).where("_keep").select(*keys)


def max_length(tokens: DataFrame, keys=SEQ, limit: int = V.MAX_SEQUENCE_LENGTH - 2) -> DataFrame:
    return keep_sequences(tokens, F.count("*") <= limit, keys)


def max_ledger(tokens: DataFrame, keys=SEQ, limit: int = V.MAX_LEDGER_LINES) -> DataFrame:
    return C.max_ledger_lines(tokens, keys).where(F.col("max_ledger") <= limit).select(*keys)


def tuplet_ratio(rhythm: str = "rhythm") -> Column:
    return F.avg(T.is_tuplet(F.col(rhythm)).cast("int"))


def balanced_slurs() -> Column:
    starts = F.count_if(F.col("slur").contains("slurStart"))
    return starts == F.count_if(F.col("slur").contains("slurStop"))


def contains_any(text: Column, terms: list[str]) -> Column:
    """True when a term of a configured list occurs in the text."""
    return F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: text.contains(t))


def without_groups(rows: DataFrame, bad: Column, keys) -> DataFrame:
    """Drop every group with a bad row. Two passes with map-side combine, so the group size does not matter."""
    rejected = rows.where(bad).select(*keys).distinct()
    return rows.join(rejected, list(keys), "left_anti")


def within_mean_angle(angle: Column, group: list[str], tolerance: float = 10.0) -> DataFrame:
    """Column: the angle is within tolerance of the mean of its group."""
    return F.abs(angle - F.avg(angle).over(W.partitionBy(*group))) <= tolerance
