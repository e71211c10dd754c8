"""Token alignment by longest matching blocks, as rows: match, substitute, delete and insert events.

Rule: the longest run of equal tokens is matched (of runs as long, the one first in the truth, then first in the
prediction), then the rule applies again to what lies before it on both sides and to what lies after it. Between matched
blocks the tokens left over are paired off one by one; what one side has more of is deleted or inserted.

Plan: equal tokens meet in an equi-join; on each diagonal (index in the truth minus index in the prediction) consecutive
hits are one run, found once by a window. The work list is a table of runs, each in the open block it lies in. A round
finds the best run of every open block by a window and cuts the other runs into their parts before and after it. All
rounds share one partitioning by pair, so a round is a sort and no shuffle; the loop ends when no run is open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

ROUNDS = 4  # between two checkpoints
KEY = "_key"


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def common_runs(pairs: DataFrame, expected: str, actual: str) -> DataFrame:
    """Longest runs of equal tokens on every diagonal: diagonal, first and last index in the truth, in an open block that
    is the whole pair. Partitioned by pair."""
    left = pairs.select(KEY, F.posexplode(expected).alias("i", "_token"))
    right = pairs.select(KEY, F.posexplode(actual).alias("j", "_token"))
    hits = left.join(right, [KEY, "_token"]).select(KEY, (F.col("i") - F.col("j")).alias("diagonal"), "i").repartition(KEY)
    run = F.col("i") - F.row_number().over(W.partitionBy(KEY, "diagonal").orderBy("i"))
    runs = hits.withColumn("_run", run).groupBy(KEY, "diagonal", "_run").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    return runs.select(KEY, F.lit(0).alias("block_i"), F.lit(0).alias("block_j"), "diagonal", "first", "last", F.lit(False).alias("matched"))


def settle(runs: DataFrame) -> DataFrame:
    """One round. The best run of each open block becomes a match; of every other run what lies before the match on both
    sides stays in the block, and what lies after it on both sides goes to the block that starts there."""
    first, last, diagonal = F.col("first"), F.col("last"), F.col("diagonal")
    block = W.partitionBy(KEY, "block_i", "block_j", "matched")
    best = F.max(F.struct((last - first + 1).alias("size"), (-first).alias("i"), diagonal.alias("d"))).over(block)
    ranked = runs.withColumn("_best", best)
    at_i = -F.col("_best.i")
    at_j, after_i = at_i - F.col("_best.d"), at_i + F.col("_best.size")
    after_j = at_j + F.col("_best.size")

    def row(block_i: Column, block_j: Column, start: Column, end: Column, matched: bool) -> Column:
        return F.struct(
            block_i.alias("block_i"), block_j.alias("block_j"), diagonal.alias("diagonal"), start.alias("first"), end.alias("last"),
            F.lit(matched).alias("matched"),
        )

    end, start = F.least(last, at_i - 1, at_j - 1 + diagonal), F.greatest(first, after_i, after_j + diagonal)
    won = (first == at_i) & (diagonal == F.col("_best.d"))
    rows = F.array_compact(
        F.array(
            F.when(F.col("matched") | won, row(first, first - diagonal, first, last, True)),
            F.when(~F.col("matched") & (first <= end), row(F.col("block_i"), F.col("block_j"), first, end, False)),
            F.when(~F.col("matched") & (start <= last), row(after_i, after_j, start, last, False)),
        )
    )
    return ranked.select(KEY, F.inline(rows))


def matching_blocks(pairs: DataFrame, keys: Sequence[str], expected: str, actual: str) -> DataFrame:
    """Keys (unique per row of ``pairs``, nulls allowed) and the matched blocks as rows i, j, size. Token arrays may be null
    or empty: no block; a null token equals nothing."""
    keyed = pairs.select(F.struct(*keys).alias(KEY), expected, actual)
    runs = common_runs(keyed, expected, actual)
    while True:
        for _ in range(ROUNDS):
            runs = settle(runs)
        runs = cut(runs)
        if runs.where(~F.col("matched")).isEmpty():
            break
        runs = runs.repartition(KEY)
    return runs.select(
        *[F.col(f"{KEY}.{k}").alias(k) for k in keys],
        F.col("first").alias("i"), (F.col("first") - F.col("diagonal")).alias("j"), (F.col("last") - F.col("first") + 1).alias("size"),
    )


def _count(n: Column) -> Column:
    """0, 1, .. n - 1; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _events(blocks: Column, n_expected: Column, n_actual: Column) -> Column:
    """Blocks of one pair, in order, as an array of event_type and indices."""
    every = F.concat(blocks, F.array(F.struct(n_expected.alias("i"), n_actual.alias("j"), F.lit(0).alias("size"))))

    def event(kind: str | Column, i: Column, j: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("event_type"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    def of_block(block: Column, k: Column) -> Column:
        before = F.get(every, k - 1)
        i, j = F.coalesce(before["i"] + before["size"], F.lit(0)), F.coalesce(before["j"] + before["size"], F.lit(0))
        more_i, more_j = block["i"] - i, block["j"] - j
        kind = lambda x: F.when(x >= more_i, "insert").when(x >= more_j, "delete").otherwise("substitute")
        gap = F.transform(_count(F.greatest(more_i, more_j)), lambda x: event(kind(x), F.when(x < more_i, i + x), F.when(x < more_j, j + x)))
        return F.concat(gap, F.transform(_count(block["size"]), lambda x: event("match", block["i"] + x, block["j"] + x)))

    return F.flatten(F.transform(every, of_block))


def aligned(pairs: DataFrame, keys: Sequence[str], expected: str, actual: str) -> DataFrame:
    """``pairs`` with its events: event_no, event_type, i and j (index on either side; null where the side has no token).

    ``pairs`` is written to the checkpoint folder once. A pair of two empty sides has no events.
    """
    pairs = cut(pairs)
    blocks = matching_blocks(pairs, keys, expected, actual)
    lists = blocks.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(F.array_sort(F.collect_list(F.struct("i", "j", "size"))).alias("_blocks"))
    same = F.lit(True)
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    found = pairs.join(lists, same, "left")
    none = F.array().cast("array<struct<i:int,j:int,size:int>>")
    events = _events(F.coalesce("_blocks", none), F.coalesce(F.size(expected), F.lit(0)), F.coalesce(F.size(actual), F.lit(0)))
    return found.select(*pairs.columns, F.posexplode(events).alias("event_no", "_event")).select(*pairs.columns, "event_no", "_event.*")
