"""Mixing corpora: quotas, reproducible shuffles, splits, stratified samples, encoding to ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from . import ranking as R
from .chords import with_vocabulary_ids


def union_sources(sources: list[DataFrame], key: str = "key") -> DataFrame:
    """All rows of all sources in reproducible random order."""
    out = sources[0]
    for source in sources[1:]:
        out = out.unionByName(source)
    return out.orderBy(R.shuffle_key(F.col(key)), key)


def quotas(sizes: list[int], weights: list[float], wanted: int) -> list[int]:
    """Rows to take per source so that sources follow their weights as far as they last.

    Filling by weight, the source with the fewest rows per weight runs out first. Going through the sources in that order,
    one runs out if its rows are no more than its share of what is still to be filled; the first that lasts, and all after
    it, share the rest in proportion. Shares are cut to whole numbers and the remainder goes to the last sources with rows
    left. Sources without rows or weight give nothing.
    """
    usable = [i for i, size in enumerate(sizes) if size > 0 and weights[i] > 0]
    rest, weight, taken = wanted, sum(weights[i] for i in usable), [0] * len(sizes)
    by_scarcity = sorted(usable, key=lambda i: sizes[i] / weights[i])
    exhausted = 0
    for i in by_scarcity:
        if sizes[i] * weight > weights[i] * rest:
            break
        taken[i], rest, weight, exhausted = sizes[i], rest - sizes[i], weight - weights[i], exhausted + 1
    sharing = sorted(by_scarcity[exhausted:])
    for i in sharing:
        taken[i] = int(rest * weights[i] / weight)
    remainder = rest - sum(taken[i] for i in sharing)
    for i in reversed(sharing):
        more = min(remainder, sizes[i] - taken[i])
        taken[i], remainder = taken[i] + more, remainder - more
    return taken


def take_first(rows: DataFrame, source: str, key: str, limit: Column, digits: int = 3) -> DataFrame:
    """The first `limit` rows of each source in shuffle order, whatever the size of a source."""
    digest = R.shuffle_key(F.col(key))
    keyed = rows.withColumn("_d", digest)
    ranked = R.with_rank(keyed, [source], ["_d", key], R.hash_bucket(F.col("_d"), digits), "_rank")
    return ranked.where(F.col("_rank") <= limit).drop("_rank", "_d")


def mix_sources(rows: DataFrame, source: str, key: str, weights: dict[str, float], wanted) -> DataFrame:
    """Weighted mix of the sources named in `weights`.

    `wanted`: how many rows in all, a number or a function of the total (column in, column out); None takes all.
    Only one count per configured source reaches the driver.
    """
    names = list(weights)
    chosen = rows.where(F.col(source).isin(names))
    if wanted is None:
        return chosen
    sizes = {r[source]: r["n"] for r in chosen.groupBy(source).agg(F.count("*").alias("n")).collect()}
    goal = int(wanted) if isinstance(wanted, int) else chosen.sparkSession.range(1).select(
        wanted(F.lit(sum(sizes.values()))).cast("bigint")
    ).first()[0]
    take = dict(zip(names, quotas([sizes.get(n, 0) for n in names], [weights[n] for n in names], goal)))
    limit = F.coalesce(*[F.when(F.col(source) == n, F.lit(q)) for n, q in take.items()], F.lit(0))
    return take_first(chosen, source, key, limit)


def split_rows(rows: DataFrame, key: str, share: float, rounded: bool = False) -> DataFrame:
    """Adds split: the first share of the shuffled rows is `validation` (truncated, or rounded half to even)."""
    keyed = rows.withColumn("_d", R.shuffle_key(F.col(key)))
    ranked = R.with_rank(keyed, [], ["_d", key], R.hash_bucket(F.col("_d")), "_rank", "_all")
    size = F.col("_all") * share
    limit = F.bround(size) if rounded else F.floor(size)
    split = F.when(F.col("_rank") <= limit, F.lit("validation")).otherwise(F.lit("train"))
    return ranked.withColumn("split", split).drop("_d", "_rank", "_all")


def round_robin_sample(rows: DataFrame, strata, key: str, limit: int) -> DataFrame:
    """One row of each stratum in turn, in stratum order, until `limit` rows: order by (rank in stratum, stratum)."""
    keyed = rows.withColumn("_d", R.shuffle_key(F.col(key)))
    ranked = R.with_rank(keyed, strata, ["_d", key], R.hash_bucket(F.col("_d")), "turn_no")
    return ranked.where(F.col("turn_no") <= limit).orderBy("turn_no", *strata).limit(limit).drop("_d")


def _with_ids(tokens: DataFrame, keys) -> DataFrame:
    """One row per sequence: its id structs in order and the number of tokens that the vocabulary does not have."""
    known = F.lit(True)
    for f in V.TOKEN_FIELDS:
        known = known & F.col(f"{f}_id").isNotNull()
    packed = F.array_sort(F.collect_list(F.struct("pos", *[f"{f}_id" for f in V.TOKEN_FIELDS])))
    return with_vocabulary_ids(tokens).groupBy(*keys).agg(packed.alias("_t"), F.count_if(~known).alias("_unknown"))


def encode_sequences(tokens: DataFrame, keys=("seq_id",), length: int = V.MAX_SEQUENCE_LENGTH) -> DataFrame:
    """One row per sequence: six id arrays framed by begin and end tokens and padded to `length`, and their true length.

    Longer sequences are encoded whole (the length filter is a step of its own); those with unknown tokens are left to
    :func:`encoding_rejects`.
    """
    rows = _with_ids(tokens, keys).where("_unknown = 0")
    begin, end = V.CONTROL_TOKENS.index("BOS"), V.CONTROL_TOKENS.index("EOS")

    def framed(field: str) -> Column:
        first, last = (begin, end) if field == "rhythm" else (0, 0)
        whole = F.concat(F.array(F.lit(first)), F.col("_t").getField(f"{field}_id"), F.array(F.lit(last)))
        return F.concat(whole, F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(length) - F.size(whole)))).alias(field)

    return rows.select(*keys, *[framed(f) for f in V.TOKEN_FIELDS], (F.size("_t") + 2).alias("mask_length"))


def encoding_rejects(tokens: DataFrame, keys=("seq_id",)) -> DataFrame:
    """(keys, reason) of the sequences that cannot be encoded."""
    bad = _with_ids(tokens, keys).where("_unknown > 0")
    return bad.select(*keys, F.concat(F.col("_unknown").cast("string"), F.lit(" tokens are not in the vocabulary")).alias("reason"))


def branch_accuracy(pairs: DataFrame, fields, positional: Column) -> DataFrame:
    """Correct / total per branch over rows where the label counts, and over all branches together.

    pairs: label_<field>, pred_<field>; a NULL label or `.` is masked. Pitch is also split by whether the rhythm
    carries a position. Sums combine map-side.
    """
    def row(name: str, field: str, keep: Column) -> Column:
        label, pred = F.col(f"label_{field}"), F.col(f"pred_{field}")
        return F.struct(
            F.lit(name).alias("branch"), (label == pred).cast("int").alias("hit"),
            (keep & label.isNotNull() & pred.isNotNull()).alias("counts"),
        )

    rows = [row(f, f, F.lit(True)) for f in fields]
    rows += [row("pitch_positional", "pitch", positional), row("pitch_other", "pitch", ~positional)]
    long = pairs.select(F.inline(F.array(*rows))).where("counts")
    per = long.groupBy("branch").agg(F.sum("hit").alias("correct"), F.count("*").alias("total"))
    overall = per.where(F.col("branch").isin(list(fields))).agg(
        F.lit("all").alias("branch"), F.sum("correct").alias("correct"), F.sum("total").alias("total")
    )
    return per.unionByName(overall).withColumn("accuracy", F.col("correct") / F.col("total"))


def confusion(rows: DataFrame, group: str, pred: str, label: str) -> DataFrame:
    """True / false positives and false negatives per class, and micro IoU per group and over everything."""
    sides = F.array(F.struct(F.col(pred).alias("cls"), F.lit("p").alias("side")), F.struct(F.col(label).alias("cls"), F.lit("l").alias("side")))
    same = F.col(pred) == F.col(label)
    long = rows.select(group, same.alias("same"), F.explode(sides).alias("_s")).select(group, "same", "_s.*")
    counts = long.rollup(group, "cls").agg(
        F.count_if(F.col("same") & (F.col("side") == "p")).alias("tp"),
        F.count_if(~F.col("same") & (F.col("side") == "p")).alias("fp"),
        F.count_if(~F.col("same") & (F.col("side") == "l")).alias("fn"),
    )
    return counts.withColumn("iou", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp") + F.col("fn")))
