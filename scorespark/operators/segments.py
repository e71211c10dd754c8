"""State along sequences of any length: two-level scans.

A window over a sequence sends the whole sequence to one task. Here a sequence is cut into blocks of consecutive positions.
Rows are folded per block into a small summary (combined before the shuffle where it is an aggregate), the summaries of a
sequence are scanned, and each block applies what it is handed over to its own rows, by a window over the block. A task
sorts blocks; only the scan of the summaries sees a whole sequence, one row per block.

Positions are integers, distinct within a sequence; ``size`` is the width of a block in positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tokens as T
from ..functions import vocabulary as V
from . import windows as N
from .chords import SEQ, signature_class

SIZE = 1 << 16
BLOCK = "_block"


def with_blocks(rows: DataFrame, by: str = "pos", size: int = SIZE) -> DataFrame:
    return rows.withColumn(BLOCK, F.floor(F.col(by) / size))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the keys and the block."""
    same = F.lit(True)
    for k in (*keys, BLOCK):
        same = same & left[k].eqNullSafe(right[f"_{k}"])
    return same


def _handed_over(rows: DataFrame, summary: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    right = summary.select(*[F.col(k).alias(f"_{k}") for k in (*keys, BLOCK)], *names)
    return rows.join(right, _same(rows, right, keys), "left").select(*[rows[c] for c in rows.columns], *[right[n] for n in names])


def last_before(rows: DataFrame, keys: Sequence[str], value: Column, name: str, by: str = "pos", inclusive: bool = False) -> DataFrame:
    """Adds ``name``: the last value that is not null before each row (or up to it). ``rows`` have blocks."""
    rows = rows.withColumn("_value", value)
    own = rows.where(F.col("_value").isNotNull()).groupBy(*keys, BLOCK).agg(F.max_by("_value", by).alias("_last"))
    places = rows.groupBy(*keys, BLOCK).agg(F.lit(1).alias("_one"))
    every = _handed_over(places, own, keys, ["_last"])
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    summary = every.withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier)).drop("_last", "_one")
    inside = W.partitionBy(*keys, BLOCK).orderBy(by).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    joined = _handed_over(rows, summary, keys, ["_carry"])
    return joined.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_carry"))).drop("_value", "_carry")


def running_sum(rows: DataFrame, keys: Sequence[str], value: Column, name: str, by: str = "pos") -> DataFrame:
    """Adds ``name``: the sum of the values up to each row. ``rows`` have blocks."""
    rows = rows.withColumn("_value", value)
    own = rows.groupBy(*keys, BLOCK).agg(F.sum("_value").alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    summary = own.withColumn("_carry", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*keys, BLOCK).orderBy(by)
    joined = _handed_over(rows, summary, keys, ["_carry"])
    return joined.withColumn(name, F.col("_carry") + F.sum("_value").over(inside)).drop("_value", "_carry")


# ---- the rules of the short forms, on long sequences ---------------------------------------------------------------


def carry_accidentals(tokens: DataFrame, keys: Sequence[str] = SEQ, size: int = SIZE) -> DataFrame:
    """As ``chords.carry_accidentals``: sounding lift of each note under the last explicit one of its pitch in its bar."""
    explicit = F.when(F.col("lift").isin("#", "b", "N"), F.col("lift"))
    barred = running_sum(with_blocks(tokens, size=size), keys, F.col("rhythm").contains("barline").cast("int"), "_bar")
    held = last_before(barred, [*keys, "_bar", "pitch"], explicit, "_held")
    lift = (
        F.when(F.col("lift") == V.NOT_APPLICABLE, F.col("lift"))
        .when(explicit.isNotNull(), explicit)
        .when(F.col("_held").isin("#", "b"), F.col("_held"))
        .otherwise(F.lit(V.EMPTY))
    )
    return held.withColumn("lift", lift).drop("_bar", "_held", BLOCK)


def ledger_lines(tokens: DataFrame, keys: Sequence[str] = SEQ, size: int = SIZE) -> DataFrame:
    """As ``chords.ledger_lines``: ledger lines of each note under the clef in force on its staff."""
    anchor = F.when(F.col("rhythm").startswith("clef"), T.clef_anchor(F.col("rhythm")))
    rows = with_blocks(tokens, size=size)
    staffs = {"_upper": ("lower", "clef_G2"), "_lower": ("upper", "clef_F4")}
    for name, (other, _) in staffs.items():
        rows = last_before(rows, keys, F.when(F.col("position") != other, anchor), name, inclusive=True)
    upper, lower = (F.coalesce(name, T.diatonic_step(F.lit(V.CLEF_MIDDLE_PITCH[clef]))) for name, (_, clef) in staffs.items())
    distance = F.abs(T.diatonic_step(F.col("pitch")) - F.when(F.col("position") == "lower", lower).otherwise(upper))
    lines = F.greatest(F.lit(0), F.floor((distance - 3) / 2)).cast("int")
    return rows.withColumn("ledger", F.when(F.col("rhythm").startswith("note") & distance.isNotNull(), lines)).drop(*staffs, BLOCK)


def max_ledger_lines(tokens: DataFrame, keys: Sequence[str] = SEQ, size: int = SIZE) -> DataFrame:
    return ledger_lines(tokens, keys, size).groupBy(*keys).agg(F.coalesce(F.max("ledger"), F.lit(0)).alias("max_ledger"))


def drop_redundant_signatures(tokens: DataFrame, keys: Sequence[str] = SEQ, size: int = SIZE) -> DataFrame:
    """As ``chords.drop_redundant_signatures``: only signatures that change something stay."""
    kind = signature_class(F.col("rhythm"), F.col("position"))
    rows = with_blocks(tokens, size=size).withColumn("_class", kind)
    signed = last_before(rows.where("_class IS NOT NULL"), [*keys, "_class"], F.col("rhythm"), "_before")
    changed = signed.where(~F.col("rhythm").eqNullSafe(F.col("_before"))).select(*rows.columns)
    return rows.where("_class IS NULL").unionByName(changed).drop("_class", BLOCK)


def carry_signatures(tokens: DataFrame, keys: Sequence[str] = SEQ, document: str = "doc", size: int = SIZE) -> DataFrame:
    """As ``windows.carry_signatures``: signatures of concatenated documents that change something, defaults included."""
    keys = list(keys)
    first_note = tokens.groupBy(*keys, document).agg(F.min(F.when(T.is_sounding(F.col("rhythm")), F.col("pos"))).alias("_first"))
    signs = tokens.select(*keys, document, "pos", N.signature_kind(F.col("rhythm")).alias("kind"), "rhythm").where("kind IS NOT NULL")
    opened = signs.join(first_note, [*keys, document], "left").withColumn("_open", F.coalesce(F.col("pos") < F.col("_first"), F.lit(True))).drop("_first")
    starts = tokens.groupBy(*keys).agg(F.min(document).alias(document))
    default = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rhythm")) for k, r in N.DEFAULT_SIGNATURES.items()]))
    defaults = starts.select(*keys, document, default.alias("_d")).select(
        *keys, document, F.lit(-1).cast(tokens.schema["pos"].dataType).alias("pos"), "_d.*", F.lit(True).alias("_open")
    )
    both = opened.unionByName(defaults)
    latest = both.where("_open").groupBy(*keys, document, "kind").agg(F.max("pos").alias("_latest"))
    counted = both.join(latest, [*keys, document, "kind"], "left").where(~F.col("_open") | (F.col("pos") == F.col("_latest")))
    before = last_before(with_blocks(counted, size=size), [*keys, "kind"], F.col("rhythm"), "_before")
    return before.where(~F.col("rhythm").eqNullSafe(F.col("_before"))).select(*keys, document, "pos", "kind", "rhythm")


def _clock_step(acc: Column, row: Column) -> Column:
    """What a row does to the clock and to the onset of the chord head, both written relative to the state the block is
    entered in. ``cur`` and ``head`` hold for an entry with a head, (from_head, add); ``bare`` and ``bare_head`` for one
    without, where everything is relative to the clock."""
    kind, d = row["kind"], row["d"]
    linear = F.when(kind.isin("symbol", "bar"), F.lit(1)).when(kind == "clef", F.lit(0)).otherwise(d)
    offset = F.when(kind == "symbol", F.lit(1)).when(kind == "bar", F.lit(2)).otherwise(F.lit(0))
    heads, chord = row["heads"], kind == "chord"

    def moved(state: Column, by: Column) -> Column:
        return F.struct(state["of_head"].alias("of_head"), (state["add"] + by).alias("add"))

    cur = F.when(chord, moved(acc["head"], d)).otherwise(moved(acc["cur"], linear))
    head = F.when(heads, moved(acc["cur"], offset)).otherwise(acc["head"])
    bare = F.when(chord, F.coalesce(acc["bare_head"], acc["bare"]) + d).otherwise(acc["bare"] + linear)
    bare_head = F.when(heads, acc["bare"] + offset).otherwise(acc["bare_head"])
    return F.struct(cur.alias("cur"), head.alias("head"), bare.alias("bare"), bare_head.alias("bare_head"))


def _clock_scan(acc: Column, block: Column) -> Column:
    """Clock and head after a block; keeps the state before each block."""
    cur, head = acc["cur"], acc["head"]
    place = lambda s: F.when(s["of_head"], head).otherwise(cur) + s["add"]
    f = block["f"]
    after_cur = F.when(head.isNull(), cur + f["bare"]).otherwise(place(f["cur"]))
    after_head = F.when(head.isNull(), cur + f["bare_head"]).otherwise(place(f["head"]))
    entered = F.struct(block[BLOCK].alias(BLOCK), cur.alias("cur"), head.alias("head"))
    return F.struct(after_cur.alias("cur"), after_head.alias("head"), F.concat(acc["out"], F.array(entered)).alias("out"))


def onsets(rows: DataFrame, keys: Sequence[str] = SEQ, size: int = SIZE) -> DataFrame:
    """As ``windows.onsets``: onset of each row from running durations, and whether the clock ran below zero in the sequence.

    A block is folded into two functions of the state it is entered in; their composition along the sequence gives every
    block's entry, which stands before its rows as up to three rows that set the clock and the head.
    """
    keys = list(keys)
    blocked = with_blocks(rows, size=size)
    heads = F.col("kind").isin("symbol", "bar", "clef") | ((F.col("kind") == "note") & F.col("visible"))
    at = lambda of_head: F.struct(F.lit(of_head).alias("of_head"), F.lit(0).cast("bigint").alias("add"))
    start = F.struct(at(False).alias("cur"), at(True).alias("head"), F.lit(0).cast("bigint").alias("bare"), F.lit(None).cast("bigint").alias("bare_head"))
    folded = blocked.groupBy(*keys, BLOCK).agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "kind", F.col("duration").cast("bigint").alias("d"), heads.alias("heads")))), start, _clock_step).alias("f")
    )
    state = F.struct(
        F.lit(0).cast("bigint").alias("cur"), F.lit(None).cast("bigint").alias("head"), F.array().cast(f"array<struct<{BLOCK}:bigint,cur:bigint,head:bigint>>").alias("out")
    )
    scanned = folded.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(F.struct(BLOCK, "f"))), state, _clock_scan, lambda a: a["out"]).alias("_out"))
    entries = scanned.select(*keys, F.inline("_out"))
    names = [c for c in blocked.columns if c not in (*keys, BLOCK, "pos", "kind", "duration", "visible")]

    def setting(n: int, kind: str, duration: Column) -> Column:
        return F.struct(F.lit(n).alias("_set"), F.lit(kind).alias("kind"), duration.alias("duration"))

    cur, head = F.col("cur"), F.col("head")
    sets = F.when(head.isNull(), F.array(setting(0, "move", cur))).otherwise(
        F.array(setting(0, "move", head), setting(1, "note", F.lit(0).cast("bigint")), setting(2, "move", cur - head))
    )
    settings = entries.select(*keys, BLOCK, F.explode(sets).alias("_s")).select(
        *keys, BLOCK, (F.col(BLOCK) * size - 3 + F.col("_s._set")).alias("pos"), "_s.kind", "_s.duration", F.lit(True).alias("visible"),
        *[F.lit(None).cast(blocked.schema[c].dataType).alias(c) for c in names], F.lit(True).alias("_setting"),
    )
    both = blocked.withColumns({"pos": F.col("pos").cast("bigint"), "duration": F.col("duration").cast("bigint"), "_setting": F.lit(False)}).unionByName(settings)
    timed = N.onsets(both, [*keys, BLOCK]).where("NOT _setting").drop("_setting")
    broken = timed.groupBy(*keys).agg(F.max("broken").alias("_broken"))
    right = broken.select(*[F.col(k).alias(f"_{k}") for k in keys], "_broken")
    same = F.lit(True)
    for k in keys:
        same = same & timed[k].eqNullSafe(right[f"_{k}"])
    out = timed.join(right, same).select(*[timed[c] for c in timed.columns if c not in ("broken", BLOCK)], right["_broken"].alias("broken"))
    return out.withColumn("pos", F.col("pos").cast(rows.schema["pos"].dataType))
