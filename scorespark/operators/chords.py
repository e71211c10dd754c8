"""Grouping tokens into chords and measures, and the state carried along a sequence.

A sequence is one staff window of a score: bounded by the ingest (`filters.max_length`), so a window over a sequence
is a small sort. All windows here share the partition key, so a chain of them needs one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import tokens as T
from ..functions import vocabulary as V

SEQ = ("seq_id",)


def ordered(*keys: str, by: str = "pos") -> WindowSpec:
    return W.partitionBy(*keys).orderBy(by)


def group_chords(tokens: DataFrame, keys=SEQ) -> DataFrame:
    """Fold `chord` markers: adds chord_id (from 0) and member (from 1), drops the marker rows.

    A marker before the first symbol has nothing to glue to and stays pending, so it glues the second symbol.
    """
    w = ordered(*keys)
    marked = tokens.withColumn("_marked", F.coalesce(F.lag(F.col("rhythm") == "chord").over(w), F.lit(False)))
    kept = marked.where("rhythm != 'chord'").withColumn("_n", F.row_number().over(w))
    pending = (F.col("_n") == 2) & F.lag("_marked").over(w)
    starts = (F.col("_n") == 1) | ~(F.col("_marked") | pending)
    return (
        kept.withColumn("_starts", starts)
        .withColumn("chord_id", F.sum(F.col("_starts").cast("int")).over(w).cast("int") - 1)
        .withColumn("member", F.row_number().over(ordered(*keys, "chord_id")))
        .drop("_marked", "_n", "_starts")
    )


def group_measures(chords: DataFrame, keys=SEQ) -> DataFrame:
    """Adds measure (from 0): a measure closes after a chord whose first member is a bar line or repeat."""
    w = ordered(*keys)
    closes = ((F.col("member") == 1) & T.is_measure_end(F.col("rhythm"))).cast("int")
    return (
        chords.withColumn("_closes", closes)
        .withColumn("_own", F.max("_closes").over(W.partitionBy(*keys, "chord_id")))
        .withColumn("measure", (F.sum("_closes").over(w) - F.col("_own")).cast("int"))
        .drop("_closes", "_own")
    )


def flatten_chords(chords: DataFrame) -> DataFrame:
    """Inverse of group_chords: a marker row before every member after the first. `slot` orders row and marker."""
    fields = V.TOKEN_FIELDS
    marker = F.struct(F.lit(0).alias("slot"), F.lit("chord").alias("rhythm"), *[F.lit(".").alias(f) for f in fields[1:]])
    row = F.struct(F.lit(1).alias("slot"), *[F.col(f).alias(f) for f in fields])
    out = F.when(F.col("member") > 1, F.array(marker, row)).otherwise(F.array(row))
    rest = [c for c in chords.columns if c not in fields]
    return chords.select(*rest, F.explode(out).alias("_t")).select(*rest, "_t.*")


def sort_within_chords(chords: DataFrame, keys=SEQ) -> DataFrame:
    """Adds rank: members of a chord in descending order of their text."""
    w = W.partitionBy(*keys, "chord_id").orderBy(T.token_text().desc(), F.col("member"))
    return chords.withColumn("rank", F.row_number().over(w))


def drop_repeated_pitches(chords: DataFrame, keys=SEQ, longest: bool = False) -> DataFrame:
    """One note per (pitch, position) in chords that open with a note or rest: the first, or the longest."""
    first = F.min_by("rhythm", "member").over(W.partitionBy(*keys, "chord_id"))
    order = [F.col("member")]
    if longest:
        order.insert(0, T.duration_ticks(F.col("rhythm")).desc())
    rank = F.row_number().over(W.partitionBy(*keys, "chord_id", "pitch", "position").orderBy(*order))
    return (
        chords.withColumn("_first", first)
        .withColumn("_rank", rank)
        .where((F.col("_rank") == 1) | ~T.is_sounding(F.col("_first")))
        .drop("_first", "_rank")
    )


def signature_class(rhythm: Column, position: Column) -> Column:
    return (
        F.when(rhythm.startswith("clef") & (position == "upper"), F.lit("clef_upper"))
        .when(rhythm.startswith("clef"), F.lit("clef_lower"))
        .when(rhythm.startswith("keySignature"), F.lit("key"))
        .when(rhythm.startswith("timeSignature"), F.lit("time"))
    )


def drop_redundant_signatures(tokens: DataFrame, keys=SEQ) -> DataFrame:
    """Keep a clef (per staff), key or time only where it differs from the last one of its class."""
    before = F.lag("rhythm").over(ordered(*keys, "_class"))
    return (
        tokens.withColumn("_class", signature_class(F.col("rhythm"), F.col("position")))
        .withColumn("_before", before)
        .where(F.col("_class").isNull() | ~F.col("rhythm").eqNullSafe(F.col("_before")))
        .drop("_class", "_before")
    )


def collapse_adjacent_keys(tokens: DataFrame, keys=SEQ) -> DataFrame:
    """Drop a key signature that equals the token right before it."""
    return (
        tokens.withColumn("_before", F.lag("rhythm").over(ordered(*keys)))
        .where(~(F.col("rhythm").startswith("keySignature") & F.col("rhythm").eqNullSafe(F.col("_before"))))
        .drop("_before")
    )


def carry_accidentals(tokens: DataFrame, keys=SEQ) -> DataFrame:
    """Sounding lift: within a bar the last explicit #, b or N of a pitch holds for its later notes.

    Only bar lines reset the state. A natural clears it. Double accidentals are read as the carried value.
    """
    bar = F.sum(F.col("rhythm").contains("barline").cast("int")).over(ordered(*keys))
    explicit = F.when(F.col("lift").isin("#", "b", "N"), F.col("lift"))
    earlier = ordered(*keys, "_bar", "pitch").rowsBetween(W.unboundedPreceding, -1)
    carried = F.last("_explicit", ignorenulls=True).over(earlier)
    lift = (
        F.when(F.col("lift") == V.NOT_APPLICABLE, F.col("lift"))
        .when(F.col("_explicit").isNotNull(), F.col("_explicit"))
        .when(F.col("_carried").isin("#", "b"), F.col("_carried"))
        .otherwise(F.lit(V.EMPTY))
    )
    return (
        tokens.withColumn("_bar", bar)
        .withColumn("_explicit", explicit)
        .withColumn("_carried", carried)
        .withColumn("lift", lift)
        .drop("_bar", "_explicit", "_carried")
    )


def measure_durations(measured: DataFrame, keys=SEQ) -> DataFrame:
    """Length of each measure in ticks: sum over chords of the shortest positive member."""
    ticks = T.duration_ticks(F.col("rhythm"))
    per_chord = measured.groupBy(*keys, "measure", "chord_id").agg(F.min(F.when(ticks > 0, ticks)).alias("ticks"))
    return per_chord.groupBy(*keys, "measure").agg(F.coalesce(F.sum("ticks"), F.lit(0).cast("bigint")).alias("ticks"))


def typical_durations(durations: DataFrame, keys=SEQ) -> DataFrame:
    """Upper median of the measure lengths of a sequence."""
    part = W.partitionBy(*keys)
    ranked = durations.select(
        *keys,
        "ticks",
        F.row_number().over(part.orderBy("ticks")).alias("_rank"),
        F.count("*").over(part).alias("_n"),
    )
    return ranked.where(F.expr("_rank = _n div 2 + 1")).select(*keys, F.col("ticks").alias("typical"))


def repair_tuplets(measured: DataFrame, keys=SEQ) -> DataFrame:
    """Turn tuplets into plain values in every measure shorter than the typical one.

    One window pass: the measure length and the upper median come from windows over the same partitioning.
    """
    ticks = F.col("_ticks")
    chord = W.partitionBy(*keys, "measure", "chord_id")
    measure = W.partitionBy(*keys, "measure")
    first_of_measure = F.row_number().over(measure.orderBy("pos")) == 1
    step = (
        measured.withColumn("_ticks", T.duration_ticks(F.col("rhythm")))
        .withColumn("_chord_min", F.min(F.when(ticks > 0, ticks)).over(chord))
        .withColumn(
            "_measure_ticks",
            F.coalesce(F.sum(F.when(F.col("member") == 1, F.col("_chord_min"))).over(measure), F.lit(0).cast("bigint")),
        )
        .withColumn("_first", first_of_measure)
    )
    # rank measures by length: rows that are not the first of a measure sort last and do not count
    lead = F.col("_first").cast("int")
    ranked = step.withColumn(
        "_rank", F.row_number().over(W.partitionBy(*keys).orderBy(lead.desc(), "_measure_ticks", "pos"))
    ).withColumn("_n", F.sum(lead).over(W.partitionBy(*keys)))
    typical = F.max(F.when(F.expr("_rank = _n div 2 + 1"), F.col("_measure_ticks"))).over(W.partitionBy(*keys))
    return (
        ranked.withColumn("_typical", typical)
        .withColumn(
            "rhythm",
            F.when(F.col("_measure_ticks") < F.col("_typical"), T.without_tuplet(F.col("rhythm"))).otherwise(
                F.col("rhythm")
            ),
        )
        .drop("_ticks", "_chord_min", "_measure_ticks", "_first", "_rank", "_n", "_typical")
    )


def gate_lower_staff(chords: DataFrame, keys=SEQ, first_chords: int = 5) -> DataFrame:
    """Lower staff counts only from a lower clef within the first chords on; before that lower becomes upper."""
    opens = (F.col("chord_id") < first_chords) & F.col("rhythm").startswith("clef") & (F.col("position") == "lower")
    gate = F.min(F.when(opens, F.col("pos"))).over(W.partitionBy(*keys))
    return (
        chords.withColumn("_gate", gate)
        .withColumn(
            "position",
            F.when(F.col("pos") >= F.col("_gate"), F.col("position")).otherwise(T.to_upper_staff(F.col("position"))),
        )
        .drop("_gate")
    )


def clean_up(tokens: DataFrame, keys=SEQ) -> DataFrame:
    """Full post-processing of a decoded sequence: chords, tuplet repair, staff gate, duplicates, signatures."""
    measured = group_measures(group_chords(tokens, keys), keys)
    gated = gate_lower_staff(repair_tuplets(measured, keys), keys)
    return drop_redundant_signatures(drop_repeated_pitches(gated, keys), keys)


def ledger_lines(tokens: DataFrame, keys=SEQ) -> DataFrame:
    """Adds ledger: ledger lines of each note under the clef in force on its staff (treble/bass by default)."""
    so_far = ordered(*keys).rowsBetween(W.unboundedPreceding, 0)
    anchor = F.when(F.col("rhythm").startswith("clef"), T.clef_anchor(F.col("rhythm")))

    def current(other: str, default: str) -> Column:
        seen = F.last(F.when(F.col("position") != other, anchor), ignorenulls=True).over(so_far)
        return F.coalesce(seen, T.diatonic_step(F.lit(default)))

    upper = current("lower", V.CLEF_MIDDLE_PITCH["clef_G2"])
    lower = current("upper", V.CLEF_MIDDLE_PITCH["clef_F4"])
    distance = F.abs(
        T.diatonic_step(F.col("pitch")) - F.when(F.col("position") == "lower", lower).otherwise(upper)
    )
    lines = F.greatest(F.lit(0), F.floor((distance - 3) / 2)).cast("int")
    return tokens.withColumn("ledger", F.when(F.col("rhythm").startswith("note") & distance.isNotNull(), lines))


def max_ledger_lines(tokens: DataFrame, keys=SEQ) -> DataFrame:
    return ledger_lines(tokens, keys).groupBy(*keys).agg(
        F.coalesce(F.max("ledger"), F.lit(0)).alias("max_ledger")
    )


def canonical_key(rhythm_id: Column, pitch_id: Column, rhythm: Column, position: Column) -> Column:
    """Sort key inside a chord: notes high to low, then rests, then the rest; the lower staff last."""
    shift = F.when(position == "lower", F.lit(10_000_000)).otherwise(F.lit(0))
    return (
        F.when(rhythm.contains("note"), pitch_id * len(V.rhythm_tokens()) + rhythm_id + shift)
        .when(rhythm.contains("rest"), F.lit(100_000) + rhythm_id + shift)
        .otherwise(F.lit(1_000_000) + shift)
    )


def with_vocabulary_ids(tokens: DataFrame, fields=V.TOKEN_FIELDS) -> DataFrame:
    """Adds <field>_id for each field, NULL for an unknown token.

    The vocabulary is a constant of about four hundred entries, so broadcasting its branches is safe at any data size.
    """
    spark = tokens.sparkSession
    for field in fields:
        entries = F.posexplode(F.array(*[F.lit(t) for t in V.branch_tokens()[field]])).alias(f"{field}_id", field)
        tokens = tokens.join(F.broadcast(spark.range(1).select(entries)), field, "left")
    return tokens


def with_canonical_key(tokens: DataFrame) -> DataFrame:
    key = canonical_key(F.col("rhythm_id"), F.col("pitch_id"), F.col("rhythm"), F.col("position"))
    return with_vocabulary_ids(tokens, ("rhythm", "pitch")).withColumn("sort_key", key).drop("rhythm_id", "pitch_id")


def hoist_annotations(chords: DataFrame, keys=SEQ) -> DataFrame:
    """Move articulations and slurs of a chord to its first upper and first lower member in canonical order.

    Adds rank, the canonical order. `.` is dropped when a staff has any other mark.
    """
    keyed = with_canonical_key(chords)
    rank = F.row_number().over(
        W.partitionBy(*keys, "chord_id").orderBy("sort_key", T.token_text().desc(), F.col("member"))
    )
    lower = F.col("position") == "lower"
    placed = T.has_position(F.col("rhythm"))
    staff = W.partitionBy(*keys, "chord_id", "_lower")
    out = keyed.withColumn("rank", rank).withColumn("_lower", lower)
    out = out.withColumn("_lead", F.min("rank").over(staff) == F.col("rank"))
    for field in ("articulation", "slur"):
        value = F.col(field)
        untouched = (value == V.NOT_APPLICABLE) & ~placed
        own = F.when(untouched, F.array().cast("array<string>")).otherwise(
            F.filter(F.split(value, "_"), lambda x: x != "")
        )
        union = F.array_distinct(F.flatten(F.collect_list("_own").over(staff)))
        marks = F.when(F.size(union) > 1, F.array_remove(union, ".")).otherwise(union)
        bare = F.when(untouched, F.lit(V.NOT_APPLICABLE)).otherwise(F.lit(V.EMPTY))
        out = (
            out.withColumn("_own", own)
            .withColumn("_bare", bare)
            .withColumn("_marks", marks)
            .withColumn(
                field,
                F.when(F.col("_lead") & (F.size("_marks") > 0), T.add_marks(F.col("_bare"), F.col("_marks"))).otherwise(
                    F.col("_bare")
                ),
            )
            .drop("_own", "_bare", "_marks")
        )
    return out.drop("_lower", "_lead", "sort_key")


def chord_lines(chords: DataFrame, keys=SEQ) -> DataFrame:
    """One text line per chord: members in canonical order, joined with `&`."""
    hoisted = hoist_annotations(chords, keys)
    members = F.array_sort(F.collect_list(F.struct("rank", T.token_text().alias("text"))))
    return hoisted.groupBy(*keys, "chord_id").agg(F.array_join(members.getField("text"), "&").alias("line"))
