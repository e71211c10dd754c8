"""Corpus windowing: signatures across documents, onsets, context headers, brackets, merging of staves.

All of it works on bounded sequences and shares their partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import durations as DU
from ..functions import tokens as T
from ..functions import vocabulary as V
from .chords import SEQ, ordered

# Signatures in force where nothing was declared.
DEFAULT_SIGNATURES = {"clef": "clef_G2", "key": "keySignature_0", "time": "timeSignature/4"}


def signature_kind(rhythm: Column) -> Column:
    return (
        F.when(rhythm.startswith("clef"), F.lit("clef"))
        .when(rhythm.startswith("keySignature"), F.lit("key"))
        .when(rhythm.startswith("timeSignature"), F.lit("time"))
    )


def exclusive(*keys: str, by: str = "pos"):
    return ordered(*keys, by=by).rowsBetween(W.unboundedPreceding, -1)


def inclusive(*keys: str, by: str = "pos"):
    return ordered(*keys, by=by).rowsBetween(W.unboundedPreceding, 0)


def carry_signatures(tokens: DataFrame, keys=SEQ, document: str = "doc") -> DataFrame:
    """Signature tokens of concatenated documents that really change something.

    Before the first sounding row of a document the last declaration of a kind counts; the first document always
    states all three (defaults where undeclared). Anything equal to what is in force is dropped.
    """
    first_note = F.min(F.when(T.is_sounding(F.col("rhythm")), F.col("pos"))).over(W.partitionBy(*keys, document))
    rows = tokens.withColumn("_open", F.coalesce(F.col("pos") < first_note, F.lit(True)))
    signatures = rows.select(
        *keys, document, "pos", "_open", signature_kind(F.col("rhythm")).alias("kind"), "rhythm"
    ).where("kind is not null")
    starts = tokens.groupBy(*keys).agg(F.min(document).alias(document))
    default = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("rhythm")) for k, r in DEFAULT_SIGNATURES.items()]))
    defaults = starts.select(*keys, document, default.alias("_d")).select(
        *keys, document, F.lit(-1).alias("pos"), F.lit(True).alias("_open"), "_d.*"
    )
    both = signatures.unionByName(defaults)
    last_open = F.max(F.when(F.col("_open"), F.col("pos"))).over(W.partitionBy(*keys, document, "kind"))
    counted = both.withColumn("_last", last_open).where(~F.col("_open") | (F.col("pos") == F.col("_last")))
    before = F.lag("rhythm").over(ordered(*keys, "kind"))
    return (
        counted.withColumn("_before", before)
        .where(~F.col("rhythm").eqNullSafe(F.col("_before")))
        .select(*keys, document, "pos", "kind", "rhythm")
    )


def fold_ties(tokens: DataFrame, keys=SEQ, tie: str = "tieSlur") -> DataFrame:
    """Turn tie rows into slur marks on the notes around them.

    The first row never carries a start mark, ties on the last row do nothing, and the last two rows always stay.
    A second tie between the same notes resets a combined mark to a plain start.
    """
    w, part = ordered(*keys), W.partitionBy(*keys)
    note = F.col("rhythm").startswith("note")
    index = F.row_number().over(w) - 1
    out = (
        tokens.withColumn("_i", index)
        .withColumn("_n", F.count("*").over(part))
        .withColumn("_g", F.sum(note.cast("int")).over(w))
        .withColumn("_tie", (F.col("rhythm") == tie) & (F.col("_i") >= 1) & (F.col("_i") <= F.col("_n") - 2))
        .withColumn("_after", F.count_if("_tie").over(W.partitionBy(*keys, "_g")))
        .withColumn("_before", F.coalesce(F.lag("_after").over(w), F.lit(0)))
    )
    base = F.when(F.col("_before") > 0, F.lit("slurStop")).otherwise(F.col("slur"))
    slur = (
        F.when(~note, F.col("slur"))
        .when((F.col("_after") == 0) | (F.col("_i") == 0), base)
        .when((F.col("_after") == 1) & (base == "slurStop"), F.lit("slurStart_slurStop"))
        .otherwise(F.lit("slurStart"))
    )
    kept = out.withColumn("slur", slur).where((F.col("rhythm") != tie) | (F.col("_i") >= F.col("_n") - 2))
    return kept.drop("_i", "_n", "_g", "_tie", "_after", "_before")


def onsets(rows: DataFrame, keys=SEQ) -> DataFrame:
    """Onset of each row of a measure from running durations.

    Input: kind (note, symbol, bar, clef, move, chord), duration, visible. Symbols advance by one first (bar lines sort
    one later), clefs and moves take no slot; a chord member takes the onset of its head and restarts the clock there. One
    that no head comes before starts at the clock and moves it on, whatever other members came before.
    Adds onset, and broken: the clock ran below zero somewhere in the group.
    """
    w = ordered(*keys)
    kind, d = F.col("kind"), F.col("duration")
    head = kind.isin("symbol", "bar", "clef") | ((kind == "note") & F.col("visible"))
    linear = F.when(kind.isin("note", "move"), d).when(kind.isin("symbol", "bar"), F.lit(1)).otherwise(F.lit(0))
    offset = F.when(kind == "symbol", F.lit(1)).when(kind == "bar", F.lit(2)).otherwise(F.lit(0))
    out = (
        rows.withColumn("_lin", linear)
        .withColumn("_ls", F.sum("_lin").over(w))
        .withColumn("_off", offset)
        .withColumn("_h", F.sum(head.cast("int")).over(w))
    )
    group = ordered(*keys, "_h")
    # clock position the previous chord member (or the head) left behind, without the linear steps since
    anchor = F.when(kind == "chord", F.struct(d.alias("d"), F.col("_ls").alias("ls"))).when(
        head, F.struct(F.col("_off").alias("d"), (F.col("_ls") - F.col("_lin")).alias("ls"))
    )
    is_head = F.when(head, F.lit(True)).when(kind == "chord", F.lit(False))
    before = group.rowsBetween(W.unboundedPreceding, -1)
    previous = F.last(anchor, ignorenulls=True).over(before)
    previous_is_head = F.last(is_head, ignorenulls=True).over(before)
    head_offset = F.first(F.when(head, F.col("_off")), ignorenulls=True).over(before)
    drift = F.col("_ls") - F.col("_prev.ls")
    delta = (
        F.when(kind != "chord", F.col("_lin"))
        .when(F.col("_prev_head"), F.col("_head_off") + d - drift)
        .when((F.col("_h") > 0) & F.col("_prev").isNotNull(), d - F.col("_prev.d") - drift)
        .otherwise(d)
    )
    out = (
        out.withColumn("_prev", previous)
        .withColumn("_prev_head", previous_is_head)
        .withColumn("_head_off", head_offset)
        .withColumn("_delta", delta)
        .withColumn("_cur", F.sum("_delta").over(w))
    )
    start = F.col("_cur") - F.col("_delta") + F.col("_off")
    head_onset = F.first(F.when(head, F.col("_start")), ignorenulls=True).over(before)
    out = out.withColumn("_start", start)
    onset = F.when(kind == "chord", F.coalesce(head_onset, F.col("_start"))).otherwise(F.col("_start"))
    return (
        out.withColumn("onset", onset)
        .withColumn("broken", F.min("_cur").over(W.partitionBy(*keys)) < 0)
        .drop("_lin", "_ls", "_off", "_h", "_prev", "_prev_head", "_head_off", "_delta", "_cur", "_start")
    )


def pending_clefs(clefs: DataFrame, leading: DataFrame, keys=SEQ) -> DataFrame:
    """Clefs announced after a bar line: they hold from the next measure on, unless that measure opens with its own.

    clefs: keys, measure, staff, pos, rhythm of announced clefs; leading: keys, measure, staff of opening clefs.
    """
    last = clefs.groupBy(*keys, "measure", "staff").agg(F.max_by("rhythm", "pos").alias("rhythm"))
    shifted = last.withColumn("measure", F.col("measure") + 1)
    return shifted.join(leading.select(*keys, "measure", "staff").distinct(), [*keys, "measure", "staff"], "left_anti")


def toggle_state(rows: DataFrame, start: Column, stop: Column, name: str, keys=SEQ) -> DataFrame:
    """Adds two flags: the state after the row, and whether the row is inside the bracket (its stop row included)."""
    signal = F.when(start, F.lit(True)).when(stop, F.lit(False))
    after = F.coalesce(F.last(signal, ignorenulls=True).over(inclusive(*keys)), F.lit(False))
    before = F.coalesce(F.last(signal, ignorenulls=True).over(exclusive(*keys)), F.lit(False))
    return rows.withColumn(name, after).withColumn(f"{name}_span", after | before)


def row_measures(tokens: DataFrame, keys=SEQ) -> DataFrame:
    """Measure number of flat token rows: a bar line or repeat closes its measure."""
    closes = T.is_measure_end(F.col("rhythm")).cast("int")
    return tokens.withColumn("measure", F.coalesce(F.sum(closes).over(exclusive(*keys)), F.lit(0)).cast("int"))


def with_context(tokens: DataFrame, keys=SEQ) -> DataFrame:
    """Adds staves and the signatures in force after each row: upper and lower clef, key, time (with defaults).

    A voice has two staves when its first measure opens with at least two clefs.
    """
    part = W.partitionBy(*keys)
    r = F.col("rhythm")
    first_note = F.min(F.when((F.col("measure") == 0) & T.is_sounding(r), F.col("pos"))).over(part)
    opening = (F.col("measure") == 0) & r.startswith("clef") & (first_note.isNull() | (F.col("pos") < first_note))
    staves = F.when(F.count_if(opening).over(part) >= 2, F.lit(2)).otherwise(F.lit(1))
    low = (F.col("position") == "lower") & (F.col("staves") == 2)

    def last(condition: Column, default: str) -> Column:
        seen = F.last(F.when(condition, r), ignorenulls=True).over(inclusive(*keys))
        return F.coalesce(seen, F.lit(default))

    return (
        tokens.withColumn("staves", staves)
        .withColumn("clef_upper", last(r.startswith("clef") & ~low, "clef_G2"))
        .withColumn("clef_lower", last(r.startswith("clef") & low, "clef_F4"))
        .withColumn("key", last(r.startswith("keySignature"), DEFAULT_SIGNATURES["key"]))
        .withColumn("time", last(r.startswith("timeSignature"), DEFAULT_SIGNATURES["time"]))
    )


CONTEXT = ("clef_upper", "clef_lower", "key", "time")


def context_at_measures(tokens: DataFrame, keys=SEQ) -> DataFrame:
    """Signatures in force at the start of each measure, from one window pass (no prefix rescans)."""
    state = with_context(tokens, keys)
    first = W.partitionBy(*keys, "measure").orderBy("pos")
    w = ordered(*keys)
    defaults = {"clef_upper": "clef_G2", "clef_lower": "clef_F4", "key": "keySignature_0", "time": "timeSignature/4"}
    shifted = state.select(
        *keys, "measure", "staves", F.row_number().over(first).alias("_r"),
        *[F.coalesce(F.lag(c).over(w), F.lit(defaults[c])).alias(c) for c in CONTEXT],
    )
    return shifted.where("_r = 1").drop("_r")


def cut_windows(tokens: DataFrame, size: int = 8, keys=SEQ) -> DataFrame:
    """Cut voices into windows of `size` measures, each with its own context header.

    Signatures that open the first measure of a window move into the header, with their chord markers. Voices of
    fewer than two measures give no window. Adds window and ord; header rows have a negative ord.
    """
    state = with_context(tokens, keys)
    part = W.partitionBy(*keys)
    r = F.col("rhythm")
    state = state.withColumn("_measures", F.max("measure").over(part) + 1).where("_measures >= 2")
    state = state.withColumn("window", F.expr(f"measure div {size}").cast("int"))
    win = W.partitionBy(*keys, "window")
    header_kind = signature_kind(r).isNotNull() | (r == "chord")
    first_other = F.min(F.when(~header_kind, F.col("pos"))).over(win)
    state = state.withColumn("_first_measure", F.expr(f"measure % {size} = 0")).withColumn(
        "_leading", F.col("_first_measure") & (first_other.isNull() | (F.col("pos") < first_other))
    )
    w = ordered(*keys)
    defaults = {"clef_upper": "clef_G2", "clef_lower": "clef_F4", "key": "keySignature_0", "time": "timeSignature/4"}
    before = [F.coalesce(F.lag(c).over(w), F.lit(defaults[c])).alias(c) for c in CONTEXT]
    state = state.withColumn("_before", F.struct(*before)).withColumn("_after", F.struct(*CONTEXT))
    # the last leading row knows the header; without one it is what held before the first row
    header = state.groupBy(*keys, "window").agg(
        F.coalesce(F.max_by("_after", F.when(F.col("_leading"), F.col("pos"))), F.min_by("_before", "pos")).alias("_h"),
        F.max("staves").alias("staves"),
    )

    def row(position: int, rhythm: Column, staff: str | None) -> Column:
        placed = F.lit(V.EMPTY if staff else V.NOT_APPLICABLE)
        return F.struct(
            F.lit(position).alias("ord"), rhythm.alias("rhythm"), placed.alias("pitch"), placed.alias("lift"),
            placed.alias("articulation"), placed.alias("slur"), F.lit(staff or V.NOT_APPLICABLE).alias("position"),
        )

    upper = row(-5, F.col("_h.clef_upper"), "upper")
    lower = [row(-4, F.lit("chord"), None), row(-3, F.col("_h.clef_lower"), "lower")]
    tail = [row(-2, F.col("_h.key"), None), row(-1, F.col("_h.time"), None)]
    rows = F.when(F.col("staves") == 2, F.array(upper, *lower, *tail)).otherwise(F.array(upper, *tail))
    heads = header.select(*keys, "window", F.explode(rows).alias("_r")).select(*keys, "window", "_r.*")
    body = state.where("not _leading").select(*keys, "window", F.col("pos").alias("ord"), *V.TOKEN_FIELDS)
    return heads.unionByName(body)


def tuplet_brackets(measured: DataFrame, keys=SEQ) -> DataFrame:
    """One row per chord with mark start, stop or ''.

    Runs of chords with the same ratio are cut into blocks of `actual`; a run that does not divide evenly takes all
    marks of its measure away.
    """
    n = T.base_number(F.col("rhythm"))
    low = n.bitwiseAND(-n)
    plain = (n == 0) | (n == low) | F.col("rhythm").contains("G")
    ratio = F.when(
        T.is_sounding(F.col("rhythm")) & ~plain,
        F.struct((n / low).cast("int").alias("actual"), (T.prior_power_of_two(n) / low).cast("int").alias("normal")),
    )
    chords = measured.groupBy(*keys, "measure", "chord_id").agg(
        F.min_by(ratio, F.when(ratio.isNotNull(), F.col("member"))).alias("ratio")
    )
    w = W.partitionBy(*keys, "measure").orderBy("chord_id")
    new_run = (~F.col("ratio").eqNullSafe(F.lag("ratio").over(w))).cast("int")
    runs = chords.withColumn("_new", new_run).withColumn("_run", F.sum("_new").over(w))
    run = W.partitionBy(*keys, "measure", "_run")
    size = F.col("ratio.actual")
    runs = (
        runs.withColumn("_i", F.row_number().over(run.orderBy("chord_id")) - 1)
        .withColumn("_len", F.count("*").over(run))
        .withColumn("_fits", F.coalesce(F.col("_len") % size == 0, F.lit(True)))
        .withColumn("_ok", F.min("_fits").over(W.partitionBy(*keys, "measure")))
    )
    mark = (
        F.when(~F.col("_ok") | F.col("ratio").isNull(), F.lit(""))
        .when(F.col("_i") % size == 0, F.lit("start"))
        .when(F.col("_i") % size == size - 1, F.lit("stop"))
        .otherwise(F.lit(""))
    )
    return runs.select(*keys, "measure", "chord_id", mark.alias("mark"))


def volta_numbers(measured: DataFrame, start: Column, stop: Column, keys=SEQ) -> DataFrame:
    """Number of each volta: one more than the last when it opens right after the last stop measure, else 1."""
    last_stop = F.last(F.when(stop, F.col("measure")), ignorenulls=True).over(exclusive(*keys))
    starts = measured.withColumn("_stop", last_stop).where(start)
    chained = F.coalesce(F.col("measure") == F.col("_stop") + 1, F.lit(False))
    numbered = starts.withColumn("_chained", chained).withColumn(
        "_island", F.sum((~F.col("_chained")).cast("int")).over(ordered(*keys))
    )
    return numbered.select(*keys, "pos", "measure", F.row_number().over(ordered(*keys, "_island")).alias("number"))


def control_line_numbers(lines: DataFrame, control: Column, keys=SEQ) -> DataFrame:
    """Consecutive control lines share a number, every other line gets its own."""
    w = ordered(*keys)
    out = lines.withColumn("_control", control)
    joins = F.col("_control") & F.coalesce(F.lag("_control").over(w), F.lit(True))
    return out.withColumn("_step", (~joins).cast("int")).withColumn("line_no", F.sum("_step").over(w)).drop("_control", "_step")


def pair_in_stride(items: DataFrame, stride: int, slot: int, keys=SEQ) -> DataFrame:
    """Merge item `slot` of every stride with the next one.

    A missing partner empties the page. Unequal measure counts mark the pair as broken.
    """
    w = ordered(*keys, by="idx")
    out = items.withColumn("_lead", F.lead("idx").over(w)).withColumn("_lead_n", F.lead("measures").over(w))
    first = F.col("idx") % stride == slot
    out = out.withColumn("_lost", F.max(first & F.col("_lead").isNull()).over(W.partitionBy(*keys))).where("not _lost")
    merged = F.when(first, F.col("_lead"))
    kept = out.where(F.col("idx") % stride != slot + 1)
    return kept.select(
        *keys, "idx", merged.alias("partner"), "measures",
        (first & (F.col("measures") != F.col("_lead_n"))).alias("broken"),
    )


def merge_staves(rows: DataFrame, keys=SEQ, order: str = "onset") -> DataFrame:
    """Merge simultaneous tokens: bar lines, clefs, keys, times, then notes and rests; equal bar lines, keys and times once.

    Clefs and notes of one onset are glued with chord markers; the result ends with a bar line.
    """
    r = F.col("rhythm")
    rank = (
        F.when(T.is_measure_end(r), F.lit(0)).when(r.startswith("clef"), F.lit(1)).when(r.startswith("keySignature"), F.lit(2))
        .when(r.startswith("timeSignature"), F.lit(3)).otherwise(F.lit(4))
    )
    ranked = rows.withColumn("rank", rank)
    copy = F.row_number().over(W.partitionBy(*keys, order, "rank", *V.TOKEN_FIELDS).orderBy("pos"))
    unique = ranked.withColumn("_copy", copy).where("_copy = 1 or rank in (1, 4)")
    glued = F.row_number().over(W.partitionBy(*keys, order, "rank").orderBy("pos")) > 1
    unique = unique.withColumn("_glued", glued & F.col("rank").isin(1, 4))
    last = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order), F.desc("rank"), F.desc("pos"))) == 1
    unique = unique.withColumn("_last", last)
    fields = V.TOKEN_FIELDS

    def plain(slot: int, rhythm: Column) -> Column:
        return F.struct(F.lit(slot).alias("slot"), rhythm.alias("rhythm"), *[F.lit(".").alias(f) for f in fields[1:]])

    ends = r.contains("barline") | r.startswith("repeat")
    shown = F.when(F.col("_last") & (r == "repeatEndStart"), F.lit("repeatEnd")).otherwise(r)
    own = F.struct(F.lit(1).alias("slot"), shown.alias("rhythm"), *[F.col(f).alias(f) for f in fields[1:]])
    out = F.array_compact(
        F.array(
            F.when(F.col("_glued"), plain(0, F.lit("chord"))),
            own,
            F.when(F.col("_last") & ~ends, plain(2, F.lit("barline"))),
        )
    )
    return unique.select(*keys, order, "rank", "pos", F.explode(out).alias("_t")).select(*keys, order, "rank", "pos", "_t.*")


def _merged_end(new: Column, last: Column) -> Column:
    pair = ((new == "repeatStart") & (last == "repeatEnd")) | ((new == "repeatEnd") & (last == "repeatStart"))
    return F.when(pair, F.lit("repeatEndStart")).when(new.contains("repeat"), new).otherwise(last)


def coalesce_bar_lines(tokens: DataFrame, keys=SEQ, carry=(), measures: DataFrame | None = None) -> DataFrame:
    """Merge adjacent bar lines and repeats, then close every measure with one.

    Start and end repeats combine, a repeat beats a bar line, two bar lines never merge. A run is folded in order; a
    merged symbol stays in the measure where it began. Rows added at the end of a measure have no pos. `carry` names
    further token columns to keep ('.' in added rows); `measures` lists measures that may hold no token at all.
    """
    w = ordered(*keys)
    end = T.is_measure_end(F.col("rhythm"))
    new_run = ~(end & F.coalesce(F.lag(end).over(w), F.lit(False)))
    runs = tokens.withColumn("_run", F.sum(new_run.cast("int")).over(w))
    members = F.array_sort(F.collect_list(F.struct("pos", "measure", "rhythm", *carry)))
    folded = runs.groupBy(*keys, "_run").agg(members.alias("_m"))
    empty = F.slice(F.col("_m"), 1, 0)

    def step(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        bars = x["rhythm"].contains("barline") & last["rhythm"].contains("barline")
        joined = F.struct(
            last["pos"].alias("pos"), last["measure"].alias("measure"), _merged_end(x["rhythm"], last["rhythm"]).alias("rhythm"),
            *[last[c].alias(c) for c in carry],
        )
        return F.when((F.size(out) == 0) | bars, F.concat(out, F.array(x))).otherwise(
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))
        )

    kept = folded.select(*keys, F.explode(F.aggregate("_m", empty, step)).alias("_t")).select(*keys, "_t.*")
    every = (tokens if measures is None else measures).select(*keys, "measure").distinct()
    nothing = F.lit(None).cast(tokens.schema["pos"].dataType).alias("pos")
    # one marker per measure becomes its closing bar line unless the measure has one: a single pass over the tokens
    markers = every.select(*keys, nothing, "measure", F.lit("barline").alias("rhythm"), *[F.lit(V.NOT_APPLICABLE).alias(c) for c in carry])
    both = kept.withColumn("_marker", F.lit(False)).unionByName(markers.withColumn("_marker", F.lit(True)))
    closed = F.max_by(T.is_measure_end(F.col("rhythm")), F.when(~F.col("_marker"), F.col("pos"))).over(W.partitionBy(*keys, "measure"))
    return both.withColumn("_closed", F.coalesce(closed, F.lit(False))).where("not _marker or not _closed").drop("_marker", "_closed")


def fill_mark(rows: DataFrame, mark: str, group) -> DataFrame:
    """Spread a mark to all notes and rests that sound together with a marked one, except whole-measure rests."""
    has = F.col("articulation").contains(mark)
    r = F.col("rhythm")
    target = T.is_sounding(r) & ~has & ~r.startswith("note_0") & ~r.startswith("rest_0")
    any_marked = F.max(has).over(W.partitionBy(*group))
    extended = T.add_marks(F.col("articulation"), F.array(F.lit(mark)))
    return rows.withColumn("articulation", F.when(any_marked & target, extended).otherwise(F.col("articulation")))


def periodic_core(pages: DataFrame, layout: str) -> DataFrame:
    """Least trim, then least period, such that the trimmed layout (a string, one letter per staff) repeats.

    Candidates are generated per page from three short sequences and tested as strings; `period` is NULL when no
    core of two full cycles exists.
    """
    n = F.length(layout)
    cand = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.floor(n / 2), F.lit(1)).cast("int")),
            lambda p: F.flatten(
                F.transform(
                    F.sequence(F.lit(0), p),
                    lambda f: F.transform(
                        F.sequence(F.lit(0), p),
                        lambda b: F.struct((f + b).alias("trim"), p.alias("period"), f.alias("front"), b.alias("back")),
                    ),
                )
            ),
        )
    )

    def fits(c: Column) -> Column:
        size = n - c["front"] - c["back"]
        core = F.substring(F.col(layout), c["front"] + 1, size)
        unit = F.substring(core, F.lit(1), c["period"])
        tiled = F.array_join(F.array_repeat(unit, (size / c["period"]).cast("int")), "")
        return (size >= c["period"] * 2) & (size % c["period"] == 0) & (core == tiled)

    best = F.array_min(F.filter(cand, fits))
    return pages.withColumn("_best", best).select(*pages.columns, "_best.*")


def split_grand_staff(rows: DataFrame, keys=SEQ) -> DataFrame:
    """Parts with a lower staff become two parts; rows without a staff go to both; part numbers stay in order."""
    two = F.max(F.col("staff") == 2).over(W.partitionBy(*keys, "part"))
    staves = F.when(~F.col("_two"), F.array(F.lit(1))).when(F.col("staff").isNull(), F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.col("staff"))
    )
    wide = rows.withColumn("_two", F.coalesce(two, F.lit(False))).withColumn("_s", F.explode(staves))
    number = F.dense_rank().over(W.partitionBy(*keys).orderBy("part", "_s"))
    return wide.withColumn("new_part", number).drop("_two", "_s")


def rhythmic_layers(members: DataFrame, group) -> DataFrame:
    """Layer of each chord member on its staff: rank of its length. Grace notes come first, unmeasured ones count as
    the longest; of several rests in a layer only the first stays."""
    longest = F.max("ticks").over(W.partitionBy(*group))
    length = F.when(F.col("rhythm").contains("G"), F.lit(0)).when(F.col("ticks") == 0, longest).otherwise(F.col("ticks"))
    out = members.withColumn("_len", length).withColumn("layer", F.dense_rank().over(W.partitionBy(*group).orderBy("_len")) - 1)
    rest = F.col("pitch").isin(V.EMPTY, V.NOT_APPLICABLE)
    nth = F.row_number().over(W.partitionBy(*group, "layer", rest).orderBy("pos"))
    return out.withColumn("_nth", nth).where(~rest | (F.col("_nth") == 1)).drop("_len", "_nth")


def division_and_numerator(measured: DataFrame, keys=SEQ) -> DataFrame:
    """Median measure length (whole notes, 1 by default) and the least common denominator of all chord lengths and 4.

    Denominators divide the ticks of a whole note, so their common multiple is the greatest exponent of each of its primes:
    an aggregate that is merged map-side like any maximum.
    """
    ticks = T.duration_ticks(F.col("rhythm"))
    chords = measured.groupBy(*keys, "measure", "chord_id").agg(F.coalesce(F.min(ticks), F.lit(0)).alias("ticks"))
    whole = F.lit(T.TICKS_PER_WHOLE).cast("bigint")
    chords = chords.withColumn("_den", F.when(F.col("ticks") > 0, (whole / DU.gcd(F.col("ticks"), whole)).cast("bigint")))
    primes, least = DU.prime_powers(T.TICKS_PER_WHOLE), DU.prime_powers(4)
    per_measure = chords.groupBy(*keys, "measure").agg(
        F.sum("ticks").alias("ticks"), *[F.max(DU.exponent(F.col("_den"), p, m)).alias(f"_e{p}") for p, m in primes.items()]
    )
    length = F.when(F.col("ticks") > 0, F.col("ticks") / whole)
    division = F.lit(1).cast("bigint")
    for p, m in primes.items():
        division = division * DU.power(p, F.greatest(F.max(f"_e{p}"), F.lit(least.get(p, 0))), m)
    return per_measure.groupBy(*keys).agg(F.coalesce(F.median(length), F.lit(1.0)).alias("numerator"), division.alias("division"))
