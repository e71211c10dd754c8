"""Repair of conversation structure by survivor-coalescence Viterbi.

The roles of a repaired conversation follow ``(s?(ua)+)?``. Every row is kept, given another role, or deleted, and rows
with no text are inserted, at the least total cost; of equally cheap audits the ASCII-least wins. Four states (start,
after system, user, assistant) each keep one survivor: the best way to have dealt with the rows so far. Survivors are the
leaves of a backpointer tree with reference counts. A node that no survivor descends from is freed; as soon as all survivors
share an ancestor, the edits up to it are emitted and its rows leave memory. What is held is the unresolved part only. A
survivor dies when another one could follow whatever it may do and still be cheaper (deleting all rows so far, say).

Ties. Survivors have dealt with the same rows and end in a row's edit, so neither audit is a beginning of the other, and
appending cannot turn their order round. The order of the complete unresolved audits is therefore carried as a rank per
survivor: comparing two candidates is comparing (rank, own edits), which equals comparing the whole suffixes.

Scale. Conversations are streams: rows are dealt by conversation, sorted, and pass in Arrow batches. One with more than
``most_rows`` rows is cut into ranges of rows instead; each range is solved for every state it could be entered in, a
4 x 4 table of costs and ranks per range goes to the driver (two a partition), and once the entry and exit of each range is
known they all emit their edits side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}  # the role each state waits for
AFTER = {"user": USER, "assistant": ASSISTANT}
RETYPE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
#: Most it costs to follow from one state what could be done from another: at worst a row kept by the other is deleted (a
#: system row after the start) and an exchange is opened or completed by insertions.
FOLLOW = {
    START: {START: 0, SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
    SYSTEM: {START: DELETE + 2 * INSERT, SYSTEM: 0, USER: INSERT, ASSISTANT: 2 * INSERT},
    USER: {START: INSERT + DELETE, SYSTEM: INSERT, USER: 0, ASSISTANT: INSERT},
    ASSISTANT: {START: DELETE, SYSTEM: 0, USER: INSERT, ASSISTANT: 0},
}
MOST_ROWS = 1_000_000
ROWS = 2048

# ---- edits of one row ----------------------------------------------------------------------------------------------


def inserts(state: int) -> list[tuple[str, int]]:
    """Insertions worth making in a state, and the state after them: none, or up to the first repetition."""
    found, seen, text = [("", state)], {state}, ""
    while (state := AFTER[ROLE[state]]) not in seen:
        seen.add(state)
        text += "I"
        found.append((text, state))
    return found


def after_kept(state: int, initial: str) -> int | None:
    if initial == "s":
        return SYSTEM if state == START else None
    return AFTER[ROLE[state]] if initial and initial == ROLE[state][0] else None


def edges(initial: str, forced: bool, unfinished: bool) -> list[tuple[int, int, str, int]]:
    """Ways through one row: source, cost, edits, target. Per source and target only the best."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for source in range(4):
        for before, state in inserts(source):
            ways = [(DELETE, "D", state)]
            if not forced:
                kept = after_kept(state, initial)
                ways += [(UNFINISHED * unfinished, "K", kept)] if kept is not None else []
                ways.append((RETYPE + UNFINISHED * unfinished, "R", AFTER[ROLE[state]]))
            for cost, edit, target in ways:
                way = (cost + INSERT * len(before), before + edit)
                best[source, target] = min(best.get((source, target), way), way)
    return [(source, cost, edits, target) for (source, target), (cost, edits) in best.items()]


EDGES = {(i, f, u): edges(i, f, u) for i in ("s", "u", "a", "") for f in (False, True) for u in (False, True)}


def edges_of(role: str, fault: str) -> list[tuple[int, int, str, int]]:
    initial = role[:1] if role[:1] in ("s", "u", "a") else ""
    return EDGES[initial, fault in ("blank", "duplicate"), fault == "truncated"]


# ---- the walk ------------------------------------------------------------------------------------------------------


@dataclass(eq=False, slots=True)
class Node:
    """A survivor or an ancestor of survivors: the edits of one row, made in state ``source``."""

    parent: Node | None
    row: tuple | None
    source: int
    edits: str
    children: list[Node] = field(default_factory=list)


@dataclass(slots=True)
class Survivor:
    cost: int
    rank: int
    node: Node


class Walk:
    """Survivors over the rows of one conversation (or of a range of its rows), entered in a given state."""

    def __init__(self, entry: int = START) -> None:
        self.root = Node(None, None, entry, "")
        self.alive = {entry: Survivor(0, 0, self.root)}

    def step(self, row: tuple, ways: list[tuple[int, int, str, int]]) -> Iterator[Node]:
        """Take a row; yields the nodes whose edits are settled by it, in order."""
        best: dict[int, tuple] = {}
        for source, cost, edits, target in ways:
            if source in self.alive:
                from_ = self.alive[source]
                way = (from_.cost + cost, from_.rank, edits, source)
                if target not in best or way < best[target]:
                    best[target] = way
        best = {x: w for x, w in best.items() if all(v[0] + FOLLOW[y][x] >= w[0] for y, v in best.items())}
        order = sorted(best, key=lambda t: best[t][1:3])
        old, self.alive = self.alive, {}
        for rank, target in enumerate(order):
            cost, _, edits, source = best[target]
            node = Node(old[source].node, row, source, edits)
            old[source].node.children.append(node)
            self.alive[target] = Survivor(cost, rank, node)
        for survivor in old.values():
            self.free(survivor.node)
        yield from self.settled()

    def free(self, node: Node) -> None:
        """Drop a node that has no descendants left, and its ancestors likewise."""
        while not node.children and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            node.parent, node = None, parent

    def settled(self) -> Iterator[Node]:
        while len(self.root.children) == 1:
            self.root = self.root.children.pop()
            self.root.parent = None
            yield self.root

    def finish(self, state: int) -> Iterator[Node]:
        """The edits still open on the way to a survivor."""
        for other, survivor in self.alive.items():
            if other != state:
                self.free(survivor.node)
        yield from self.settled()

    def ending(self) -> int:
        """The state to end in, counting the insertions that complete the last exchange."""
        return min(self.alive, key=lambda s: (self.alive[s].cost + INSERT * len(closing(s)), self.alive[s].rank))

    @property
    def held(self) -> int:
        """Nodes in memory."""
        stack, n = [self.root], 0
        while stack:
            n += 1
            stack.extend(stack.pop().children)
        return n


def closing(state: int) -> str:
    """Insertions after the last row."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def inserted(state: int, edits: str) -> Iterator[tuple[str, int]]:
    for _ in range(edits.count("I")):
        yield ROLE[state], AFTER[ROLE[state]]
        state = AFTER[ROLE[state]]


# ---- rows in and out -----------------------------------------------------------------------------------------------

#: Columns of a repaired row; ``was_role`` is null in an inserted one, ``edit`` is K, R, D or I.
REPAIRED = "conv_id {kind}, part int, place bigint, edit string, turn bigint, role string, text string, was_role string, fault string, cost int"
NAMES = [c.split()[0] for c in REPAIRED.split(", ")]


def edited_rows(node: Node) -> Iterator[tuple]:
    """(edit, turn, role, text, was_role, fault, cost) of a settled node."""
    state = node.source
    for role, state in inserted(state, node.edits):
        yield "I", None, role, "", None, "", INSERT
    turn, role, text, fault = node.row
    edit = node.edits[-1]
    extra = UNFINISHED * (fault == "truncated")
    if edit == "D":
        yield "D", turn, role, text, role, fault, DELETE
    elif edit == "K":
        yield "K", turn, role, text, role, fault, extra
    else:
        yield "R", turn, ROLE[state], text, role, fault, RETYPE + extra


def marked_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Sorted rows with their fault: a mark stands right before a row that repeats an earlier one."""
    marked = False
    for batch in batches:
        get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        for conv, turn, role, text, fault in zip(get["conv_id"], get["turn"], get["role"], get["text"], get["fault"]):
            if fault == "mark":
                marked = True
            else:
                yield conv, (turn, role, text, "duplicate" if marked and fault != "blank" else fault)
                marked = False


def batches_of(rows: Iterable[tuple], types: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), types)], schema=types)


def repaired_types(conv_type: pa.DataType) -> pa.Schema:
    s, n = pa.string(), pa.int64()
    return pa.schema(list(zip(NAMES, [conv_type, pa.int32(), n, s, n, s, s, s, s, pa.int32()])))


def solve(conv: object, rows: Iterable[tuple], entry: int = START, leave: int | None = None, part: int = 0) -> Iterator[tuple]:
    """Repaired rows of a conversation, or of a range of it that is left in a known state."""
    walk, place = Walk(entry), 0

    def out(nodes: Iterable[Node]) -> Iterator[tuple]:
        nonlocal place
        for node in nodes:
            for edit in edited_rows(node):
                yield (conv, part, place, *edit)
                place += 1

    for row in rows:
        yield from out(walk.step(row, edges_of(row[1], row[3])))
    state = walk.ending() if leave is None else leave
    yield from out(walk.finish(state))
    for role, _ in inserted(state, closing(state) if leave is None else ""):
        yield conv, part, place, "I", None, role, "", None, "", INSERT
        place += 1


# ---- operator ------------------------------------------------------------------------------------------------------


def prepared(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their fault but for duplicates, and marks for those: the same sort key, nothing of the text.

    Duplicates are found on hashes (SHA-256) of role and text: the first row of each is an aggregate, combined before
    the shuffle. ``_n`` tells equal rows of a turn apart.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = df.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.monotonically_increasing_id().alias("_n"),
    )
    end = F.rtrim("text", F.lit(BLANKS))
    last = F.right(end, F.lit(1))
    fault = F.when(end == "", "blank").when(last.isin(".", "!", "?"), "").otherwise("truncated")
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    rows = rows.select("conv_id", "turn", key.alias("_key"), "_n", "role", "text", fault.alias("fault"))
    narrow = rows.select("conv_id", "turn", "_key", "_n")
    first = narrow.groupBy("conv_id", "_key").agg(F.min(F.struct("turn", "_n")).alias("_first"), F.count("*").alias("_count"))
    again = first.where(F.col("_count") > 1).alias("a")
    marks = narrow.alias("n").join(again, F.col("n.conv_id").eqNullSafe(F.col("a.conv_id")) & (F.col("n._key") == F.col("a._key"))).where(
        ~F.struct("n.turn", "n._n").eqNullSafe(F.col("a._first"))
    ).select("n.conv_id", "n.turn", "n._key", "n._n", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit("mark").alias("fault"))
    return rows, marks


ORDER = ["conv_id", "turn", "_key", "_n"]


def repair(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = MOST_ROWS
) -> DataFrame:
    """One row per edit: conversation, part and place (their order), edit, turn, role and text after it, role before,
    fault and cost. Deleted rows return with edit D.

    Rows go by turn, nulls first; rows of equal turn by a hash of role and text. Null role or text counts as one space, a
    null conversation id is a conversation of its own. A role that starts with none of s, u, a is never kept. Repeated
    rows are duplicates. Other columns are not read. An empty table: no rows.
    """
    short, long = repaired_parts(df, conv_col, turn_col, role_col, text_col, most_rows)
    return short if long is None else short.unionByName(long)


def repaired_parts(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = MOST_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """Repaired rows of the conversations that are one stream each, in order, and of the long ones, if there are any.

    The input is read more than once: checkpoint one whose rows may come in another order the next time.
    """
    rows, marks = prepared(df, conv_col, turn_col, role_col, text_col)
    kind = df.schema[conv_col].dataType.simpleString()
    # Bounded: at most one in ``most_rows`` rows. Joins are left to the optimizer, which splits a hot side it has to shuffle.
    long_ones = cut(rows.groupBy("conv_id").count().where(F.col("count") > most_rows).select("conv_id")).alias("l")
    both = rows.unionByName(marks)
    if long_ones.isEmpty():
        return whole_conversations(both, kind), None
    same = F.col("b.conv_id").eqNullSafe(F.col("l.conv_id"))
    short, long = (both.alias("b").join(long_ones, same, how).select("b.*") for how in ("left_anti", "left_semi"))
    return whole_conversations(short, kind), ranged_conversations(long, kind)


def whole_conversations(rows: DataFrame, kind: str) -> DataFrame:
    """One stream per task, sorted by conversation and turn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, batches = peek(batches)
        if first is None:
            return
        found = groupby(marked_rows(batches), key=lambda r: r[0])
        yield from batches_of((out for conv, own in found for out in solve(conv, (r for _, r in own))), repaired_types(first.schema.field("conv_id").type))

    ordered = rows.repartition("conv_id").sortWithinPartitions(*ORDER, F.col("fault") != "mark")
    return ordered.mapInArrow(run, REPAIRED.format(kind=kind))


def peek(batches: Iterable[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, Iterator[pa.RecordBatch]]:
    batches = iter(batches)
    first = next(batches, None)
    return first, iter(()) if first is None else chain_first(first, batches)


def chain_first(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def ranged_conversations(rows: DataFrame, kind: str) -> DataFrame:
    """Long conversations: ranges of rows in the checkpoint, a table of costs per range, then all ranges at once."""
    ordered = rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER, F.col("fault") != "mark")
    ordered = cut(ordered).withColumn("part", F.spark_partition_id())

    def tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept = None, []

        def parts(batches):
            nonlocal part
            for batch in batches:
                part = batch.column(batch.schema.get_field_index("part"))[0].as_py() if batch.num_rows else part
                yield batch

        for conv, own in groupby(marked_rows(parts(batches)), key=lambda r: r[0]):
            walks = [Walk(e) for e in range(4)]
            for _, row in own:
                ways = edges_of(row[1], row[3])
                for walk in walks:
                    for _ in walk.step((), ways):
                        pass
            cells = [[w.alive[x].cost if x in w.alive else None for x in range(4)] + [w.alive[x].rank if x in w.alive else None for x in range(4)] for w in walks]
            kept = [*kept[:1], (conv, part, [c for cell in cells for c in cell])]  # only the first and the last can go on elsewhere
        if kept:
            yield pa.RecordBatch.from_pydict({"conv_id": [k[0] for k in kept], "part": pa.array([k[1] for k in kept], pa.int32()), "cells": [k[2] for k in kept]})

    found = ordered.mapInArrow(tables, f"conv_id {kind}, part int, cells array<bigint>").orderBy("part").collect()
    ways = passages(found)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, batches = peek(batches)
        if first is None:
            return
        part = first.column(first.schema.get_field_index("part"))[0].as_py()
        rows = (
            out
            for conv, own in groupby(marked_rows(batches), key=lambda r: r[0])
            for out in solve(conv, (r for _, r in own), *ways.get((conv, part), (START, None)), part)
        )
        yield from batches_of(rows, repaired_types(first.schema.field("conv_id").type))

    return ordered.mapInArrow(run, REPAIRED.format(kind=kind))


def passages(found: list) -> dict[tuple, tuple[int, int | None]]:
    """Entry and exit state of every range of a conversation that spans several; the last one ends freely (None)."""
    ways: dict[tuple, tuple[int, int | None]] = {}
    for conv, ranges in groupby(sorted(found, key=lambda r: r["part"]), key=lambda r: r["conv_id"]):
        steps, alive = list(ranges), {START: (0, 0)}
        backs = []
        for r in steps:
            cells, best = r["cells"], {}
            for entry, (cost, rank) in alive.items():
                for x in range(4):
                    own, place = cells[8 * entry + x], cells[8 * entry + 4 + x]
                    if own is not None:
                        best[x] = min(best.get(x, (cost + own, rank, place, entry)), (cost + own, rank, place, entry))
            order = sorted(best, key=lambda x: best[x][1:3])
            alive = {x: (best[x][0], order.index(x)) for x in best}
            backs.append({x: best[x][3] for x in best})
        state = min(alive, key=lambda x: (alive[x][0] + INSERT * len(closing(x)), alive[x][1]))
        for k in range(len(steps) - 1, -1, -1):
            entry = backs[k][state]
            ways[conv, steps[k]["part"]] = (entry, None if k == len(steps) - 1 else state)
            state = entry
    return ways


# ---- summary -------------------------------------------------------------------------------------------------------

SUMMARY = "conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def summaries(df: DataFrame, **options: object) -> DataFrame:
    """Per conversation of ``repair(df, **options)``: missing turns, faults, illegal neighbours before repair, cost, audit
    and the hash of the repaired rows ``role:text``, joined by line feeds. An empty table: no rows.

    Made in the same pass as the repair. A hash needs one stream, so the repaired rows of long conversations are dealt by
    id once more; a task then holds a hash state and the audit, one byte a row.
    """
    short, long = repaired_parts(df, **options)
    schema = SUMMARY.format(kind=short.schema["conv_id"].dataType.simpleString())
    found = short.mapInArrow(summarise, schema)
    if long is None:
        return found
    ordered = long.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return found.unionByName(ordered.mapInArrow(summarise, schema))


def summarise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            get = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            yield from zip(*[get[n] for n in ("conv_id", "edit", "turn", "role", "text", "was_role", "fault", "cost")])

    first, batches = peek(batches)
    if first is None:
        return
    n, s = pa.int64(), pa.string()
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    types = pa.schema(list(zip(names, [first.schema.field("conv_id").type, n, n, n, n, n, n, s, s])))
    yield from batches_of((summary(conv, own) for conv, own in groupby(rows(batches), key=lambda r: r[0])), types)


def summary(conv: object, rows: Iterable[tuple]) -> tuple:
    faults, digest, audit = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, hashlib.sha256(), []
    cost = illegal = turns = kept = 0
    low = high = before = None
    for _, edit, turn, role, text, was, fault, spent in rows:
        cost += spent
        audit.append(edit)
        if edit != "I":
            faults[fault] += 1
            illegal += before is not None and before + was[:1] not in LEGAL
            before = was[:1]
            if turn is not None and turn != high:
                low, high, turns = turn if low is None else low, turn, turns + 1
        if edit != "D":
            digest.update((("\n" if kept else "") + f"{role}:{text}").encode())
            kept += 1
    gaps = 0 if low is None else high - low + 1 - turns
    return conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), digest.hexdigest()


def id_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(df: DataFrame) -> DataFrame:
    """The query's own test data: rows dropped, emptied, stripped of full stops, repeated or given the role user, by a hash."""
    roll = F.crc32(F.concat(id_text("conv_id"), F.lit(":"), id_text("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", id_text("role").alias("role"), id_text("text").alias("text"), roll.alias("_roll")).where("_roll != 0")
    text = F.when(F.col("_roll") == 1, "").when(F.col("_roll") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_roll") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_roll") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")
