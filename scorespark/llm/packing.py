"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Pieces of equal length are interchangeable, so the problem is a histogram of lengths (at most one count per length,
whatever the corpus), and a chromosome is a set of groups: patterns (lengths in one sequence) with the number of sequences
that use them. Crossover injects whole well-filled sequences of one parent into the other, removes the sequences that hold
documents which are now there twice, and puts the displaced documents back by best fit. Populations live on islands, one
task each; after every epoch each island's elite migrates to the next island. The best plan is bounded in size and
broadcast; documents take their slot by their rank among equal lengths.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, pieces_of, texts_of

Plan = dict[tuple[int, ...], int]

CAPACITY = 1024
END = 2
ISLANDS, POPULATION, EPOCHS, GENERATIONS = 6, 4, 3, 3
WELL_FILLED = 0.98

#: Beyond these ranges, or with a special token's text, character classes are left to the reference encoder.
UNUSUAL = re.compile("[^\x00-ɏ‐-‧€]|<\\|")
#: The faster encoder's expression overflows its stack on about a million white-space characters in a row.
BLANK_RUN = re.compile(r"\s{256}\s*+")
LONGEST_BLANK_RUN = 10_000


class Encoder:
    """Token ids of a vocabulary file. Everyday Latin text goes through the faster encoder of the same vocabulary (rank
    file), which gives equal ids there; any other text, and one with a very long blank run, through the tokenizer file."""

    def __init__(self, json_path: str, rank_path: str | None, pattern: str | None):
        import base64

        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.fast = None
        if rank_path:
            import tiktoken

            with open(rank_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is not None and not UNUSUAL.search(text) and not has_long_blanks(text):
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids


def has_long_blanks(text: str) -> bool:
    return any(m.end() - m.start() > LONGEST_BLANK_RUN for m in BLANK_RUN.finditer(text))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(*files: str | None) -> Encoder:
    """One encoder per worker and vocabulary."""
    if files not in _ENCODERS:
        _ENCODERS[files] = Encoder(*files)
    return _ENCODERS[files]


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` tokens: all full but the first."""
    first = n % capacity or capacity
    return [0, *range(first, n, capacity)]


def token_pieces(
    docs: DataFrame, vocabulary: tuple[str | None, ...], capacity: int = CAPACITY, end: int = END,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): ``nth`` numbers equal lengths within the task ``part``."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(*vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in pieces_of(batches, 256):
            owner, rows = [], []
            for k, text in enumerate(texts_of(batch)):
                ids = np.array([*encode(text), end], "<u4")
                for piece, start in enumerate(cuts := cut_points(len(ids), capacity)):
                    stop = cuts[piece + 1] if piece + 1 < len(cuts) else len(ids)
                    size = stop - start
                    owner.append(k)
                    rows.append((piece, start, size, zlib.crc32(ids[start:stop].tobytes()), part, seen[size]))
                    seen[size] += 1
            columns = np.array(rows, np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *map(pa.array, columns)], names)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names[1:]))


def best_fit(free: Counter, left: dict[int, int], capacity: int) -> Counter:
    """Place the lengths of ``left`` (length -> count), longest first, each into the fullest group that takes it.

    ``free`` holds groups as (room, pattern) -> count and is returned with all lengths placed. Groups of one kind are
    filled together: each takes as many of the length as fit, as one-by-one best fit would do.
    """
    rooms = sorted({room for room, _ in free})
    by_room: dict[int, list[tuple[int, ...]]] = {}
    for room, pattern in free:
        by_room.setdefault(room, []).append(pattern)

    def put(room: int, pattern: tuple[int, ...], count: int) -> None:
        if count:
            if (room, pattern) not in free:
                if room not in by_room:
                    rooms.insert(bisect_left(rooms, room), room)
                by_room.setdefault(room, []).append(pattern)
            free[room, pattern] += count

    def take(room: int, pattern: tuple[int, ...]) -> int:
        count = free.pop((room, pattern))
        by_room[room].remove(pattern)
        if not by_room[room]:
            del by_room[room]
            rooms.pop(bisect_left(rooms, room))
        return count

    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                pattern = by_room[room][-1]
                count = take(room, pattern)
            else:
                room, pattern = capacity, ()
                count = -(-n // (capacity // length))
            each = room // length
            full = min(count, n // each)
            put(room - each * length, pattern + (length,) * each, full)
            n -= full * each
            count -= full
            if count and n:
                put(room - n * length, pattern + (length,) * n, 1)
                count, n = count - 1, 0
            if pattern:
                put(room, pattern, count)
    return free


def as_plan(free: Counter) -> Plan:
    plan: Counter = Counter()
    for (_, pattern), count in free.items():
        plan[tuple(sorted(pattern, reverse=True))] += count
    return dict(plan)


def cost(plan: Plan, capacity: int) -> tuple[int, float]:
    """Sequences used, then less even filling: fuller groups leave room that a later generation can use."""
    return sum(plan.values()), -sum(c * (sum(p) / capacity) ** 2 for p, c in plan.items())


def repaired(chosen: Plan, base: Plan, demand: dict[int, int], capacity: int, rng: random.Random) -> Plan:
    """``chosen`` groups first, then as many of ``base``'s as hold no document twice; the displaced by best fit."""
    left = Counter(demand)
    free: Counter = Counter()
    order = sorted(base.items(), key=lambda x: (-sum(x[0]), rng.random()))
    for pattern, count in [*chosen.items(), *order]:
        need = Counter(pattern)
        count = min(count, *(left[x] // m for x, m in need.items()))
        if count > 0:
            free[capacity - sum(pattern), pattern] += count
            for x, m in need.items():
                left[x] -= m * count
    return as_plan(best_fit(free, {x: n for x, n in left.items() if n > 0}, capacity))


def crossover(giver: Plan, taker: Plan, demand: dict[int, int], capacity: int, rng: random.Random) -> Plan:
    """Inject a random half of the giver's well-filled groups into the taker."""
    injected = {p: c for p, c in giver.items() if sum(p) >= WELL_FILLED * capacity and rng.random() < 0.5}
    return repaired(injected, taker, demand, capacity, rng)


def mutation(plan: Plan, demand: dict[int, int], capacity: int, rng: random.Random) -> Plan:
    """Break up the worst-filled groups and some others at random."""
    fill = sorted(sum(p) for p in plan)
    limit = fill[len(fill) // 20]
    kept = {p: c for p, c in plan.items() if sum(p) > limit and rng.random() > 0.1}
    return repaired({}, kept, demand, capacity, rng)


def seeded(demand: dict[int, int], capacity: int, rng: random.Random, member: int) -> Plan:
    """First plans: best fit decreasing, then the same over a random part of exact pairs."""
    chosen: Plan = {}
    if member:
        left = Counter(demand)
        for x in rng.sample(sorted(demand), len(demand)):
            y = capacity - x
            pairs = min(left[x], left[y]) if x != y else left[x] // 2
            if pairs > 0 and rng.random() < 0.7:
                chosen[max(x, y), min(x, y)] = chosen.get((max(x, y), min(x, y)), 0) + pairs
                left[x] -= pairs
                left[y] -= pairs
    return repaired(chosen, {}, demand, capacity, rng)


def _dump(plan: Plan) -> str:
    return json.dumps([[c, *p] for p, c in plan.items()])


def _load(text: str) -> Plan:
    return {tuple(p): c for c, *p in json.loads(text)}


def evolved_plan(spark, demand: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The best plan after all epochs; islands evolve in parallel tasks and send their elite to the next island."""

    def epoch(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                for island, own in frame.groupby("island"):
                    rng = random.Random(number * 1000 + int(island))
                    people = [_load(p) for p in own["plan"] if p]
                    people += [seeded(demand, capacity, rng, m) for m in range(len(people), POPULATION)]
                    people.sort(key=lambda p: cost(p, capacity))
                    for _ in range(GENERATIONS):
                        born = []
                        for _ in range(POPULATION):
                            a, b = rng.sample(range(len(people)), 2)
                            born.append(crossover(people[a], people[b], demand, capacity, rng))
                        born.append(mutation(people[0], demand, capacity, rng))
                        people = sorted([*people, *born], key=lambda p: cost(p, capacity))[:POPULATION]
                    yield pd.DataFrame({
                        "island": [int(island)] * len(people), "place": range(len(people)),
                        "plan": [_dump(p) for p in people],
                        "groups": [cost(p, capacity)[0] for p in people], "evenness": [cost(p, capacity)[1] for p in people],
                    })

        return run

    schema = "island bigint, place bigint, plan string, groups bigint, evenness double"
    state = spark.range(ISLANDS).select(F.col("id").alias("island"), F.lit("").alias("plan"))
    for number in range(EPOCHS):
        spread = state.repartitionByRange(ISLANDS, "island")
        state = cut(spread.mapInPandas(epoch(number), schema))
        if number + 1 < EPOCHS:
            elite = state.where("place = 0").withColumn("island", (F.col("island") + 1) % ISLANDS)
            state = state.where(F.col("place") < POPULATION - 1).unionByName(elite)
    return _load(state.orderBy("groups", "evenness", "island").select("plan").first()[0])


def slots(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length, in rank order: first rank, first sequence and offset of each run of slots."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for pattern, count in sorted(plan.items(), reverse=True):
        offset = 0
        for length in pattern:
            out.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += count
            offset += length
        sequence += count
    return {length: tuple(np.array(c, np.int64) for c in zip(*runs)) for length, runs in out.items()}


def pack(
    docs: DataFrame, vocabulary: tuple[str | None, ...], capacity: int = CAPACITY, end: int = END,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces with their place: (doc_id, piece int, start, length, ids_crc32, sequence_id, offset), long unless said.

    Null and empty texts are one end token. Documents longer than ``capacity`` are cut, the first piece takes the
    remainder. Every row is packed, also rows that repeat an id or have none. Other columns of ``docs`` are not read. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, vocabulary, capacity, end, id_col, text_col))
    counts = cut(pieces.groupBy("part", "length").count())
    demand = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    plan = evolved_plan(spark, demand, capacity) if demand else {}
    runs = spark.sparkContext.broadcast(slots(plan))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(first, ["part", "length"]).withColumn("rank", F.col("first") + F.col("nth"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = runs.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                ranks, sequences, offsets = table[int(size)]
                run = np.searchsorted(ranks, rank[at], side="right") - 1
                sequence[at] = sequences[run] + rank[at] - ranks[run]
                offset[at] = offsets[run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    source = ranked.select("doc_id", F.col("piece").cast("int"), "start", "length", "ids_crc32", "rank")
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        place, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )
