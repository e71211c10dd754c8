"""Alignment events against the standard library's matcher, token by token."""

import difflib
import random

from scorespark.operators import alignment, scoring, table_functions

KIND = "id int, e array<string>, a array<string>"


def brute(e, a):
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, e, a, autojunk=False).get_opcodes():
        ks = range(max(i2 - i1, j2 - j1))
        for k in ks:
            i, j = (i1 + k if i1 + k < i2 else None), (j1 + k if j1 + k < j2 else None)
            kind = "match" if tag == "equal" else "delete" if j is None else "insert" if i is None else "substitute"
            out.append((kind, i, j))
    return out


def found(spark, pairs):
    rows = alignment.aligned(spark.createDataFrame(pairs, KIND), ["id"], "e", "a").collect()
    out = {p[0]: [] for p in pairs}
    for r in sorted(rows, key=lambda r: r["event_no"]):
        assert r["event_no"] == len(out[r["id"]])
        out[r["id"]].append((r["event_type"], r["i"], r["j"]))
    return out


def test_events_equal_the_matcher(spark):
    rng = random.Random(3)
    word = lambda letters, n: [rng.choice(letters) for _ in range(rng.randrange(n))]
    pairs = [(n, word(letters, size), word(letters, size)) for n, (letters, size) in enumerate([("ab", 12), ("abc", 25), ("abcdefgh", 40), ("abcdefghijklmnop", 80)] * 20)]
    pairs += [(1000, ["a"] * 60, ["a"] * 45), (1001, list("abab" * 12), list("baba" * 12)), (1002, list(map(str, range(300))), list(map(str, range(299, -1, -1))))]
    got = found(spark, pairs)
    for n, e, a in pairs:
        assert got[n] == brute(e, a), (e, a)


def test_awkward_pairs(spark):
    pairs = [(1, [], []), (2, None, ["x"]), (3, ["x"], None), (4, ["x", None], ["x", None]), (None, ["x"], ["x"]), (5, None, None)]
    got = found(spark, pairs)
    assert got == {
        1: [], 2: [("insert", None, 0)], 3: [("delete", 0, None)], 4: [("match", 0, 0), ("substitute", 1, 1)], None: [("match", 0, 0)], 5: [],
    }
    assert alignment.aligned(spark.createDataFrame([], KIND), ["id"], "e", "a").collect() == []


def test_inserted_token_does_not_shift_what_follows(spark):
    part = lambda names: [("note_4", p, "_", "_", "_") for p in names]
    kind = "array<struct<rhythm: string, pitch: string, lift: string, articulation: string, slur: string>>"
    parts = spark.createDataFrame([("s", 0, 2, part("CDEFG"), part("CXDEF"))], f"sample string, part int, n_parts int, expected {kind}, actual {kind}")
    rows = scoring.alignment_events(parts, ["sample"]).orderBy("event_no").collect()
    assert [(r["event_type"], r["exp_pitch"], r["act_pitch"], r["staff"]) for r in rows] == [
        ("match", "C", "C", "upper"), ("insert", None, "X", "upper"), ("match", "D", "D", "upper"), ("match", "E", "E", "upper"),
        ("match", "F", "F", "upper"), ("delete", "G", None, "upper"),
    ]


def test_table_function_equals_the_matcher(spark):
    rng = random.Random(8)
    pairs = [(n, [rng.choice("abc") for _ in range(rng.randrange(20))], [rng.choice("abc") for _ in range(rng.randrange(20))]) for n in range(25)]
    blocks = [(str(n), b.a, b.b, b.size) for n, e, a in pairs for b in difflib.SequenceMatcher(None, e, a, autojunk=False).get_matching_blocks()]
    table_functions.register(spark)
    rows = spark.createDataFrame(blocks, "pair string, i int, j int, size int")
    found = spark.sql("SELECT * FROM aligned_events(TABLE({rows}) PARTITION BY pair ORDER BY (i, j))", rows=rows).collect()
    for n, e, a in pairs:
        own = sorted((r for r in found if r["pair"] == str(n)), key=lambda r: r["event_no"])
        assert [(r["event_type"], r["i"], r["j"]) for r in own] == brute(e, a)
