"""Hand-written cases for tokens, chords, measures, scoring and mixing."""

import itertools
import random

from pyspark.sql import functions as F

from scorespark.functions import durations as DU
from scorespark.functions import text as X
from scorespark.functions import tokens as T
from scorespark.functions import vocabulary as V
from scorespark.operators import chords as C
from scorespark.operators import sampling, scoring, vocab_table
from scorespark.operators import windows as N
from scorespark.sources import datasets, token_lines

FIELDS = V.TOKEN_FIELDS


def tokens(spark, *rows):
    """rows: text of one token each; short ones are filled with the not-applicable mark."""
    data = [("s", i, *(r.split() + ["."] * 6)[:6]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "seq_id string, pos int, " + ", ".join(f"{f} string" for f in FIELDS))


def values(spark, names, column):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, x string")
    return [r[0] for r in df.select(column(F.col("x")).alias("y"), "i").orderBy("i").collect()]


def test_tuplets(spark):
    names = ["note_12", "note_12.", "note_28", "note_20", "rest_12", "note_4", "note_16", "clef_F4", "note_0", "rest_3m"]
    assert values(spark, names, T.without_tuplet) == [
        "note_8", "note_8.", "note_16", "note_16", "rest_8", "note_4", "note_16", "clef_F4", "note_0", "rest_2m",
    ]
    flags = values(spark, names, T.is_tuplet)
    assert flags == [True] * 5 + [False] * 4 + [True]


def test_durations(spark):
    ticks = values(spark, ["note_0", "note_1", "note_2", "note_4", "note_8", "note_16", "note_12", "note_4..", "note_8G"], T.duration_ticks)
    whole = T.TICKS_PER_WHOLE
    assert ticks == [whole, whole, whole // 2, whole // 4, whole // 8, whole // 16, whole // 12, whole * 7 // 16, 0]
    d = values(spark, ["12.", "", "4m", "0"], lambda x: DU.duration(x))
    assert [(r.num, r.den, r.actual, r.normal) for r in d] == [(1, 8, 3, 2), (1, 4, 1, 1), (1, 4, 1, 1), (1, 1, 1, 1)]


def test_greatest_common_divisor(spark):
    pairs = [(a, b) for a in range(0, 40, 3) for b in range(1, 40, 4)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", DU.gcd(F.col("a"), F.col("b")).alias("g"))
    import math

    assert all(r.g == math.gcd(r.a, r.b) for r in df.collect())


def test_vocabulary(spark):
    table = vocab_table.vocabulary(spark)
    rows = {(r.branch, r.token): r.id for r in table.collect()}
    for branch, names in V.branch_tokens().items():
        assert [rows[branch, n] for n in names] == list(range(len(names)))
    assert rows["pitch", "B9"] == 2 and rows["pitch", "C0"] == 71
    assert vocab_table.faulty_tokens(table).count() == 0


def test_leading_chord_marker(spark):
    got = C.group_chords(tokens(spark, "chord", "note_4 C4", "note_4 E4", "chord", "chord", "note_4 G4", "barline"))
    assert [(r.pitch, r.chord_id, r.member) for r in got.orderBy("pos").collect()] == [
        ("C4", 0, 1), ("E4", 0, 2), ("G4", 0, 3), (".", 1, 1),
    ]


def test_hoisting(spark):
    rows = tokens(
        spark, "note_8 C4 . staccatissimo _ upper", "chord", "note_8 E5 . . . lower", "chord", "note_16 E4 . tenuto slurStart upper",
        "chord", "note_32 D4 . _ slurStart_slurStop upper",
    )
    line = C.chord_lines(C.group_chords(rows)).first().line
    assert line == (
        "note_16 E4 . staccatissimo_tenuto slurStart_slurStop upper&note_32 D4 . _ _ upper&note_8 C4 . _ _ upper"
        "&note_8 E5 . . . lower"
    )


def test_redundant_signatures(spark):
    rows = tokens(
        spark, "clef_G2 _ _ _ _ upper", "chord", "clef_F4 _ _ _ _ lower", "keySignature_0", "timeSignature/4", "note_4 C4 _ _ _ upper",
        "keySignature_0", "timeSignature/4", "clef_G2 _ _ _ _ upper", "chord", "clef_G2 _ _ _ _ lower",
    )
    kept = C.drop_redundant_signatures(C.group_chords(rows)).orderBy("pos").collect()
    assert [(r.rhythm, r.position) for r in kept] == [
        ("clef_G2", "upper"), ("clef_F4", "lower"), ("keySignature_0", "."), ("timeSignature/4", "."), ("note_4", "upper"), ("clef_G2", "lower"),
    ]


def test_accidentals(spark):
    rows = tokens(spark, "note_4 F4 #", "note_4 G4 _", "note_4 F4 _", "note_4 F4 N", "note_4 F4 _", "note_4 F4 b", "note_4 F4 ##", "barline", "note_4 F4 _")
    lifts = [r.lift for r in C.carry_accidentals(rows).orderBy("pos").collect()]
    assert lifts == ["#", "_", "#", "N", "_", "b", "b", ".", "_"]


def test_ledger_lines(spark):
    rows = tokens(spark, "note_4 C6 _ _ _ upper", "note_4 C4 _ _ _ lower")
    assert C.max_ledger_lines(rows).first().max_ledger == 2


def test_staff_merge(spark):
    rows = tokens(spark, "keySignature_1", "timeSignature/4", "clef_G2 _ _ _ _ upper", "note_16 C4 _ _ _ upper", "clef_F4 _ _ _ _ lower", "rest_4 _ _ _ _ lower", "repeatStart")
    merged = N.merge_staves(rows.withColumn("onset", F.lit(0))).orderBy("onset", "rank", "pos", "slot").collect()
    assert [r.rhythm for r in merged] == [
        "repeatStart", "clef_G2", "chord", "clef_F4", "keySignature_1", "timeSignature/4", "note_16", "chord", "rest_4", "barline",
    ]


def test_tie_on_short_sequences(spark):
    rows = tokens(spark, "note_4 C4 _ _ _", "note_4 D4 _ _ _", "tieSlur", "note_4 E4 _ _ _", "tieSlur", "note_4 F4 _ _ _", "barline")
    got = N.fold_ties(rows).orderBy("pos").collect()
    assert [(r.pitch, r.slur) for r in got] == [("C4", "_"), ("D4", "slurStart"), ("E4", "slurStart_slurStop"), ("F4", "slurStop"), (".", ".")]


def test_token_lines(spark, tmp_path):
    path = tmp_path / "a.tokens"
    path.write_text("clef_G1 _ _ _ upper&clef_F3 _ _ _ lower\ntieSlur . . .&note_4 C4 _ _\nnote_4 C4 _ _ _ upper\na b\n")
    parsed = token_lines.parse_lines(token_lines.read_lines(spark, str(path)), ["path"])
    rows = parsed.orderBy("line_no", "member_no").collect()
    assert [(r.rhythm, r.slur, r.position, r.error) for r in rows] == [
        ("clef_G1", "upper", "upper", None), ("clef_F3", "lower", "upper", None), ("note_4", ".", "upper", None), ("note_4", "_", "upper", None), (None, None, None, "fields: 2"),
    ]
    flat = token_lines.with_markers(parsed, ["path"]).orderBy("pos").collect()
    assert [r.rhythm for r in flat] == ["clef_G1", "chord", "clef_F3", "chord", "note_4", "note_4"]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            previous, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, previous + (x != y))
    return row[-1]


def test_token_distance_against_brute_force(spark):
    rng = random.Random(5)
    words = ["é" * i + "x" for i in range(1, 9)]
    pairs = [([rng.choice(words) for _ in range(rng.randrange(12))], [rng.choice(words) for _ in range(rng.randrange(12))]) for _ in range(60)]
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", scoring.token_distance(F.col("a"), F.col("b")).alias("d"))
    assert all(r.d == plain_distance(r.a, r.b) for r in df.collect())


def test_assignment_against_brute_force():
    rng = random.Random(7)
    for n in range(1, 6):
        for _ in range(30):
            cost = [[rng.randrange(6) for _ in range(n)] for _ in range(n)]
            best = min(itertools.permutations(range(n)), key=lambda p: (sum(cost[i][j] for i, j in enumerate(p)), p))
            assert scoring._assignment(cost) == list(best)
    many = [[(i * 7 + j * 3) % 11 for j in range(10)] for i in range(10)]
    assert sorted(scoring._assignment(many)) == list(range(10))


def test_part_order_does_not_matter(spark):
    bass, treble = ["C2", "D2", "E2"], ["C5", "D5", "E5"]
    part = lambda names: [(("note_4", p, "_", "_", "_")) for p in names]
    kind = "array<array<struct<rhythm: string, pitch: string, lift: string, articulation: string, slur: string>>>"
    df = spark.createDataFrame([("s", [part(bass), part(treble)], [part(treble), part(bass)])], f"sample string, expected {kind}, actual {kind}")
    row = scoring.score_samples(df, "sample").first()
    assert (row.distance, row.ned) == (0, 0.0)


def test_quotas():
    assert sampling.quotas([7, 5, 3], [0.5, 1, 1], 10) == [2, 5, 3]
    assert sampling.quotas([10, 10], [1, 1], 30) == [10, 10]
    assert sampling.quotas([100, 1, 50], [0.1, 5, 1], 60) == [9, 1, 50]
    assert sampling.quotas([5, 5, 0], [1, 0, 3], 8) == [5, 0, 0]
    assert sampling.quotas([], [], 3) == [] and sampling.quotas([4], [2.0], 0) == [0]
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 6)
        sizes, weights, wanted = [rng.randint(0, 40) for _ in range(n)], [rng.choice([0.5, 1.0, 2.0, 3.5]) for _ in range(n)], rng.randint(0, 150)
        taken = sampling.quotas(sizes, weights, wanted)
        assert sum(taken) == min(wanted, sum(sizes)) and all(0 <= t <= s for t, s in zip(taken, sizes))
        lasting = [t / w for t, s, w in zip(taken, sizes, weights) if t < s]
        level = max(lasting, default=0)
        assert all(t == s or level - t / w <= (n + 1) / min(weights) for t, s, w in zip(taken, sizes, weights))


def test_quota_mix(spark):
    rows = spark.createDataFrame([(f"s{n}", n * 100 + i) for n, size in ((0, 7), (1, 5), (2, 3)) for i in range(size)], "source string, key int")
    mixed = sampling.mix_sources(rows, "source", "key", {"s0": 0.5, "s1": 1.0, "s2": 1.0}, 10)
    assert {r.source: r["count"] for r in mixed.groupBy("source").count().collect()} == {"s0": 2, "s1": 5, "s2": 3}


def test_texts(spark):
    assert values(spark, ["", "60 BPM", "= 60", "= 60 J", "Tabi", "Arranged byAnimenz"], X.is_tempo_marking) == [True] * 4 + [False] * 2
    assert values(spark, ["staccato", "accent_staccato", "fermata_turn", "accent", ".", "_"], T.without_unreliable) == ["_", "accent", "fermata", "accent", ".", "_"]
    assert values(spark, ["a\t4c\n", "!! x\n\n4c\t4d", "**kern\n4c", ""], datasets.with_kern_header) == [
        "**kern\t**kern\na\t4c\n", "**kern\t**kern\n!! x\n\n4c\t4d", "**kern\n4c", "",
    ]
