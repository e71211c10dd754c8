"""Two-level scans against the plain windows, with blocks far smaller than the sequences."""

import random

import pytest
from pyspark.sql import functions as F

from scorespark.operators import chords as C
from scorespark.operators import segments as S
from scorespark.operators import windows as N
from scorespark.plans import bindings as B

SIZES = [1, 7, 64, 1 << 16]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def tokens(spark, sf_dir):
    long = B.evt(spark, sf_dir).withColumns({"seq_id": F.when(F.col("user_id") % 3 > 0, F.lit(1)), "pos": F.col("event_id")})
    return long.checkpoint()


@pytest.mark.parametrize("size", SIZES)
def test_carried_state(tokens, size):
    assert rows_of(S.carry_accidentals(tokens, size=size), "seq_id", "pos", "lift") == rows_of(C.carry_accidentals(tokens), "seq_id", "pos", "lift")
    assert rows_of(S.ledger_lines(tokens, size=size), "seq_id", "pos", "ledger") == rows_of(C.ledger_lines(tokens), "seq_id", "pos", "ledger")
    assert rows_of(S.drop_redundant_signatures(tokens, size=size), "seq_id", "pos") == rows_of(C.drop_redundant_signatures(tokens), "seq_id", "pos")
    documents = tokens.where("seq_id = 1").withColumn("doc", F.expr("pos div 50"))
    names = ("seq_id", "doc", "pos", "kind", "rhythm")
    assert rows_of(S.carry_signatures(documents, size=size), *names) == rows_of(N.carry_signatures(documents), *names)


@pytest.mark.parametrize("size", SIZES)
def test_onsets(spark, size):
    rng = random.Random(size)
    kinds = ["note", "note", "chord", "chord", "symbol", "bar", "clef", "move"]
    rows = [(s, p, k := rng.choice(kinds), rng.randint(-3, 9) if k == "move" else rng.randint(0, 4), rng.random() < 0.7, f"x{p}")
            for s, n in ((1, 300), (2, 40), (None, 25)) for p in sorted(rng.sample(range(400), n))]
    df = spark.createDataFrame(rows, "seq_id int, pos int, kind string, duration int, visible boolean, name string")
    names = ("seq_id", "pos", "onset", "broken", "name")
    assert rows_of(S.onsets(df, size=size), *names) == rows_of(N.onsets(df), *names)


def test_a_hot_sequence_stays_in_blocks(spark):
    """One sequence of 200 000 rows: no task of the last stage sorts more than a few blocks."""
    n, size = 200_000, 4096
    df = spark.range(n).select(F.lit(1).alias("seq_id"), F.col("id").alias("pos"), F.when(F.col("id") % 1000 == 0, F.col("id")).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = S.last_before(S.with_blocks(df, size=size), ["seq_id"], F.col("v"), "last", inclusive=True).withColumn("task", F.spark_partition_id())
        assert out.where(F.col("last") != F.floor(F.col("pos") / 1000) * 1000).count() == 0
        most = out.groupBy("task").count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert most < n * 0.7


def test_empty(spark):
    df = spark.createDataFrame([], "seq_id int, pos int, kind string, duration int, visible boolean")
    assert S.onsets(df).collect() == []
    assert S.last_before(S.with_blocks(df), ["seq_id"], F.col("kind"), "k").collect() == []


def test_chord_members_that_no_head_comes_before(spark):
    """Each starts at the clock and moves it on, as in the SQL twin of wn08; the long form says the same."""
    rows = [(1, n, *r, True) for n, r in enumerate([("move", 45), ("chord", 16), ("chord", 68), ("move", 5), ("chord", 2), ("note", 87), ("chord", 3), ("chord", 4)])]
    df = spark.createDataFrame(rows, "seq_id bigint, pos int, kind string, duration int, visible boolean")
    want = [0, 45, 61, 129, 134, 136, 136, 136]
    for found in (N.onsets(df), *(S.onsets(df, size=size) for size in (1, 2, 3, 50))):
        assert [r["onset"] for r in found.orderBy("pos").collect()] == want
