"""Layout operators on small pages, several against brute force."""

import random

from pyspark.sql import functions as F

from scorespark.functions import geometry as G
from scorespark.operators import graphs, layout, ranking


def boxes(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "page int, box_id bigint, cx double, cy double, w double, h double, angle double")


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(0, 500), rng.uniform(0, 500), rng.uniform(5, 150), rng.uniform(5, 90), 0.0) for i in range(60)]
    df = boxes(spark, rows)
    got = {(r.a_box_id, r.b_box_id) for r in layout.overlapping_pairs(df, df).collect()}
    pairs = [(r.a_box_id, r.b_box_id) for r in layout.overlapping_pairs(df, df).collect()]
    want = {(a[0], b[0]) for a in rows for b in rows if abs(a[1] - b[1]) <= (a[3] + b[3]) / 2 and abs(a[2] - b[2]) <= (a[4] + b[4]) / 2}
    assert got == want and len(pairs) == len(want)


def test_crossing_rectangles_without_inner_corners(spark):
    df = boxes(spark, [(1, 0.0, 0.0, 100.0, 4.0, 10.0), (2, 0.0, 0.0, 100.0, 4.0, -10.0), (3, 0.0, 60.0, 10.0, 4.0, 0.0)])
    a = df.select(*[F.col(c).alias("a_" + c) for c in df.columns])
    b = df.select(*[F.col(c).alias("b_" + c) for c in df.columns])
    hit = a.crossJoin(b).where("a_box_id < b_box_id").where(G.boxes_overlap(G.box("a_"), G.box("b_")))
    assert [(r.a_box_id, r.b_box_id) for r in hit.collect()] == [(1, 2)]


def test_regions(spark):
    regions = spark.createDataFrame([(1, 100, 200), (1, 300, 400), (1, 500, 600), (1, 700, 800)], "page int, start int, stop int")
    probes = spark.createDataFrame([(1, i, y) for i, y in enumerate((100, 201, 500, 633, 1000))], "page int, probe_id bigint, y int")
    rows = layout.nearest_above_below(probes, regions, ["page"]).orderBy("probe_id").collect()
    assert [r.above for r in rows] == [0, 200, 400, 600, 800]
    assert rows[4].below == 1e12 and rows[1].below == 300


def test_components(spark):
    rng = random.Random(2)
    nodes = list(range(200))
    edges = [(i, i + 1) for i in range(0, 80)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((find(a), find(b)))
        parent[rb] = ra
    df = graphs.connected_components(spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"))
    assert {r.node: r.component for r in df.collect()} == {n: find(n) for n in nodes}


def test_line_chaining(spark):
    rows = [(1, 1, 100.0, 10.0, 40.0, 2.0, 0.0), (1, 2, 50.0, 10.0, 40.0, 2.0, 0.0), (1, 3, 150.0, 10.0, 40.0, 2.0, 0.0)]
    df = spark.createDataFrame(rows, "page int, box_id bigint, cx double, cy double, w double, h double, angle double").withColumn("unit", F.lit(5.0))
    got = graphs.chain_fragments(df, ["page"]).collect()
    assert {r.chain for r in got} == {0} and len(got) == 3


def test_spaced_peaks_and_pairs(spark):
    peaks = spark.createDataFrame([(1, p, h) for p, h in ((0, 3.0), (3, 5.0), (6, 4.0), (20, 1.0), (22, 1.0))], "k int, pos int, h double")
    assert sorted(r.pos for r in graphs.spaced_peaks(peaks, "k", 5).collect()) == [3, 22]
    pairs = spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 2, 0.8), (1, 2, 3, 0.7), (1, 3, 4, 0.1)], "k int, a int, b int, score double")
    assert sorted((r.a, r.b) for r in graphs.exclusive_pairs(pairs, "k").collect()) == [(1, 2), (3, 4)]


def test_voices(spark):
    events = [(1, 1, 0, 16), (1, 2, 0, 8), (1, 3, 8, 16), (1, 4, 16, 20)]
    df = spark.createDataFrame(events, "m int, ev_id bigint, start int, stop int")
    got = {r.ev_id: r.voice for r in graphs.colour_intervals(df, ["m"]).collect()}
    assert got == {2: 1, 1: 2, 3: 1, 4: 1}


def test_duplicate_staffs(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, 1), (1, 2, 5.0, 0.0, 10.0, 10.0, 3), (1, 3, 100.0, 0.0, 10.0, 10.0, 1), (1, 4, 52.0, 0.0, 100.0, 10.0, 9)]
    df = spark.createDataFrame(rows, "page int, box_id bigint, cx double, cy double, w double, h double, anchors int")
    assert sorted(r.box_id for r in graphs.distinct_staffs(df, "page").collect()) == [2, 3]


def test_line_repair(spark):
    rows = [(1, 0.0, [0.0, 10.0, 20.0, 30.0, 40.0]), (1, 10.0, [0.0, None, 20.0, 37.0, 40.0]), (1, 20.0, [None] * 5)]
    df = spark.createDataFrame(rows, "page int, x double, ys array<double>")
    got = graphs.fill_staff_lines(df, ["page"], 10.0).orderBy("x").collect()
    assert [list(r.ys) for r in got] == [[0, 10, 20, 30, 40], [0, 10, 20, 30, 40]]


def test_ranks_and_medians_of_a_hot_key(spark):
    """One key holds a third of the rows: ranks and medians stay exact."""
    rng = random.Random(4)
    data = [(0 if i % 3 == 0 else i % 7 + 1, i, round(rng.random(), 3)) for i in range(3000)]
    df = spark.createDataFrame(data, "key int, id int, x double")
    keyed = df.withColumn("d", ranking.shuffle_key(F.col("id")))
    ranked = ranking.with_rank(keyed, ["key"], ["d", "id"], ranking.hash_bucket(F.col("d"), 2)).collect()
    for key in range(8):
        mine = sorted((r.d, r.id, r["rank"]) for r in ranked if r.key == key)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))
    import statistics

    got = {r.key: r["median"] for r in ranking.median(df, ["key"], "x", F.floor(F.col("_v") * 16)).collect()}
    for key in range(8):
        assert abs(got[key] - statistics.median(x for k, _, x in data if k == key)) < 1e-12
