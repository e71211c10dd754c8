"""Inputs beyond the former limits: many parts, long names, long prologues, fractional heights, missing and slow inputs."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from scorespark.functions import text as X
from scorespark.operators import layout, producers, sampling, scoring
from scorespark.sources import kern


@pytest.mark.parametrize("n", [1, 4, 6])
def test_assignment_is_the_first_optimum(n):
    rng = random.Random(n)
    for _ in range(40):
        cost = [[rng.randint(0, 3) for _ in range(n)] for _ in range(n)]
        best = min(itertools.permutations(range(n)), key=lambda p: (sum(cost[i][p[i]] for i in range(n)), p))
        assert tuple(scoring._assignment(cost)) == best


@pytest.mark.parametrize("n", [9, 10, 12])
def test_assignment_is_exact_beyond_eight_parts(n):
    rng = random.Random(n)
    cost = [[rng.randint(0, 30) for _ in range(n)] for _ in range(n)]
    best = {0: 0}
    for row in cost:
        step = {}
        for mask, total in best.items():
            for j in range(n):
                if not mask >> j & 1:
                    key = mask | 1 << j
                    step[key] = min(step.get(key, 10**9), total + row[j])
        best = step
    chosen = scoring._assignment(cost)
    assert sorted(chosen) == list(range(n))
    assert sum(cost[i][j] for i, j in enumerate(chosen)) == best[(1 << n) - 1]


def test_long_name_and_long_prologue(spark):
    name = "-".join(["ab"] * 1500)
    comment = "<!-- " + "x" * 3000 + " -->"
    row = spark.createDataFrame(
        [(name, comment + "<score-partwise>", "!! " + "c" * 500 + "\n**dyn\t**kern", "<p>see <score-partwise></p>")], "n string, x string, k string, o string"
    ).select(
        X.camel_case(F.col("n")).alias("n"), X.is_xml(F.col("x")).alias("x"), X.is_kern(F.col("k")).alias("k"), X.is_xml(F.col("o")).alias("o")
    ).first()
    assert row["n"] == "ab" + "Ab" * 1499
    assert (row["x"], row["k"], row["o"]) == (True, True, False)


def test_nearest_regions_compare_strictly(spark):
    probes = spark.createDataFrame([(1, 1, 10.0), (1, 2, 9.5)], "page int, probe_id bigint, y double")
    regions = spark.createDataFrame([(1, 2.0, 4.0), (1, 9.5, 9.8), (1, 10.2, 10.4)], "page int, start double, stop double")
    rows = {r["probe_id"]: (r["above"], r["below"]) for r in layout.nearest_above_below(probes, regions, ["page"]).collect()}
    assert rows == {1: (9.8, 10.2), 2: (4.0, 9.5)}


def test_producer_errors_are_rows(spark):
    @producers.register("slow_or_upper")
    def slow_or_upper(text):
        if text == "slow":
            time.sleep(30)
        return text.upper()

    samples = spark.createDataFrame([("a", "x" * 5000), ("b", None), ("c", "slow")], "sample_id string, expected_text string")
    rows = {r["sample_id"]: (r["output"], r["error"]) for r in producers.run(samples, "slow_or_upper", seconds=0.5).collect()}
    assert rows["a"] == ("X" * 5000, None)
    assert rows["b"] == (None, "no input")
    assert rows["c"][0] is None and rows["c"][1].startswith("TimeoutError")


def test_last_spine_of_three_is_upper_when_merged(spark):
    text = "**kern\t**kern\t**kern\n4c\t4e\t4g\n*-\t*-\t*-"
    scores = spark.createDataFrame([("s", text)], "score string, text string")
    cells = kern.staff_cells(kern.split_documents(scores, "score"), "score", merged=True).where("cell rlike '^[0-9]'")
    assert {r["part"]: r["cell"] for r in cells.collect()} == {0: "4g", 1: "4e", 2: "4c"}


def test_unknown_tokens_are_reported_not_lost(spark):
    from scorespark.functions import vocabulary as V

    row = {f: "." for f in V.TOKEN_FIELDS} | {"rhythm": "barline"}
    tokens = [(1, 0, *row.values()), (2, 0, *(row | {"rhythm": "no such token"}).values())]
    df = spark.createDataFrame(tokens, "seq_id int, pos int, " + ", ".join(f"{f} string" for f in row))
    done = {r["seq_id"] for r in sampling.encode_sequences(df).collect()}
    left = {r["seq_id"]: r["reason"] for r in sampling.encoding_rejects(df).collect()}
    assert done | set(left) == {1, 2} and 2 in left


def test_best_word_is_found_before_anything_is_shuffled(spark, tmp_path):
    from scorespark.plans import catalog

    rows = [(1, " a bb a", 7), (2, "", 3), (3, None, 1), (4, "bb  a c", None), (5, "ccc bb dd", 9), (6, "ccc bb", -6)]
    spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.QUERIES["sl03_top_by_score"](spark, str(tmp_path))
    assert {r["doc_id"]: r["word"] for r in found.collect()} == {1: "a", 4: "bb", 5: "bb", 6: "ccc"}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
