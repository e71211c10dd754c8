"""Set containment, batch producers and the common denominator against brute force."""

import math
import random

from pyspark.sql import functions as F

from scorespark.functions import durations as DU
from scorespark.operators import containment, producers


def test_containment_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    pick = lambda n: [rng.choice(words[: rng.choice([3, 30])]) for _ in range(n)]
    sets = [(n, pick(rng.randrange(25))) for n in range(300)] + [(900, None), (901, ["w1", None])]
    items = [(n, pick(rng.randint(1, 4))) for n in range(40)] + [(90, []), (91, None), (92, ["nowhere", "w1"]), (93, ["w0", "w0", None])]
    frames = [spark.createDataFrame(r, f"{i} int, e array<string>") for r, i in ((sets, "s"), (items, "t"))]
    found = {tuple(r) for r in containment.containing(frames[0], "s", frames[1], "t", "e").collect()}
    clean = lambda x: {w for w in x or [] if w is not None}
    assert found == {(t, s) for t, need in items for s, have in sets if clean(need) and clean(need) <= clean(have)}


def test_containment_splits_a_common_element(spark):
    sets = spark.range(4000).select(F.col("id").alias("s"), F.array(F.lit("all"), F.concat(F.lit("w"), F.col("id") % 7)).alias("e"))
    items = spark.createDataFrame([(1, ["all"]), (2, ["all", "w3"])], "t int, e array<string>")
    counts = {r["t"]: r["count"] for r in containment.containing(sets, "s", items, "t", "e").groupBy("t").count().collect()}
    assert counts == {1: 4000, 2: 4000 // 7 + (1 if 4000 % 7 > 3 else 0)}


def test_batch_producer(spark):
    @producers.register_batch("doubles")
    def _doubles(texts):
        if len(texts) > 3 or "bad" in texts:
            raise RuntimeError("too many or bad")
        return [t * 2 for t in texts][: -1 if "short" in texts else None]

    rows = [(str(n), t) for n, t in enumerate(["a", None, "b", "bad", "c", "short", "d", ""])]
    samples = spark.createDataFrame(rows, "sample_id string, expected_text string").coalesce(1)
    for size in (1, 2, 3, 50):
        found = {r["sample_id"]: (r["output"], r["error"]) for r in producers.run(samples, "doubles", batch_size=size).collect()}
        assert found == {
            "0": ("aa", None), "1": (None, "no input"), "2": ("bb", None), "3": (None, "RuntimeError: too many or bad"), "4": ("cc", None),
            "5": (None, "ValueError: 0 outputs for one text"), "6": ("dd", None), "7": ("", None),
        }


def test_common_multiple_by_exponents(spark):
    whole = 2**6 * 3**2 * 5
    divisors = [d for d in range(1, whole + 1) if whole % d == 0]
    rng = random.Random(1)
    groups = {g: [rng.choice(divisors) for _ in range(rng.randint(1, 6))] for g in range(30)}
    df = spark.createDataFrame([(g, d) for g, ds in groups.items() for d in ds], "g int, d bigint")
    powers = DU.prime_powers(whole)
    assert powers == {2: 6, 3: 2, 5: 1}
    out = F.lit(1).cast("bigint")
    for p, m in powers.items():
        out = out * DU.power(p, F.max(DU.exponent(F.col("d"), p, m)), m)
    assert {r["g"]: r["x"] for r in df.groupBy("g").agg(out.alias("x")).collect()} == {g: math.lcm(*ds) for g, ds in groups.items()}


def test_containment_copies_no_set_per_element(spark):
    """Long sets: what is written grows with their elements, not with the square; rows of one id count together."""
    import glob
    import os

    size = lambda: sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/*", recursive=True) if os.path.isfile(f))
    folder = spark.sparkContext.getCheckpointDir() or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    folder = folder.removeprefix("file:")
    words = F.transform(F.sequence(F.lit(0), F.lit(1999)), lambda i: F.concat(F.lit("word"), i.cast("string"), F.col("s").cast("string")))
    sets = spark.range(200).withColumnRenamed("id", "s").withColumn("e", words)
    items = sets.select((F.col("s") + 1000).alias("t"), "e").unionByName(spark.createDataFrame([(5000, ["half", "other half"])], "t bigint, e array<string>"))
    both = sets.unionByName(spark.createDataFrame([(7000, ["half", "more"]), (7000, ["other half"])], "s bigint, e array<string>"))
    before = size()
    found = {tuple(r) for r in containment.containing(both, "s", items, "t", "e").collect()}
    assert found == {(s + 1000, s) for s in range(200)} | {(5000, 7000)}
    assert size() - before < 2_000_000  # the sets themselves are 5 MB
