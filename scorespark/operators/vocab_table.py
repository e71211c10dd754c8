"""The vocabulary as a table, built from its generating rules with small cross joins of constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import vocabulary as V


def _list(spark: SparkSession, values: list, group: int) -> DataFrame:
    """Constant list as rows; literals stay in the JVM plan."""
    items = F.posexplode(F.array(*[F.lit(v) for v in values])).alias("ord", "token")
    return spark.range(1).select(F.lit(group).alias("grp"), items)


def _durations(spark: SparkSession, kind: str, group: int) -> DataFrame:
    def axis(values: list, order: str, name: str) -> DataFrame:
        return spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in values])).alias(order, name))

    # constant dimension frames of 14, 2 and 3 rows
    combined = axis(V.KERN_BASES, "b", "base").crossJoin(axis(["", "G"], "g", "grace")).crossJoin(axis(["", ".", ".."], "d", "dot"))
    regular = combined.select(
        F.lit(group).alias("grp"),
        (F.col("b") * 6 + F.col("g") * 3 + F.col("d")).alias("ord"),
        F.concat(F.lit(kind + "_"), F.col("base").cast("string"), "grace", "dot").alias("token"),
    )
    return regular.unionByName(_list(spark, [f"{kind}_{b}" for b in V.IRREGULAR_BASES], group + 1))


def vocabulary(spark: SparkSession) -> DataFrame:
    """(branch, token, id). Ids follow the order of the rules."""
    head = V.CONTROL_TOKENS + V.BARLINE_TOKENS + V.REPEAT_TOKENS + V.VOLTA_TOKENS + V.CLEF_TOKENS
    keys = spark.range(-7, 8).select(
        F.lit(1).alias("grp"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("keySignature_"), "id").alias("token")
    )
    times = [f"timeSignature/{d}" for d in V.TIME_DENOMINATORS] + [f"rest_{n}m" for n in range(2, 11)]
    rhythm = _list(spark, head, 0).unionByName(keys).unionByName(_list(spark, times, 2))
    rhythm = rhythm.unionByName(_durations(spark, "note", 3)).unionByName(_durations(spark, "rest", 5))
    octaves = spark.range(10).select(F.col("id").cast("int").alias("octave"))
    letters = _list(spark, list(V.PITCH_LETTERS), 0).select(F.col("ord").alias("step"), F.col("token").alias("letter"))
    pitch = octaves.crossJoin(letters).select(
        F.lit(1).alias("grp"),
        (-(F.col("octave") * 7 + F.col("step"))).alias("ord"),
        F.concat("letter", F.col("octave").cast("string")).alias("token"),
    )
    pitch = _list(spark, [V.NOT_APPLICABLE, V.EMPTY], 0).unionByName(pitch)
    rest = {b: _list(spark, V.branch_tokens()[b], 0) for b in ("lift", "articulation", "slur", "position")}
    branches = {"rhythm": rhythm, "pitch": pitch, **rest}
    out = None
    for branch, frame in branches.items():
        tagged = frame.withColumn("branch", F.lit(branch))
        out = tagged if out is None else out.unionByName(tagged)
    order = W.partitionBy("branch").orderBy("grp", "ord")
    return out.select("branch", "token", (F.row_number().over(order) - 1).alias("id"))


def faulty_tokens(table: DataFrame) -> DataFrame:
    """Tokens a vocabulary must not hold: duplicates, blanks, surrounding space, the chord separator."""
    counted = table.groupBy("branch", "token").agg(F.count("*").alias("n"))
    bad = (F.col("n") > 1) | (F.trim("token") == "") | (F.trim("token") != F.col("token")) | F.col("token").contains("&")
    return counted.where(bad)
