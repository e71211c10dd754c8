"""Token text files: one line per chord, members joined with `&`, fields separated by blanks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from . import bundles


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line). A file is read whole, as line order inside it matters; files spread over tasks."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = files.select("path", F.posexplode(F.split(F.rtrim("value"), "\n")).alias("line_no", "line"))
    return lines.where("line <> ''")


def parse_lines(lines: DataFrame, keys, text: str = "line") -> DataFrame:
    """One row per member: line_no, member_no (from 0), the six fields, and `error` for a wrong number of fields.

    Six fields are complete; five lack the position (upper); four lack slur and position. Members with `tieSlur` are
    dropped, but keep their number, so that a later member still counts as following.
    """
    members = lines.select(*keys, "line_no", F.posexplode(F.split(text, "&")).alias("member_no", "entry"))
    kept = members.where(~F.col("entry").contains("tieSlur"))
    parts = F.filter(F.split("entry", r"\s+"), lambda p: p != "")
    split = kept.withColumn("_p", parts).withColumn("_n", F.size("_p"))

    def field(i: int):
        return F.try_element_at("_p", F.lit(i))

    ok = F.col("_n").between(4, 6)
    return split.select(
        *keys,
        "line_no",
        "member_no",
        F.when(ok, field(1)).alias("rhythm"),
        F.when(ok, field(2)).alias("pitch"),
        F.when(ok, field(3)).alias("lift"),
        F.when(ok, field(4)).alias("articulation"),
        F.when(F.col("_n") == 4, F.lit(".")).when(ok, field(5)).alias("slur"),
        F.when(F.col("_n") < 6, F.lit("upper")).when(ok, field(6)).alias("position"),
        F.when(~ok, F.concat(F.lit("fields: "), F.col("_n").cast("string"))).alias("error"),
    ).withColumn("position", F.when(F.col("error").isNull(), F.col("position")))


def with_markers(parsed: DataFrame, keys) -> DataFrame:
    """Flat token sequence: an explicit `chord` row before every member after the first. `pos` orders the rows.

    `pos` needs no window: line number and member number already order the tokens, two slots per member.
    """
    fields = V.TOKEN_FIELDS
    marker = F.struct(F.lit(0).alias("slot"), F.lit("chord").alias("rhythm"), *[F.lit(".").alias(f) for f in fields[1:]])
    token = F.struct(F.lit(1).alias("slot"), *[F.col(f).alias(f) for f in fields])
    rows = parsed.where("error is null").select(
        *keys, "line_no", "member_no", F.explode(F.when(F.col("member_no") > 0, F.array(marker, token)).otherwise(F.array(token))).alias("_t")
    )
    pos = F.struct(F.col("line_no"), F.col("member_no"), F.col("_t.slot").alias("slot"))
    return rows.select(*keys, pos.alias("pos"), "line_no", "member_no", "_t.*").drop("slot")


def write_lines(lines: DataFrame, path: str, score: str, line_no: str = "chord_id", **options: object) -> None:
    """Chord lines (score, line number, line) as a text bundle: all scores of a bucket in few files, sorted inside."""
    bundles.write(lines, path, score, line_no, "line", **options)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """(score, line_no, line, error) of a bundle of token lines; damaged lines have an error only."""
    return bundles.read(spark, path).select(F.col("entry").alias("score"), F.col("number").alias("line_no"), F.col("value").alias("line"), "error")
