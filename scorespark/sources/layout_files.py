"""Layout text files: one staff per line, `class cx cy w h`, all relative to the page size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bundles


def to_line(width: float, height: float, digits: int | None = None) -> Column:
    """Text of one staff; all digits by default, so that reading gives the same box."""

    def share(name: str, size: float) -> Column:
        value = F.col(name) / size
        return value.cast("string") if digits is None else F.format_string(f"%.{digits}f", value)

    return F.concat_ws(
        " ", F.col("class").cast("string"), share("cx", width), share("cy", height), share("w", width), share("h", height)
    )


def parse_lines(lines: DataFrame, width: float, height: float, text: str = "line") -> DataFrame:
    """Page boxes in whole units (truncated); lines without exactly five numbers are skipped."""
    parts = F.split(F.trim(text), r"\s+")
    v = F.transform(parts, lambda p: p.try_cast("double"))
    ok = lines.withColumn("_v", v).where((F.size("_v") == 5) & F.forall("_v", lambda x: x.isNotNull()))
    x, y, w, h = (F.col("_v")[i] * size for i, size in ((1, width), (2, height), (3, width), (4, height)))
    out = ok.withColumn("grand", F.col("_v")[0] != 0)
    out = out.withColumn("x1", (x - w / 2).cast("int")).withColumn("y1", (y - h / 2).cast("int"))
    return out.withColumn("x2", (F.col("x1") + w).cast("int")).withColumn("y2", (F.col("y1") + h).cast("int")).drop("_v")


def read_layout(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))
    return parse_lines(lines, width, height)


def write_layout(boxes: DataFrame, path: str, width: float, height: float, order: str, digits: int | None = None, **options: object) -> None:
    """Boxes of pages as a text bundle: a line per staff, in the order of a column."""
    bundles.write(boxes, path, "page", order, to_line(width, height, digits), **options)


def read_bundle(spark: SparkSession, path: str, width: float, height: float) -> DataFrame:
    """Page boxes of a bundle, with page and number of the line; damaged lines are skipped like unreadable ones in a file."""
    lines = bundles.read(spark, path).where("error IS NULL").select(F.col("entry").alias("page"), "number", F.col("value").alias("line"))
    return parse_lines(lines, width, height)
