"""Exact ranks and medians over groups of any size.

A plain row_number() over a key sends the whole key to one task. Here every key is cut into many ordered buckets first:
count per bucket (map-side combined), running offset per bucket (a small table), row number inside a bucket only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shuffle_key(key: Column) -> Column:
    """Reproducible random order: the MD5 of the key as text."""
    return F.md5(key.cast("string"))


def hash_bucket(digest: Column, digits: int = 3) -> Column:
    """Leading hex digits: buckets of equal expected size whatever the data."""
    return F.substring(digest, 1, digits)


def with_rank(df: DataFrame, keys, order, bucket: Column, name: str = "rank", total: str | None = None) -> DataFrame:
    """Adds the rank (from 1) of each row within its keys by `order`; `bucket` must be monotone in `order`."""
    keys = list(keys)
    split = df.withColumn("_b", bucket)
    counts = split.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        F.sum("_n").over(W.partitionBy(*keys)).alias("_total"),
    )
    inside = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order))
    out = split.join(offsets, [*keys, "_b"]).withColumn(name, F.col("_offset") + inside)
    if total is not None:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_b", "_offset", "_total")


def median(df: DataFrame, keys, value: str, width: Column) -> DataFrame:
    """Exact midpoint median per key. Values are counted first, then only the middle bucket is ranked.

    `width` maps a value (column `_v`) to its bucket, monotone in the value.
    """
    return median_of_counts(value_counts(df, keys, value), keys, width)


def value_counts(df: DataFrame, keys, value: str) -> DataFrame:
    """(keys, _v, _c): how often each value occurs; combined map-side."""
    valued = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    return valued.withColumn("_v", F.col("_v").cast("double"))


def median_of_counts(valued: DataFrame, keys, width: Column) -> DataFrame:
    keys = list(keys)
    split = valued.withColumn("_b", width)
    counts = split.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    part = W.partitionBy(*keys)
    spans = counts.select(
        *keys,
        "_b",
        (F.sum("_n").over(part.orderBy("_b")) - F.col("_n")).alias("_from"),
        F.sum("_n").over(part.orderBy("_b")).alias("_to"),
        F.sum("_n").over(part).alias("_total"),
    )
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    middle = spans.where(((F.col("_from") < low) & (F.col("_to") >= low)) | ((F.col("_from") < high) & (F.col("_to") >= high)))
    ranked = split.join(middle, [*keys, "_b"]).withColumn(
        "_upto", F.col("_from") + F.sum("_c").over(W.partitionBy(*keys, "_b").orderBy("_v"))
    )
    hit = [
        F.when((F.col("_upto") - F.col("_c") < r) & (F.col("_upto") >= r), F.col("_v")) for r in (low, high)
    ]
    return ranked.groupBy(*keys).agg(((F.max(hit[0]) + F.max(hit[1])) / 2).alias("median"))
