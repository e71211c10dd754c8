"""Peaks of short numeric series (one projection profile per key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

SEQ = ("seq_id",)


def zero_padded(rows: DataFrame, keys=SEQ, value: str = "value") -> DataFrame:
    """A zero before and after each series, so that peaks at the edges stand out."""
    ends = rows.groupBy(*keys).agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"))
    pads = ends.select(*keys, F.explode(F.array(F.col("_lo") - 1, F.col("_hi") + 1)).alias("pos"), F.lit(0.0).alias(value))
    return rows.select(*keys, "pos", value).unionByName(pads)


def z_scores(rows: DataFrame, keys=SEQ, value: str = "value") -> DataFrame:
    part = W.partitionBy(*keys)
    return rows.withColumn("z", F.try_divide(F.col(value) - F.avg(value).over(part), F.stddev_pop(value).over(part)))


def local_maxima(rows: DataFrame, value: str, keys=SEQ) -> DataFrame:
    """Plateaus above both neighbours, at their midpoint; the ends of a series are never peaks."""
    w = W.partitionBy(*keys).orderBy("pos")
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    runs = rows.withColumn("_new", change).withColumn("_run", F.sum("_new").over(w))
    flat = runs.groupBy(*keys, "_run").agg(F.min("pos").alias("_lo"), F.max("pos").alias("_hi"), F.first(value).alias(value))
    r = W.partitionBy(*keys).orderBy("_run")
    out = flat.withColumn("_left", F.lag(value).over(r)).withColumn("_right", F.lead(value).over(r))
    peaks = out.where((F.col(value) > F.col("_left")) & (F.col(value) > F.col("_right")))
    return peaks.select(*keys, F.expr("(_lo + _hi) div 2").cast("int").alias("pos"), value)


def prominence(rows: DataFrame, peaks: DataFrame, value: str, keys=SEQ) -> DataFrame:
    """Height of each peak over the higher of the two valleys that separate it from higher ground.

    The series of a key travels as one small array; both scans stop at the first higher value.
    """
    series = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("_s"))
    joined = peaks.join(series, list(keys))
    h = F.col(value)

    left = F.filter("_s", lambda x: x["pos"] <= F.col("pos"))
    right = F.filter("_s", lambda x: x["pos"] >= F.col("pos"))
    wall_left = F.array_max(F.transform(F.filter(left, lambda x: x["v"] > h), lambda x: x["pos"]))
    wall_right = F.array_min(F.transform(F.filter(right, lambda x: x["v"] > h), lambda x: x["pos"]))
    walled = joined.withColumn("_wl", wall_left).withColumn("_wr", wall_right)
    low_left = F.array_min(
        F.transform(F.filter("_s", lambda x: (x["pos"] <= F.col("pos")) & (F.col("_wl").isNull() | (x["pos"] > F.col("_wl")))), lambda x: x["v"])
    )
    low_right = F.array_min(
        F.transform(F.filter("_s", lambda x: (x["pos"] >= F.col("pos")) & (F.col("_wr").isNull() | (x["pos"] < F.col("_wr")))), lambda x: x["v"])
    )
    return walled.withColumn("prominence", h - F.greatest(low_left, low_right)).drop("_s", "_wl", "_wr")
