"""Shared column rules and small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorespark.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo the divisor; a null id counts as the empty text (crc32 0)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet."""
    while base in df.columns:
        base = f"_{base}"
    return base


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder: later reads survive the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def hash_sample(df: DataFrame, key: str, at_most: int) -> DataFrame:
    """About ``at_most`` rows (all, where there are fewer), picked by a hash of the key: the same rows in any layout."""
    n = df.count()
    if n <= at_most:
        return df
    share = int(at_most / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) < share)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, at_most: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Texts with their 0/1 label, from at most about ``at_most`` labelled ids outside the held-out fold (remainder 0).

    Rows of ``labels`` that repeat an id are averaged, null labels and ids are dropped. The sampled ids are bounded, so
    they are broadcast to the texts and no text is shuffled.
    """
    ids = (
        labels.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & (id_remainder("_id", 5) != 0))
        .groupBy("_id")
        .agg(F.avg("_label").alias("_label"))
    )
    ids = hash_sample(ids, "_id", at_most)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "_id").select(
        F.col("_id").alias("doc_id"), "text", (F.col("_label") >= 0.5).cast("int").alias("label")
    )


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def pieces_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most ``rows`` rows, to bound what a step holds."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def with_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """The batch with the named columns set or added."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in columns.items():
        if name in names:
            arrays[names.index(name)] = array
        else:
            names.append(name)
            arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def sorted_groups(batches: Iterable[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, list[list]]]:
    """Runs of equal ``key`` in batches sorted by it: the key and, per other column, its values."""
    current, held = None, []
    for batch in batches:
        columns = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
        others = [columns[n] for n in columns if n != key]
        for row, k in enumerate(columns[key]):
            if k != current:
                if held:
                    yield current, held
                current, held = k, [[] for _ in others]
            for store, values in zip(held, others):
                store.append(values[row])
    if held:
        yield current, held
