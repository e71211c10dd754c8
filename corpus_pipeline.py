"""A training-corpus pipeline over ``documents``: each stage's result is written as Parquet and is the next one's input."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from scorespark.llm import decontaminate, packing, secrets, simhash, toxicity
from scorespark.llm.common import table
from scorespark.llm.queries import byte_vocabulary
from scorespark.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more for toxicity go. The labels teach the model with texts of this stage's own input.

    Null and empty texts score like a text without windows, rows that repeat alike; null ids have no label. Without labels of
    both kinds nothing, or everything, is as toxic as the labels say. An empty table stays empty.
    """
    ensure_checkpoint_dir(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class stays: the one with the smallest id, a null id last.

    Null, empty and blank texts are one class; repeated rows are one class and one of them stays. An empty table stays empty.
    """
    ensure_checkpoint_dir(spark)
    return simhash.keep_first(docs)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur in the benchmark are cut out of the texts; the number of characters follows.

    Every row stays, null texts as they are; a text that is all passage becomes one without words. Items without words, and
    an empty benchmark, cut nothing. An empty table stays empty.
    """
    cleaned = decontaminate.remove_overlaps(docs, table(spark, sf_dir, "benchmark"))
    return secrets.with_length(cleaned)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the number of characters follows. Every row stays, null and empty texts as they are;
    an empty table stays empty."""
    return secrets.with_length(secrets.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, as pieces with their place in training sequences.

    A null or empty text is its end token alone; repeated rows are placed each; null ids stay null. An empty table gives no
    pieces.
    """
    ensure_checkpoint_dir(spark)
    return packing.pack(docs, byte_vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark_passages),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Trained scores, SimHash classes and the packing plan are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows are cut off in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    return reduce(lambda d, stage: stage[1](spark, d if d is docs else d.checkpoint(), sf_dir), STAGES, docs)
