"""Nearest-neighbour joins inside bounded groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring as S


def nearest_in_folder(files: DataFrame, folder: str, file: str, tokens: str, is_reference: str) -> DataFrame:
    """Closest other file per file; when a folder has exactly one reference, the distance to that one.

    The folder size is part of the contract (a folder holds the few outputs of one score). The reference case joins
    one row per file; only folders without a single reference compare their few files with each other.
    """
    refs = files.groupBy(folder).agg(F.count_if(F.col(is_reference)).alias("_refs"))
    tagged = files.join(refs, folder)
    other = tagged.select(
        folder, F.col(file).alias("other"), F.col(tokens).alias("_other"), F.col(is_reference).alias("_other_ref")
    )
    pairs = tagged.join(other, folder).where(
        (F.col(file) != F.col("other"))
        & ((F.col("_refs") != 1) | (F.col("_other_ref") & ~F.col(is_reference)))
    )
    scored = pairs.select(folder, file, "other", S.token_distance(F.col("_other"), F.col(tokens)).alias("diff"))
    best = scored.groupBy(folder, file).agg(F.min(F.struct("diff", "other")).alias("_b"))
    return best.select(folder, file, "_b.other", "_b.diff")
