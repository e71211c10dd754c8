"""Importing the query modules fills the registry."""

from . import (  # noqa: F401
    corpus_queries,
    ingest_queries,
    layout_queries,
    long_queries,
    mixing_queries,
    scoring_queries,
    sequence_queries,
    window_queries,
)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
