"""Table functions for SQL: one partition of rows in, many rows out, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

EVENTS = "pair string, event_no int, event_type string, i int, j int"
_TYPES = pa.schema([("pair", pa.string()), ("event_no", pa.int32()), ("event_type", pa.string()), ("i", pa.int32()), ("j", pa.int32())])


@arrow_udtf(returnType=EVENTS)
class AlignedEvents:
    """Events between and in the matched blocks of one pair.

    Called with a table of blocks (columns pair, i, j, size), partitioned by pair and ordered by i and j. The last block of
    a partition has size 0 and holds the lengths of both sides.
    """

    def __init__(self) -> None:
        self.at = (0, 0)
        self.n = 0

    def eval(self, blocks: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = []
        for i, j, size in zip(*(blocks.column(blocks.schema.get_field_index(c)).to_pylist() for c in ("i", "j", "size"))):
            before_i, before_j = self.at
            more_i, more_j = i - before_i, j - before_j
            for k in range(max(more_i, more_j)):
                kind = "insert" if k >= more_i else "delete" if k >= more_j else "substitute"
                rows.append((kind, before_i + k if k < more_i else None, before_j + k if k < more_j else None))
            rows += [("match", i + k, j + k) for k in range(size)]
            self.at = (i + size, j + size)
        if rows:
            pair = blocks.column(blocks.schema.get_field_index("pair"))[0].as_py()
            numbers = range(self.n, self.n + len(rows))
            self.n += len(rows)
            columns = ([pair] * len(rows), numbers, *zip(*rows))
            yield pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _TYPES)], schema=_TYPES)


def register(spark: SparkSession) -> None:
    """``SELECT .. FROM aligned_events(TABLE(blocks) PARTITION BY pair ORDER BY (i, j))`` in SQL."""
    spark.udtf.register("aligned_events", AlignedEvents)
