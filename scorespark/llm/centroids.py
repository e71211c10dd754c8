"""Exact integer k-means; the nearest centroid is found by equal-average equal-variance search.

For vectors x and c of n components with component sums S and deviation norms V (length of the vector after its mean is
taken off), |x - c|^2 >= (S_x - S_c)^2 / n + (V_x - V_c)^2. Centroids are sorted by mean. From the place of a vector's own
mean the search goes outward, the nearer mean first: the first inequality ends it, the second skips a centroid, and only
what is left is measured, in whole numbers. Bounds are floats with a margin above their rounding error, so neither a
nearest centroid nor a tie is lost.

Tasks return one row of sums per centroid and are summed by Spark; the driver holds k centroids, nothing per vector.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces_of

SCALE = 1024
#: Largest component after scaling: 64 squared differences of twice this still fit a long.
LARGEST = 1 << 27
ROWS = 4096


def kept(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64) -> DataFrame:
    """Id and vector (array of doubles) of the rows with exactly ``dims`` components, none null or not finite."""
    vector = F.col(vector_col).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).alias("vec_id"), vector.alias("vector")).where((F.size("vector") == dims) & F.coalesce(finite, F.lit(False)))


def whole(values: np.ndarray) -> np.ndarray:
    """floor(1024 x) as integers; beyond ±``LARGEST`` (|x| over 131 072) the limit stands, so that distances fit a long."""
    return np.clip(np.floor(values * SCALE), -LARGEST, LARGEST).astype(np.int64)


def vectors_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    flat = batch.column(batch.schema.get_field_index("vector")).flatten().to_numpy(zero_copy_only=False)
    return whole(flat.reshape(-1, dims))


@dataclass
class Search:
    """Centroids prepared for the search: sorted by component sum, ties by number."""

    centroids: np.ndarray

    def __post_init__(self) -> None:
        self.order = np.argsort(self.centroids.sum(axis=1), kind="stable")
        self.rows = self.centroids[self.order]
        self.sums = self.rows.sum(axis=1).astype(float)
        self.norms = deviation(self.rows)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of and squared distance to the nearest centroid (the smaller number on a tie), per row of ``x``."""
        n, dims = x.shape
        sums, norms = x.sum(axis=1).astype(float), deviation(x)
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, len(self.rows))
        right = np.searchsorted(self.sums, sums)
        left = right - 1
        open_rows = np.arange(n)
        while len(open_rows):
            lo, hi = left[open_rows], right[open_rows]
            below = np.where(lo >= 0, sums[open_rows] - self.sums[np.maximum(lo, 0)], np.inf)
            above = np.where(hi < len(self.sums), self.sums[np.minimum(hi, len(self.sums) - 1)] - sums[open_rows], np.inf)
            nearer = below <= above
            gap = np.where(nearer, below, above) ** 2 / dims
            going = np.isfinite(gap) & ~beyond(gap, best[open_rows])
            open_rows, at, gap = open_rows[going], np.where(nearer, lo, hi)[going], gap[going]
            left[open_rows[nearer[going]]] -= 1
            right[open_rows[~nearer[going]]] += 1
            near = ~beyond(gap + (norms[open_rows] - self.norms[at]) ** 2, best[open_rows])
            rows, at = open_rows[near], at[near]
            distance = ((x[rows] - self.rows[at]) ** 2).sum(axis=1)
            wins = (distance < best[rows]) | ((distance == best[rows]) & (self.order[at] < number[rows]))
            best[rows[wins]], number[rows[wins]] = distance[wins], self.order[at[wins]]
        return number, best


def deviation(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - rows.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))


def beyond(bound: np.ndarray, best: np.ndarray) -> np.ndarray:
    """The bound is above the best distance by more than its rounding error."""
    return bound * (1 - 1e-9) - 1 > best


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hash of seed and id (a null id is empty text), repeated ids by components."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([whole(np.array(r["vector"])) for r in vectors.orderBy(digest, "vector").limit(k).collect()], dtype=np.int64)


def round_sums(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and component sums of the vectors nearest to each centroid."""
    dims = centroids.shape[1]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, counts, totals = Search(centroids), np.zeros(len(centroids), np.int64), [[0] * dims for _ in centroids]
        for batch in pieces_of(batches, ROWS):
            x = vectors_of(batch, dims)
            number, _ = search.nearest(x)
            for c in np.unique(number):
                mine = x[number == c]
                counts[c] += len(mine)
                totals[c] = [a + b for a, b in zip(totals[c], mine.sum(axis=0).tolist())]
        filled = [(int(c), int(counts[c]), i, t) for c in np.nonzero(counts)[0] for i, t in enumerate(totals[c])]
        if filled:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*filled)], names=["cluster", "n", "component", "total"])

    parts = vectors.mapInArrow(sums, "cluster bigint, n bigint, component bigint, total bigint")
    found = parts.groupBy("cluster", "component").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    by_cluster: dict[int, tuple[int, list[int]]] = {}
    for r in found.collect():
        n, totals = by_cluster.setdefault(r["cluster"], (r["n"], [0] * dims))
        totals[r["component"]] = int(r["total"])
    return by_cluster


def fit(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3) -> np.ndarray:
    """Centroids after ``rounds`` rounds; one that no vector is nearest to stays where it is. No vectors: no centroids."""
    centroids = first_centroids(vectors, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for c, (n, totals) in round_sums(vectors, centroids).items():
            moved[c] = [t // n for t in totals]
        centroids = moved
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance bigint"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    dims = centroids.shape[1]

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids)
        for batch in pieces_of(batches, ROWS):
            number, best = search.nearest(vectors_of(batch, dims))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(nearest, schema)


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """Every kept vector with its cluster and distance, and the final centroids.

    Left out are vectors that are null, of another length, or with a null or non-finite component. Repeated rows and
    repeated or null ids count and return once per row; other columns are not read. Fewer than ``k`` vectors: as many
    centroids. An empty table: no rows.
    """
    vectors = kept(df, id_col, vector_col, dims)
    centroids = fit(vectors, k, rounds, seed)
    return assign(vectors, centroids), centroids


def inertias(assigned: DataFrame) -> DataFrame:
    """``assigned`` with the distance summed over its cluster and over all (at most the largest long); k rows are joined."""
    rows = cut(assigned)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_sum")).collect()

    def as_long(column: Column) -> Column:
        return F.least(column.cast("decimal(38,0)"), most).cast("long")

    own = F.lit(0).cast("decimal(38,0)")
    for r in sums:
        own = F.when(F.col("cluster") == r["cluster"], F.lit(r["_sum"]).cast("decimal(38,0)")).otherwise(own)
    total = F.lit(sum((r["_sum"] for r in sums), 0)).cast("decimal(38,0)")
    return rows.withColumns({"cluster_inertia": as_long(own), "inertia": as_long(total)})
