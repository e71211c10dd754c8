"""SimHash near-duplicates, found by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most three bits meet in a third word: one side flips at most one bit, the other
at most two. Every distinct fingerprint emits such variants, the variants are shuffled, and fingerprints that meet in a
variant are verified and linked. Three facts keep the balls small without losing a pair:

* at distance 1 or 3 the parities of the two differ, so only odd fingerprints need two-bit flips;
* among three differing bits two lie in the same half of the word, so two-bit flips within a half are enough;
* at distance 2 both sides flip one bit.

An even fingerprint emits 64 variants, an odd one 1 057 (561 on average, whatever the corpus). In a variant's group all
that flipped at most one bit are within distance 2 of each other and within 3 of the two-bit ones, so a star around one
of them holds the same components as all pairs would; two-bit members alone are no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, pieces_of, sorted_groups, texts_of
from .components import component_roots

RADIUS = 3
SHINGLE_BLOCK = 1 << 16
BATCH = 4096
MIX = 0x9E3779B97F4A7C15
UNMIX = pow(MIX, -1, 1 << 64)
BYTES_PER_BUCKET = 16 << 20


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles: a bit is 1 where over half of the shingle hashes have it; no words give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
        starts = [0, *(e + 1 for e in ends[:-1])]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :])]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SHINGLE_BLOCK):
        block = np.array(hashes[i : i + SHINGLE_BLOCK], "<u8")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row; a null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1024):
            fps = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _flips() -> np.ndarray:
    """The flip masks by code: none, 64 single bits, then the pairs within each half."""
    single = [1 << i for i in range(64)]
    pairs = [1 << i | 1 << j for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
    return np.array([0, *single, *pairs], np.uint64)


FLIPS = _flips()
CODE_BITS = int(len(FLIPS)).bit_length()


def _spread(fps: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Variants of a batch by bucket: the leading ``bits`` of the mixed variant choose the bucket, the rest and the flip
    code are packed into eight bytes."""
    odd = np.bitwise_count(fps) & 1 == 1
    parts = []
    for chosen, codes in ((fps[~odd], np.arange(1, 65)), (fps[odd], np.arange(len(FLIPS)))):
        mixed = (chosen[:, None] ^ FLIPS[codes][None, :]) * np.uint64(MIX)
        parts.append(((mixed >> np.uint64(64 - bits)).astype(np.uint32).ravel(),
                      (mixed << np.uint64(bits) | codes.astype(np.uint64)[None, :]).ravel()))
    bucket, packed = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
    bucket, packed = bucket[order], packed[order]
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *edges], [*edges, len(bucket)]):
        if b > a:
            yield int(bucket[a]), packed[a:b].astype("<u8").tobytes()


def _meet(bucket: int, blobs: list[bytes], bits: int) -> np.ndarray:
    """Verified links (n, 2) of the fingerprints that meet in a variant of this bucket."""
    packed = np.sort(np.frombuffer(b"".join(blobs), "<u8"))
    rest = packed >> np.uint64(bits)
    first = np.flatnonzero(np.r_[True, rest[1:] != rest[:-1]])
    size = np.diff(np.r_[first, len(rest)])
    first, size = first[size > 1], size[size > 1]
    members = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    code = (packed[members] & np.uint64((1 << bits) - 1)).astype(np.int64)
    variant = (np.uint64(bucket << (64 - bits)) | rest[members]) * np.uint64(UNMIX)
    fp = variant ^ FLIPS[code]
    centre = np.repeat(np.cumsum(size) - size, size)  # codes are sorted within a variant: its least flips come first
    keep = (code[centre] <= 64) & (fp != fp[centre]) & (np.bitwise_count(fp ^ fp[centre]) <= RADIUS)
    pairs = np.stack([fp[centre][keep], fp[keep]], axis=1)
    return np.unique(np.sort(pairs, axis=1), axis=0) if len(pairs) else pairs


def links(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp long, no repeats) -> links (u, v) that span the same components as all pairs within distance 3."""
    n = distinct.count()
    bits = max(CODE_BITS, int(np.ceil(np.log2(max(1, n * 561 * 8 / BYTES_PER_BUCKET)))))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, BATCH):
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, blobs = zip(*_spread(fps, bits))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (blobs,) in sorted_groups(batches):
            pairs = _meet(bucket, blobs, bits).view(np.int64)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    return (
        distinct.select("fp")
        .mapInArrow(spread, "bucket int, blob binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(meet, "u bigint, v bigint")
    )


def _least_of_class(least: DataFrame) -> DataFrame:
    """(fp, least), one row per fingerprint, with ``least`` replaced by the least one of the fingerprint's class."""
    least = cut(least)
    linked = component_roots(links(least)).join(least.withColumnRenamed("fp", "node"), "node")
    classes = linked.groupBy("root").agg(F.min("least").alias("of_class"))
    linked = linked.join(classes, "root").select(F.col("node").alias("fp"), "of_class")
    return least.join(linked, "fp", "left").select("fp", F.coalesce("of_class", "least").alias("least"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) for every row of ``docs``.

    Rows are one class where a chain of fingerprints, each within three bits of the next, joins them; component_id is the
    least id of the class. Null and blank texts have fingerprint 0 and are linked like any other; repeated rows share
    their class; a null id takes part, but is an id of its class only if the class has no other. Columns of ``docs``
    besides id and text are not read. An empty table gives no rows.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    by_fp = _least_of_class(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return fps.join(by_fp.withColumnRenamed("least", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class: the one with the least id, of rows that repeat it the first by content.

    Columns are those of ``docs``. A row without an id is kept only if its class has no id at all. Rows are told apart by two
    hashes of their columns, so that an id that is repeated with other texts stands for each of its classes.
    """
    columns = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    keys = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    row = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), keys[0].alias("a"), keys[1].alias("b"))
    rows = fingerprints(docs.select(row.alias("row"), F.col(text_col).alias("text")), "row", "text")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    kept = _least_of_class(least).select("least.a", "least.b").distinct()
    a, b, nth = (free_name(docs, c) for c in ("key_a", "key_b", "nth"))
    keyed = docs.withColumn(a, keys[0]).withColumn(b, keys[1])
    found = keyed.join(kept.select(F.col("a").alias(a), F.col("b").alias(b)), [a, b], "left_semi")
    order = Window.partitionBy(a, b).orderBy(a)  # what is left to number are rows that are equal in every column
    return found.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def hex_digits(column: str) -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
