"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped hash arrays.

A word is the leading 48 bits of its XXH64. Training texts give pairs (word before, word); a pair's bucket comes from a
reversible mix of both words, so a frequent word before is spread over all buckets. Tasks sort and count pairs in chunks,
buckets merge the chunks, and each merged bucket is written as sorted 32-bit hashes with counts. From the merged pairs
follow, by word, its count, its continuation count and the totals of its followers; these are merged in a second shuffle
and written as sorted hash arrays too. Scoring tasks map the files and look whole batches up at once.

Files lie in the shared checkpoint folder, which executors must see as a file path; each is written under another name and
then renamed, so a task that runs again replaces it by the same content.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorespark.session import ensure_checkpoint_dir

from .common import cut, pieces_of, sorted_groups, texts_of

WORD_BITS = 48
WORD_MASK = np.uint64((1 << WORD_BITS) - 1)
BEGIN, END = np.uint64(0), np.uint64(1)
CHUNK_TOKENS = 1_500_000
SCORE_TOKENS = 1_000_000
PAIRS_PER_BUCKET = 1 << 16
BUCKETS_PER_FILE = 64
WORD_SHARDS = 256
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SMALL = 255  # counts from here on are kept apart


def tokens_of(text: str) -> list[int]:
    """48-bit hashes of the lower-cased words; ids 0 and 1 are the marks of begin and end."""
    digest = xxhash.xxh64_intdigest
    return [digest(w) >> 16 for w in text.encode().lower().split()]


def mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """``before`` shifted by a hash of ``word``: reversible, and even for any distribution of ``before``."""
    h = word * MIX_A
    return (before + ((h ^ h >> np.uint64(29)) * MIX_B >> np.uint64(16))) & WORD_MASK


def unmixed(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = word * MIX_A
    return (key - ((h ^ h >> np.uint64(29)) * MIX_B >> np.uint64(16))) & WORD_MASK


def pair_hash(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    """32-bit hash of a pair within its bucket."""
    h = (key ^ word * MIX_B) * MIX_A
    return (h >> np.uint64(32)).astype(np.uint32)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of eight-byte numbers as compressed byte planes; the first is sorted and stored as differences."""
    first = np.diff(columns[0], prepend=columns[0].dtype.type(0))
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in (first, *columns[1:])]
    return zstd.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(blob: bytes, n_columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstd.ZstdDecompressor().decompress(blob), np.uint8).reshape(n_columns, 8, -1)
    columns = [np.ascontiguousarray(c.T).view("<u8").ravel() for c in raw]
    return [np.cumsum(columns[0], dtype=np.uint64), *columns[1:]]


def _summed(keys: tuple[np.ndarray, ...], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct keys in order (the first key leads) and the sums of the values."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(fresh)
    return [k[at] for k in keys], [np.add.reduceat(v[order], at) if len(at) else v for v in values]


def _blobs(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """One blob per run of equal bucket."""
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *edges], [*edges, len(bucket)]):
        if b > a:
            yield int(bucket[a]), _pack(*(c[a:b] for c in columns))


def _rows(kind: str, blobs: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    rows = list(blobs)
    if rows:
        keys, data = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(keys)), pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["kind", "bucket", "blob"]
        )


def count_pairs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Counted pairs of the texts, by bucket, in chunks."""

    def flush(before: list, words: list) -> Iterator[pa.RecordBatch]:
        if words:
            u, v = np.concatenate(before), np.concatenate(words)
            (key, v), (n,) = _summed((mixed(u, v), v), [np.ones(len(v), np.uint64)])
            yield from _rows("pairs", _blobs(key >> np.uint64(WORD_BITS - bits), key, v, n))

    before, words, held = [], [], 0
    for batch in pieces_of(batches, 256):
        for text in texts_of(batch):
            w = np.array([*tokens_of(text), END], np.uint64)
            words.append(w)
            before.append(np.r_[BEGIN, w[:-1]])
            held += len(w)
            if held >= CHUNK_TOKENS:
                yield from flush(before, words)
                before, words, held = [], [], 0
    yield from flush(before, words)


def _write(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Each array as a file of its own, complete or not there."""
    for part, array in arrays.items():
        target = Path(folder, f"{name}.{part}.npy")
        draft = target.with_name(f"{target.name}.{uuid.uuid4().hex}")
        with open(draft, "wb") as out:
            np.save(out, array)
        os.replace(draft, target)


def merge_pairs(batches: Iterator[pa.RecordBatch], folder: str, bits: int) -> Iterator[pa.RecordBatch]:
    """Write the pair files; give what follows from the pairs by word, and the counts of counts."""
    seen = np.zeros(5, np.int64)
    file_no, parts, sizes = None, [], np.zeros(BUCKETS_PER_FILE, np.int64)
    stats: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def close() -> None:
        if file_no is None:
            return
        keys, counts = (np.concatenate(x) for x in zip(*parts))
        offsets = np.r_[0, np.cumsum(sizes)]
        big = np.flatnonzero(counts >= SMALL)
        _write(folder, f"pairs-{file_no}", keys=keys, counts=np.minimum(counts, SMALL).astype(np.uint8), offsets=offsets,
               big=big, big_counts=counts[big])

    def by_word() -> Iterator[pa.RecordBatch]:
        if stats:
            words = np.concatenate([s[0] for s in stats])
            values = np.concatenate([s[1] for s in stats], axis=1)
            (words,), values = _summed((words,), list(values))
            yield from _rows("words", _blobs(words >> np.uint64(WORD_BITS - 8), words, *values))

    for bucket, (blobs,) in sorted_groups(batches):
        columns = [np.concatenate(c) for c in zip(*(_unpack(b, 3) for b in blobs))]
        (key, v), (n,) = _summed((columns[0], columns[1]), [columns[2]])
        if bucket // BUCKETS_PER_FILE != file_no:
            close()
            file_no, parts, sizes = bucket // BUCKETS_PER_FILE, [], np.zeros(BUCKETS_PER_FILE, np.int64)
        h = pair_hash(key, v)
        order = np.argsort(h)
        parts.append((h[order], n[order]))
        sizes[bucket % BUCKETS_PER_FILE] = len(h)
        seen += np.bincount(np.minimum(n, 5).astype(np.int64), minlength=6)[1:]
        none, one = np.zeros(len(n), np.uint64), np.ones(len(n), np.uint64)
        ones, twos, more = ((n == 1).astype(np.uint64), (n == 2).astype(np.uint64), (n > 2).astype(np.uint64))
        stats.append((v, np.stack([n, one, none, none, none, none])))  # count, continuations
        stats.append((unmixed(key, v), np.stack([none, none, n, ones, twos, more])))  # followers: total, with 1, 2, more
        held += 2 * len(n)
        if held >= CHUNK_TOKENS:
            yield from by_word()
            stats, held = [], 0
    close()
    yield from by_word()
    yield from _rows("seen", iter([(0, seen.tobytes())]))


def merge_words(batches: Iterator[pa.RecordBatch], folder: str, discounts: list[float]) -> Iterator[pa.RecordBatch]:
    """Write the word files; give the totals and counts of counts of the continuations."""
    for shard, (blobs,) in sorted_groups(batches):
        columns = [np.concatenate(c) for c in zip(*(_unpack(b, 7) for b in blobs))]
        (words,), (count, after, total, ones, twos, more) = _summed((columns[0],), columns[1:])
        gamma = (discounts[1] * ones + discounts[2] * twos + discounts[3] * more) / np.maximum(total, 1)
        _write(folder, f"words-{shard}", keys=words, count=count, after=after.astype(np.uint32), total=total,
               gamma=gamma.astype(np.float32))
        real = after > 0  # the begin mark follows nothing
        seen = np.bincount(np.minimum(after[real], 5).astype(np.int64), minlength=6)[1:]
        totals = np.r_[seen, int(after.sum()), int(count.sum()), int(real.sum()), int((after > 2).sum())].astype(np.int64)
        yield from _rows("seen", iter([(shard, totals.tobytes())]))


def discounts_of(seen: np.ndarray) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and more, from how many have count 1 to 4; where one of these is
    missing (tiny corpora), half of the count for it."""
    n1, n2, n3, n4 = (int(x) for x in seen[:4])
    if not (n1 and n2 and n3 and n4):
        return [0.0, 0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1))]


@dataclass(frozen=True)
class Model:
    folder: str
    bits: int
    pair_discounts: list[float]
    word_discounts: list[float]
    continuations: int
    gamma: float
    tokens: int
    words: int


class Lookup:
    """The mapped files of a model."""

    def __init__(self, model: Model):
        self.model = model
        self.files: dict[str, dict[str, np.ndarray] | None] = {}

    def _file(self, name: str, parts: tuple[str, ...]) -> dict[str, np.ndarray] | None:
        if name not in self.files:
            there = Path(self.model.folder, f"{name}.keys.npy").exists()
            self.files[name] = {p: np.load(Path(self.model.folder, f"{name}.{p}.npy"), mmap_mode="r") for p in parts} if there else None
        return self.files[name]

    def pairs(self, key: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Counts of pairs; the arrays need not be sorted."""
        bucket, h = (key >> np.uint64(WORD_BITS - self.model.bits)).astype(np.int64), pair_hash(key, word)
        out = np.zeros(len(key), np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order])) + 1
        for a, b in zip([0, *edges], [*edges, len(order)]):
            if b == a:
                continue
            at = order[a:b]
            number, slot = divmod(int(bucket[at[0]]), BUCKETS_PER_FILE)
            data = self._file(f"pairs-{number}", ("keys", "counts", "offsets", "big", "big_counts"))
            if data is None:
                continue
            low, high = int(data["offsets"][slot]), int(data["offsets"][slot + 1])
            keys = data["keys"][low:high]
            place = np.searchsorted(keys, h[at])
            place[place == high - low] = 0
            found = keys[place] == h[at] if high > low else np.zeros(len(at), bool)
            hit = place[found] + low
            count = data["counts"][hit].astype(np.int64)
            large = np.flatnonzero(count == SMALL)
            if len(large):
                count[large] = data["big_counts"][np.searchsorted(data["big"], hit[large])]
            out[at[found]] = count
        return out

    def words(self, word: np.ndarray) -> dict[str, np.ndarray]:
        """Per word: count, after, total, gamma; zero where unknown. ``word`` must be sorted."""
        parts = {"count": np.int64, "after": np.int64, "total": np.int64, "gamma": np.float64}
        out = {p: np.zeros(len(word), t) for p, t in parts.items()}
        shard = (word >> np.uint64(WORD_BITS - 8)).astype(np.int64)
        edges = np.searchsorted(shard, np.arange(WORD_SHARDS + 1))
        for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            data = self._file(f"words-{s}", ("keys", *parts)) if b > a else None
            if data is None:
                continue
            place = np.minimum(np.searchsorted(data["keys"], word[a:b]), len(data["keys"]) - 1)
            found = data["keys"][place] == word[a:b]
            for p in parts:
                out[p][a:b][found] = data[p][place[found]]
        return out

    def log_probabilities(self, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: log10 of the model's and of the base's probability, and whether the word is known."""
        m = self.model
        distinct, spot = np.unique(np.concatenate([before, word]), return_inverse=True)
        info = self.words(distinct)
        first, own = spot[: len(before)], spot[len(before) :]
        after = info["after"][own]
        lower = m.gamma / (m.words + 1) + np.where(
            after > 0, after - np.array(m.word_discounts)[np.minimum(after, 3)], 0.0) / max(1, m.continuations)
        count = self.pairs(mixed(before, word), word)
        total = info["total"][first]
        direct = np.where(count > 0, count - np.array(m.pair_discounts)[np.minimum(count, 3)], 0.0) / np.maximum(total, 1)
        seen = info["count"][own]
        p = np.where(total > 0, direct + info["gamma"][first] * lower, lower)
        return np.log10(p), np.log10((seen + 1) / (m.tokens + m.words + 1)), seen > 0


def shared_folder(df: DataFrame) -> str:
    """A new folder that the driver and all executors see, in the checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    place = urlparse(df.sparkSession.sparkContext.getCheckpointDir())
    if place.scheme not in ("", "file"):
        raise ValueError("hash arrays are memory-mapped: spark.checkpoint.dir must be a shared file path")
    folder = Path(place.path, f"hash-arrays-{uuid.uuid4().hex}")
    folder.mkdir(parents=True)
    return str(folder)


def train(texts: DataFrame, text_col: str = "text") -> Model:
    """Count ``texts`` and write the hash arrays. Null texts are empty: one end mark. No rows: a model that knows nothing."""
    folder = shared_folder(texts)
    size = texts.select((F.sum(F.length(text_col)) + F.count(F.lit(1))).alias("n")).first()["n"] or 0
    bits = max(8, int(np.ceil(np.log2(max(1, size / 6 / PAIRS_PER_BUCKET)))))
    kinds = "kind string, bucket bigint, blob binary"
    counted = texts.select(F.col(text_col).alias("text")).mapInArrow(lambda b: count_pairs(b, bits), kinds)
    by_file = counted.repartition(F.expr(f"bucket div {BUCKETS_PER_FILE}")).sortWithinPartitions("bucket").select("bucket", "blob")
    merged = cut(by_file.mapInArrow(lambda b: merge_pairs(b, folder, bits), kinds))
    seen = sum((np.frombuffer(r[0], np.int64) for r in merged.where("kind = 'seen'").select("blob").toLocalIterator()), np.zeros(5, np.int64))
    pair_discounts = discounts_of(seen)
    words = merged.where("kind = 'words'").select("bucket", "blob").repartition("bucket").sortWithinPartitions("bucket")
    totals = words.mapInArrow(lambda b: merge_words(b, folder, pair_discounts), kinds).select("blob").collect()
    n = sum((np.frombuffer(r[0], np.int64) for r in totals), np.zeros(9, np.int64))
    word_discounts = discounts_of(n)
    continuations = int(n[5])
    kept = word_discounts[1] * n[0] + word_discounts[2] * n[1] + word_discounts[3] * n[8]
    gamma = float(kept / continuations) if continuations else 1.0
    return Model(folder, bits, pair_discounts, word_discounts, continuations, gamma, int(n[6]), int(n[7]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, score, base_score, perplexity) for every row; null texts are empty (one end mark). Repeated
    rows score alike, ids may be null, other columns are not read, an empty table gives no rows. Words and pairs are known
    by hashes of 48 and 32 bits (a pair's within its bucket): two that clash are taken for one."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_tokens", "n_known", "score", "base_score", "perplexity"]

    def flush(lookup: Lookup, ids: list, tokens: list[np.ndarray]) -> pa.RecordBatch:
        word = np.concatenate(tokens)
        sizes = np.array([len(t) for t in tokens])
        begin = np.cumsum(sizes) - sizes
        before = np.r_[BEGIN, word[:-1]]
        before[begin] = BEGIN
        logs, base, known = lookup.log_probabilities(before, word)
        total = np.add.reduceat(logs, begin)
        columns = [sizes, np.add.reduceat(known.astype(np.int64), begin), total, np.add.reduceat(base, begin), 10 ** (-total / sizes)]
        return pa.RecordBatch.from_arrays([pa.chunked_array(ids).combine_chunks(), *map(pa.array, columns)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, ids, tokens, held = Lookup(model), [], [], 0
        for batch in pieces_of(batches, 128):
            own = [np.array([*tokens_of(t), END], np.uint64) for t in texts_of(batch)]
            ids.append(batch.column(0))
            tokens += own
            held += sum(map(len, own))
            if held >= SCORE_TOKENS:
                yield flush(lookup, ids, tokens)
                ids, tokens, held = [], [], 0
        if tokens:
            yield flush(lookup, ids, tokens)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, n_known bigint, score double, base_score double, perplexity double"
    )


def train_and_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """Learn from the rows that are not held out, score all."""
    model = train(docs.where(~held_out), text_col)
    return score(docs, model, id_col, text_col), model
