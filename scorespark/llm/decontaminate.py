"""Benchmark decontamination with an FM-index per shard of training text.

Test phrases are cut into windows of consecutive words. Each task takes its documents in shards, builds an FM-index of the
shard (suffix order, Burrows-Wheeler symbols in a wavelet tree, sampled suffix positions), searches all windows backwards
at once, locates their occurrences and merges them into hit spans. A word that no phrase has cannot be inside an
occurrence, so such words only separate runs, and runs shorter than the shortest window are not indexed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_of, texts_of, with_columns

WINDOW = 10
SAMPLE_RATE = 16
SHARD_WORDS = 2_000_000
BLOCK_CHARS = 8 << 20

#: Word bytes: digits, letters, everything beyond ASCII; A-Z become a-z, other bytes separate.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


class WaveletTree:
    """Symbols by bit, from the highest: each level keeps zeros before ones; ranks come from running counts of zeros."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.levels = []
        for bit in range(self.bits - 1, -1, -1):
            one = symbols >> bit & 1 == 1
            zeros = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            symbols = np.concatenate([symbols[~one], symbols[one]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before the position beside it."""
        start = np.zeros_like(ends)
        for bit, zeros, total in self.levels:
            one = symbols >> bit & 1 == 1
            start = np.where(one, total + start - zeros[start], zeros[start])
            ends = np.where(one, total + ends - zeros[ends], zeros[ends])
        return ends - start

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at these positions."""
        out = np.zeros_like(at)
        for bit, zeros, total in self.levels:
            one = zeros[at + 1] == zeros[at]
            out |= one.astype(out.dtype) << bit
            at = np.where(one, total + at - zeros[at], zeros[at])
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; zeros are separators, each smaller than all words and different from the others."""
    n = len(symbols)
    gap = symbols == 0
    rank = np.where(gap, np.cumsum(gap) - 1, symbols.astype(np.int64) + gap.sum())
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        ranked = rank[order]
        fresh = np.r_[0, np.cumsum(ranked[1:] != ranked[:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[: n - width] = rank[width:] + 1
        rank = rank * (n + 1) + follow
        order = np.argsort(rank, kind="stable")
        width *= 2


class FMIndex:
    """Full-text index over word ids (0 separates). Built for one shard."""

    def __init__(self, symbols: np.ndarray, rate: int = SAMPLE_RATE):
        symbols = np.r_[symbols, 0].astype(np.int64)
        order = suffix_order(symbols)
        before = symbols[order - 1]
        self.tree = WaveletTree(before)
        self.less = np.r_[0, np.cumsum(np.bincount(symbols))]
        kept = (order % rate == 0) | (before == 0)  # a walk ends before it would cross a separator
        self.sampled_before = np.r_[0, np.cumsum(kept)]
        self.samples = order[kept]
        self.n = len(symbols)

    def _step(self, symbols: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return self.less[symbols] + self.tree.rank(symbols, rows)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of each pattern (equal lengths, one per line), found from its last word to its first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        alive = np.flatnonzero((patterns < len(self.less) - 1).all(axis=1))
        low[:], high[:] = 0, np.where(np.isin(np.arange(len(patterns)), alive), self.n, 0)
        for k in range(patterns.shape[1] - 1, -1, -1):
            word = patterns[alive, k]
            low[alive], high[alive] = self._step(word, low[alive]), self._step(word, high[alive])
            alive = alive[low[alive] < high[alive]]
        found = np.zeros(len(patterns), bool)
        found[alive] = True
        return low, np.where(found, high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: step back until a sampled one."""
        place, walked = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        rows, open_ = rows.copy(), np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            here = self.sampled_before[at + 1] > self.sampled_before[at]
            done = open_[here]
            place[done] = self.samples[self.sampled_before[at[here]]] + walked[done]
            open_, at = open_[~here], at[~here]
            rows[open_] = self._step(self.tree.access(at), at)
            walked[open_] += 1
        return place


class PhraseBlock:
    """Windows of some test items over a vocabulary of their own: a bounded part of the query set."""

    def __init__(self, items: list[tuple[str, str]], width: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + width]), set()).add(item)
        by_length: dict[int, list] = {}
        for window, owners in windows.items():
            by_length.setdefault(len(window), []).append((window, sorted(owners)))
        self.groups = [
            (np.array([w for w, _ in group], np.int64), [owners for _, owners in group]) for group in by_length.values()
        ]
        self.shortest = min(by_length, default=0)

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[list[str]], np.ndarray]]:
        """Per window length: positions in ``ids``, the length, the windows' items, the window at each position."""
        inside = ids > 0
        edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
        starts, ends = edge[::2], edge[1::2]
        keep = ends - starts >= self.shortest
        starts, sizes = starts[keep], (ends - starts)[keep]
        if not len(starts):
            return
        offset = np.cumsum(sizes + 1) - (sizes + 1)  # a separator after each run
        origin = np.repeat(starts - offset, sizes + 1) + np.arange((sizes + 1).sum())
        symbols = ids[np.minimum(origin, len(ids) - 1)].copy()
        symbols[offset + sizes] = 0
        index = FMIndex(symbols)
        for patterns, owners in self.groups:
            low, high = index.search(patterns)
            found = np.repeat(np.arange(len(patterns)), high - low)
            if len(found):
                rows = np.concatenate([np.arange(a, b) for a, b in zip(low, high) if b > a])
                yield origin[index.locate(rows)], patterns.shape[1], owners, found


def phrase_blocks(phrases: DataFrame, id_col: str, text_col: str) -> list:
    """The stated query set as broadcast blocks of bounded size."""
    context = phrases.sparkSession.sparkContext
    blocks, items, chars = [], [], 0
    rows = phrases.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    for row in rows.where("text is not null").toLocalIterator():
        items.append((row["item"], row["text"]))
        chars += len(row["text"])
        if chars >= BLOCK_CHARS:
            blocks.append(context.broadcast(PhraseBlock(items)))
            items, chars = [], 0
    return [*blocks, context.broadcast(PhraseBlock(items))]


def _hits(texts: list[str], blocks: Iterable[PhraseBlock]) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """For a shard: word counts by document, whether each word (all documents in a row) is hit, items by document."""
    words = [words_of(t) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    begin = np.cumsum(n_words + 1) - (n_words + 1)
    total = int((n_words + 1).sum())
    cover, items = np.zeros(total + 1, np.int64), [set() for _ in texts]
    for block in blocks:
        if not block.groups:
            continue
        code = block.vocabulary.get
        ids = np.fromiter((i for doc in words for i in (*(code(w, 0) for w in doc), 0)), np.int32, total)
        for places, size, owners, found in block.occurrences(ids):
            np.add.at(cover, places, 1)
            np.add.at(cover, places + size, -1)
            doc = np.searchsorted(begin, places, side="right") - 1
            for d, w in np.unique(np.stack([doc, found], axis=1), axis=0):
                items[d].update(owners[w])
    return n_words, np.cumsum(cover)[:total] > 0, items


def _spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Merged character spans of neighbouring hit words."""
    spans: list[tuple[int, int]] = []
    last = -2
    for k, word in enumerate(WORD.finditer(text)):
        if hit[k]:
            spans.append((spans.pop()[0] if last == k - 1 else word.start(), word.end()))
            last = k
    return spans


def _shards(batches: Iterator[pa.RecordBatch], column: str, size: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows regrouped so that a shard has about ``size`` words (estimated from bytes), to share one index."""
    held, chars = [], 0
    for batch in pieces_of(batches, 256):
        held.append(batch)
        chars += batch.column(batch.schema.get_field_index(column)).nbytes
        if chars >= 6 * size:
            yield from _joined(held, column)
            held, chars = [], 0
    yield from _joined(held, column)


def _joined(held: list[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    if held:
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()
        for one in batch:
            yield one, texts_of(one, column)


def find_overlaps(
    docs: DataFrame, phrases: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    phrase_id: str = "item_id", phrase_text: str = "text", shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted distinct ids as strings) and spans [start, end) in
    characters to remove.

    A window is ten consecutive words of an item, or all its words if fewer; a word inside an occurrence is hit. Null
    texts have no words; items without words match nothing; rows that repeat an item id are one item; a null item id
    counts as the empty id. Empty tables give no rows, or rows without hits.
    """
    blocks = phrase_blocks(phrases, phrase_id, phrase_text)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _shards(batches, "text", shard_words):
            n_words, hit, items = _hits(texts, (b.value for b in blocks))
            n_hit, spans, at = [], [], 0
            for text, n in zip(texts, n_words):
                own = hit[at : at + n]
                at += n + 1
                n_hit.append(int(own.sum()))
                spans.append([{"start": a, "end": b} for a, b in _spans(text, own)] if n_hit[-1] else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(n_hit, pa.int64()),
                 pa.array([sorted(i) for i in items], pa.list_(pa.string())), pa.array(spans, spans_type)],
                ["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return source.mapInArrow(
        run,
        f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_hit bigint, items array<string>, "
        "spans array<struct<start:bigint,end:bigint>>",
    )


def remove_overlaps(
    docs: DataFrame, phrases: DataFrame, text_col: str = "text", phrase_id: str = "item_id", phrase_text: str = "text",
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` with the spans of :func:`find_overlaps` cut out of the text; other columns, and rows without hits, are
    unchanged. A text that consists of hits only becomes empty of words but its row stays. Null and empty texts stay as they
    are, repeated rows are cut alike, and an empty table, or one without phrases, comes back as it was."""
    blocks = phrase_blocks(phrases, phrase_id, phrase_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _shards(batches, text_col, shard_words):
            n_words, hit, _ = _hits(texts, (b.value for b in blocks))
            column = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            at = 0
            for row, n in enumerate(n_words):
                own = hit[at : at + n]
                at += n + 1
                if own.any():
                    kept, end = [], 0
                    for a, b in _spans(texts[row], own):
                        kept.append(texts[row][end:a])
                        end = b
                    column[row] = "".join([*kept, texts[row][end:]])
            yield with_columns(batch, **{text_col: pa.array(column, pa.string())})

    return docs.mapInArrow(run, docs.schema)
