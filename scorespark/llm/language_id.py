"""Language identification by error-correcting output codes.

Every language has a codeword; each code bit has a binary classifier over hashed letter trigrams, which tells the
languages with a one from those with a zero. A text's bits are decoded to the codeword of least weighted loss; a small lead
over the next one flags the text as ambiguous.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, pieces_of, texts_of

SLOTS = 1 << 15
NOT_LETTERS = re.compile(r"[\W\d_]+")
LEAST_LEAD = 0.2
CHUNK = 1 << 16


def trigrams(text: str) -> np.ndarray:
    """Slots of the byte trigrams of the lower-cased words, each word between spaces; none if the text has no letter."""
    body = NOT_LETTERS.sub(" ", text.lower())
    if not any(c.isalpha() for c in body):
        return np.zeros(0, np.int64)
    b = np.frombuffer(f" {body.strip()} ".encode(), np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ h >> 15) & np.uint32(SLOTS - 1)).astype(np.int64)


def codebook(classes: int) -> np.ndarray:
    """Codewords (classes, bits) of +1 and -1: all splits of up to five classes, else the most distant random ones."""
    if classes <= 1:
        return np.ones((classes, 1))
    if classes <= 5:
        splits = [s for s in product((1, -1), repeat=classes) if s[0] == 1 and -1 in s]
        return np.array(splits, float).T
    rng, best, distance = np.random.default_rng(7), None, -1
    bits = int(np.ceil(10 * np.log2(classes)))
    for _ in range(300):
        words = rng.choice([-1.0, 1.0], (classes, bits))
        apart = (bits - words @ words.T) / 2 + np.eye(classes) * bits
        if apart.min() > distance and (np.abs(words.sum(0)) < classes).all():
            best, distance = words, apart.min()
    return best


@dataclass(frozen=True)
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # (slots, bits): log odds of a one
    bit_weight: np.ndarray
    scale: float

    def decode(self, text: str) -> tuple[str, float, bool]:
        slots = trigrams(text)
        if not len(slots) or not self.languages:
            return "und", 0.0, True
        margin = sum(self.weights[slots[i : i + CHUNK]].sum(axis=0) for i in range(0, len(slots), CHUNK)) / len(slots)
        loss = np.log1p(np.exp(-np.clip(self.scale * self.code * margin, -50, 50))) @ self.bit_weight
        odds = np.exp(loss.min() - loss)
        share = odds / odds.sum()
        best = int(share.argmax())
        lead = share[best] - np.partition(share, -2)[-2] if len(share) > 1 else 1.0
        return self.languages[best], float(share[best]), bool(lead < LEAST_LEAD)


def train(docs: DataFrame, max_per_language: int = 3_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most about ``max_per_language`` texts of each language, outside the held-out fold (remainder 0).

    Rows without a language, and texts without a letter, teach nothing. With one language all texts get it; with none
    every text is ``und``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_remainder("doc_id", 5) != 0))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.ones((0, 1)), np.zeros((SLOTS, 1)), np.ones(1), 1.0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, max_per_language / n) * (1 << 30)))])
    sample = rows.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30)) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in pieces_of(batches, 256):
            langs = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for lang, text in zip(langs, texts_of(batch)):
                found.setdefault(lang, np.zeros(SLOTS, np.int64))
                found[lang] += np.bincount(trigrams(text), minlength=SLOTS)
        if found:
            blobs = [zlib.compress(x.tobytes(), 1) for x in found.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(blobs, pa.binary())], ["lang", "blob"])

    total = {lang: np.zeros(SLOTS, np.int64) for lang in sorted(counts)}
    partial = sample.repartition(32, "doc_id").select("text", "lang").mapInArrow(count, "lang string, blob binary")
    for lang, blob in partial.toLocalIterator():
        total[lang] += np.frombuffer(zlib.decompress(blob), np.int64)
    total = {lang: n for lang, n in total.items() if n.sum()}
    if not total:
        return Model([], np.ones((0, 1)), np.zeros((SLOTS, 1)), np.ones(1), 1.0)
    languages = list(total)
    p = np.array([(total[lang] + 0.5) / (total[lang].sum() + 0.5 * SLOTS) for lang in languages])
    code = codebook(len(languages))
    ones, zeros = (code > 0).astype(float), (code < 0).astype(float)
    mean = lambda side: (side / np.maximum(side.sum(0), 1)).T @ p
    weights = (np.log(mean(ones) + 1e-12) - np.log(mean(zeros) + 1e-12)).T if len(languages) > 1 else np.ones((SLOTS, 1))
    expected = code * (p @ weights)  # margin of each class on its own text
    apart = np.clip(expected.min(axis=0), 0.01, None)
    return Model(languages, code, weights.astype(np.float32), apart / apart.sum() * len(apart), 4.0 / float(np.median(apart)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score 0 to 1, ambiguous) for every row; ``und`` with score 0 where no text or no letter is. Repeated
    texts are told alike, ids may be null or repeat, other columns are not read, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 512):
            found = [shared.value.decode(t) for t in texts_of(batch)]
            lang, score, ambiguous = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
