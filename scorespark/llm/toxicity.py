"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on passages of ordinary texts, one on those stretches of passages of toxic texts
that tell them from ordinary ones, whatever their script, length or number. The texts are cut
into windows; a window is toxic to the degree that the toxic dictionary (with the ordinary one behind it, so that ordinary
words compress alike) makes it shorter than the ordinary one alone. Windows that look toxic are compressed again with more
and more of their surroundings, because a real hit stays and a chance match does not. A logistic rule over the window
gains of a document is calibrated on labelled texts.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, pieces_of, texts_of

WINDOW = 160
SURROUNDINGS = ((24, 0), (0, 24), (48, 16), (16, 48), (72, 0), (0, 72), (40, 40))
ORDINARY_BYTES = 110 << 10
TOXIC_BYTES = 4 << 10
MOST_BYTES = 24 << 20
PASSAGE = 200
LONGEST_PASSAGE = 800
RUNS = (4, 6, 8)
FEATURES = 5


def windows(text: bytes, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Consecutive windows of at least ``size`` bytes that end at a space; the last may be shorter."""
    start = 0
    while start < len(text):
        end = text.find(b" ", start + size) if start + size < len(text) else -1
        end = len(text) if end < 0 else end
        yield start, end
        start = end + 1


def normal(text: str) -> bytes:
    return b" ".join(text.encode().lower().split())


class Distance:
    """Compressed length of a passage with the ordinary dictionary minus that with the toxic one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        settings = zstd.ZstdCompressionParameters(
            window_log=18, chain_log=16, hash_log=16, search_log=5, min_match=4, target_length=64,
            strategy=zstd.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False,
            format=zstd.FORMAT_ZSTD1_MAGICLESS,
        )

        def length(content: bytes):
            if len(content) < 8:
                return len
            kind = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            compress = zstd.ZstdCompressor(dict_data=kind, compression_params=settings).compress
            return lambda passage: len(compress(passage))

        self.ordinary, self.toxic = length(ordinary), length(toxic + ordinary)

    def gain(self, passage: bytes) -> int:
        return self.ordinary(passage) - self.toxic(passage)

    def features(self, text: str) -> list[float]:
        """Largest gain, gains by root of length, number of strong windows, largest sure gain, log length."""
        body = normal(text)
        mean, sure = [0.0], [0.0]
        for start, end in windows(body):
            first = self.gain(body[start:end])
            if first >= 1:
                gains = sorted([first, *(self.gain(body[max(0, start - a) : end + b]) for a, b in SURROUNDINGS)])
                mean.append(sum(gains) / len(gains))
                sure.append(gains[2])
        return [
            max(mean), sum(max(0.0, m) for m in mean) / math.sqrt(len(body) / WINDOW + 1),
            float(sum(m > 2 for m in mean)), float(max(sure)), math.log(len(body) + 50),
        ]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = np.c_[(features - self.centre) / self.scale, np.ones(len(features))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -40, 40)))


def _runs(text: bytes, n: int) -> np.ndarray:
    """The runs of ``n`` bytes (at most eight) at each place, as numbers."""
    own = np.frombuffer(text, np.uint8).astype(np.uint64)
    places = max(0, len(own) - n + 1)
    out = np.zeros(places, np.uint64)
    for i in range(n):
        out = out << np.uint64(8) | own[i : places + i]
    return out


def _among(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in the sorted ``known``, and whether it stands there."""
    at = np.searchsorted(known, values).clip(max=max(0, len(known) - 1))
    return at, known[at] == values if len(known) else np.zeros(len(values), bool)


def telling_stretches(toxic: list[list[bytes]], ordinary: list[list[bytes]], least_evidence: float) -> list[bytes]:
    """The stretches of the toxic passages (one list per text) made up of byte runs that more toxic than ordinary texts hold,
    by the log-likelihood bound of their text counts. Runs know no words, so marks may be short, hold digits or signs, be
    phrases, or stand in scripts without spaces. Exact copies count once."""
    pad = lambda texts: [[b" " + p + b" " for p in t] for t in sorted({tuple(t) for t in texts if t})]
    toxic, ordinary = pad(toxic), pad(ordinary)
    if not toxic or not ordinary:
        return []
    share = len(toxic) / (len(toxic) + len(ordinary))
    covered = [[np.zeros(len(p) + 1, np.int64) for p in t] for t in toxic]
    for n in RUNS:
        runs, a = np.unique(np.concatenate([np.unique(np.concatenate([_runs(p, n) for p in t])) for t in toxic]), return_counts=True)
        enough = a * -math.log10(share) >= least_evidence  # ordinary texts only lower the evidence
        runs, a = runs[enough], a[enough]
        b = np.zeros(len(runs), np.int64)
        for t in ordinary:
            at, hit = _among(np.concatenate([_runs(p, n) for p in t]), runs)
            b[np.unique(at[hit])] += 1
        p = a / np.maximum(1, a + b)
        rest = np.where(p < 1, (1 - p) * np.log10(np.where(p < 1, 1 - p, 1) / (1 - share)), 0.0)
        telling = runs[(p > share) & ((a + b) * (p * np.log10(p / share) + rest) >= least_evidence)]
        for t, marks in zip(toxic, covered):
            for passage, mark in zip(t, marks):
                at = np.flatnonzero(_among(_runs(passage, n), telling)[1])
                np.add.at(mark, at, 1)
                np.add.at(mark, at + n, -1)
    out = []
    for t, marks in zip(toxic, covered):
        for passage, mark in zip(t, marks):
            edges = np.flatnonzero(np.diff(np.r_[False, np.cumsum(mark[:-1]) > 0, False]))
            out += [passage[i:j] for i, j in zip(edges[::2], edges[1::2])]
    return out


def _trained(size: int, passages: list[bytes], **settings: int) -> bytes:
    """Content of a trained dictionary; what is too little to train on is taken as it is."""
    try:
        return zstd.train_dictionary(size, passages, **settings).as_bytes()
    except zstd.ZstdError:
        return b" ".join(dict.fromkeys(passages))[-size:]


def train(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_ordinary: int = 4_000, least_evidence: float = 4.0,
) -> Model:
    """Fit on at most about ``max_labelled`` labelled texts outside the held-out fold.

    The ordinary dictionary is trained on all passages of at most about ``max_ordinary`` of the ordinary ones, the toxic one
    on all passages of as many toxic ones: on their telling stretches, or on the passages as they are where none has enough
    evidence. Where these texts are long, fewer of them are taken, so that about ``MOST_BYTES`` of each kind reach the
    driver; a text that is taken is read whole. Null texts and labels count as empty and are left out; repeated label rows
    are averaged. Without labels of both kinds the model gives every text the share of toxic labels (0.0 if there are none).
    """
    sample = labelled_sample(docs, labels, "toxic", max_labelled).repartition(32, "doc_id").cache()
    sums = sample.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    counts = {r["label"]: r["n"] for r in sums}
    constant = np.zeros(FEATURES + 1)
    if len(counts) < 2:
        constant[-1] = 40.0 if counts.get(1) else -40.0
        sample.unpersist()
        return Model(b"", b"", np.zeros(FEATURES), np.ones(FEATURES), constant)
    shuffled = random.Random(1)
    share = {r["label"]: int(min(1.0, max_ordinary / r["n"], MOST_BYTES / max(1, r["bytes"])) * (1 << 20)) for r in sums}
    pick = F.pmod(F.xxhash64(F.lit("ordinary"), "doc_id"), F.lit(1 << 20)) < F.when(F.col("label") == 1, share[1]).otherwise(share[0])

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, kinds = [], batch.column(batch.schema.get_field_index("label"))
            for text in texts_of(batch):
                body, most = normal(text), LONGEST_PASSAGE
                out.append([body[i : min(b, i + most)] for a, b in windows(body, PASSAGE) for i in range(a, b, most)])
            yield pa.RecordBatch.from_arrays([kinds, pa.array(out, pa.list_(pa.binary()))], names=["label", "passages"])

    found: dict[int, list[list[bytes]]] = {0: [], 1: []}
    for r in sample.where(pick).select("label", "text").mapInArrow(passages, "label int, passages array<binary>").collect():
        found[r[0]].append([bytes(p) for p in r[1]])
    ordinary = sorted(p for t in found[0] for p in t)
    toxic = [2 * s for s in telling_stretches(found[1], found[0], least_evidence)] or sorted(p for t in found[1] for p in t)
    shuffled.shuffle(toxic)
    shuffled.shuffle(ordinary)
    both = (_trained(ORDINARY_BYTES, ordinary)[-ORDINARY_BYTES + 300 :], _trained(TOXIC_BYTES, toxic, k=24, d=6) if toxic else b"")
    rows = _features(sample.select("doc_id", "text", "label"), *both).select("label", "features").collect()
    sample.unpersist()
    y, x = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    centre, scale = x.mean(0), x.std(0) + 1e-9
    a, w = np.c_[(x - centre) / scale, np.ones(len(x))], np.zeros(FEATURES + 1)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(len(w)), a.T @ (p - y) + 1e-2 * w)
    return Model(*both, centre, scale, w)


def _features(texts: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    content = texts.sparkSession.sparkContext.broadcast((ordinary, toxic))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distance = Distance(*content.value)
        for batch in pieces_of(batches, 256):
            rows = [distance.features(t) for t in texts_of(batch)]
            label = batch.column(batch.schema.get_field_index("label"))
            yield pa.RecordBatch.from_arrays([label, pa.array(rows, pa.list_(pa.float64()))], ["label", "features"])

    return texts.mapInArrow(run, "label int, features array<double>")


def _scored_batches(batches: Iterator[pa.RecordBatch], model: Model, text_col: str):
    distance = Distance(model.ordinary, model.toxic)
    for batch in pieces_of(batches, 256):
        features = np.array([distance.features(t) for t in texts_of(batch, text_col)]).reshape(-1, FEATURES)
        yield batch, model.scores(features)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score 0 to 1) for every row; null and empty texts are scored like a text without windows. Rows may repeat and
    ids be null; other columns are not read. An empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scored_batches(batches, shared.value, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose score is below the threshold, unchanged: null and empty texts score like a text without
    windows, repeated rows alike, columns of any name pass through, an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, scores in _scored_batches(batches, shared.value, text_col):
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
