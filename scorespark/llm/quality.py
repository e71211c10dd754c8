"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel. Each task sums its part of the normal equations; the driver adds these
fixed-size sums and solves them. A fold of its own calibrates the raw scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, labelled_sample, pieces_of, texts_of

FOURIER = 384
RIDGE = 1e-3
PARTS = 32

_BYTE_CLASS = np.array(
    [0 if c in b" \t\r\x0b\x0c" else 1 if c == 10 else 2 if 48 <= c <= 57 else 3 if 65 <= c <= 90 else 4 if 97 <= c <= 122
     else 5 if c in b".,;:'\"()-?" else 6 if c == 33 else 7 if c == 124 else 8 if c < 128 else 9 for c in range(256)], np.int64)


def statistics(text: str) -> list[float]:
    """Statistics of a text: character classes, word lengths, repetition, lines. Empty texts have all zero but size."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(data))
    kinds = np.bincount(_BYTE_CLASS[data], minlength=10) / n
    words = text.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    again = sum(a == b for a, b in zip(words, words[1:]))
    odd_end = sum(not w[-1].isalnum() and w[-1] not in ".,;:?!'\")-" for w in words)
    shout = sum(w.isupper() and len(w) > 1 for w in words)
    lines = [x for x in text.split("\n") if x]
    per_line = np.fromiter(map(len, lines), float, len(lines)) if lines else np.zeros(1)
    return [
        math.log(len(data) + 1), *kinds.tolist(), lengths.mean(), lengths.std(), (lengths <= 2).mean(), (lengths >= 15).mean(),
        len(counts) / m, top / m, again / m, math.sqrt(again / m), odd_end / m, math.sqrt(odd_end / m), shout / m,
        math.sqrt(shout / m), math.sqrt(kinds[7]), len(lines) / m, len(set(lines)) / max(1, len(lines)),
        math.log(per_line.mean() + 1), math.log(per_line.max() + 1),
    ]


WIDTH = len(statistics(""))


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    raw: np.ndarray  # calibration knots
    level: np.ndarray

    def fourier(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        wave = np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.c_[wave, z / math.sqrt(WIDTH), np.ones(len(z))]

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw_scores(x), self.raw, self.level), 0.0, 1.0)


def pooled(points: list[list[float]]) -> list[list[float]]:
    """Pool adjacent violators over (sum of raw scores, sum of labels, count), in order of raw scores."""
    pools: list[list[float]] = []
    for point in points:
        pools.append(list(point))
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return pools


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the best non-decreasing fit, one at the mean of each pool, levels kept off 0 and 1 by half a label.

    That can turn the order of a small pool and a large one round, so the smoothed levels are pooled once more.
    """
    first = pooled([[r, y, 1.0] for r, y in sorted(zip(raw.tolist(), label.tolist()))])
    pools = pooled([[r, n * (y + 0.5) / (n + 1), n] for r, y, n in first])
    return np.array([r / n for r, _, n in pools]), np.array([y / n for _, y, n in pools])


def _stats(texts: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 512):
            rows = [statistics(t) for t in texts_of(batch)]
            rest = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "label")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "label", "text").repartition(parts, "doc_id").mapInArrow(run, f"doc_id {kind}, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 30_000, seed: int = 11) -> Model:
    """Fit on at most about ``max_labelled`` labelled texts outside the held-out fold (remainder 0); those with remainder 1
    calibrate. Without labels the score is 0.5; with labels of one kind only it is their share, smoothed."""
    rng = np.random.default_rng(seed)
    rows = _stats(labelled_sample(docs, labels, "quality", max_labelled), PARTS).cache()
    moments = rows.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col"), F.stddev_pop("col")).orderBy("pos").collect()
    blank = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, FOURIER)), np.zeros(FOURIER),
                  np.zeros(FOURIER + WIDTH + 1), np.zeros(1), np.full(1, 0.5))
    if not moments:
        rows.unpersist()
        return blank
    centre = np.array([r[1] for r in moments])
    scale = np.maximum(np.array([r[2] for r in moments]), 1e-6)
    model = Model(centre, scale, rng.normal(0, 1 / math.sqrt(WIDTH), (WIDTH, FOURIER)), rng.uniform(0, 2 * math.pi, FOURIER),
                  blank.weights, blank.raw, blank.level)
    size = FOURIER + WIDTH + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, WIDTH)
            z, y = model.fourier(x), batch.column(0).to_numpy()
            total += z.T @ np.c_[z, y]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    fold = id_remainder("doc_id", 5)
    fit = rows.where(fold != 1).select("label", "x").mapInArrow(sums, "sums binary")
    total = sum((np.frombuffer(r[0]).reshape(size, size + 1) for r in fit.toLocalIterator()), np.zeros((size, size + 1)))
    n = max(1.0, total[size - 1, size - 1])
    weights = np.linalg.solve(total[:, :size] + RIDGE * n / size * np.eye(size), total[:, size])
    model = Model(centre, scale, model.directions, model.phases, weights, blank.raw, blank.level)
    held = rows.where(fold == 1).select("label", "x").collect() or rows.select("label", "x").collect()
    rows.unpersist()
    raw = model.raw_scores(np.array([r[1] for r in held]))
    knots, level = isotonic(raw, np.array([r[0] for r in held], float))
    return Model(centre, scale, model.directions, model.phases, weights, knots, level)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score 0 to 1) for every row; a null text counts as empty. Repeated texts have equal scores, ids may be null or
    repeat, other columns are not read, an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 512):
            x = np.array([statistics(t) for t in texts_of(batch)], float).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(x))], ["doc_id", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
