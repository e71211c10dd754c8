"""Empty tables, clashing columns and odd labels for the operators that filter or rewrite documents, and the classifiers."""

import itertools
import math
import random
import zlib
from collections import Counter

import helpers
import numpy as np
import pytest
from pyspark.sql import functions as F

from scorespark.llm import decontaminate, language_model, quality, secrets, simhash, toxicity

PHRASES = "item_id bigint, text string, doc_id bigint, spans string"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(7)
    words = ["the", "and", "river", "stone", "house", "green", "walk", "again"]
    text = lambda bad: " ".join(rng.choice(words) for _ in range(60)) + (" vilewretch grumbleskunk " * 3 if bad else "")
    docs = helpers.corpus(spark, [(k, text(k % 4 == 0)) for k in range(200)])
    rows = [(k, int(k % 4 == 0), int(k % 2)) for k in range(200)]
    odd = [(None, 1, 1), (3, None, None), (4, 1, 0), (4, 1, 0), (999_999, 1, 1)]
    return docs, spark.createDataFrame(rows + odd, "doc_id bigint, toxic int, quality int")


def rewriters(spark, labelled):
    model = toxicity.train(*labelled)
    phrases = spark.createDataFrame([(1, "alpha beta gamma delta", 5, "x"), (2, None, 5, "x"), (None, "", 5, "x")], PHRASES)
    return {
        "keep_first": simhash.keep_first, "keep_clean": lambda d: toxicity.keep_clean(d, model), "redact": secrets.redact,
        "remove_overlaps": lambda d: decontaminate.remove_overlaps(d, phrases), "remove_nothing": lambda d: decontaminate.remove_overlaps(d, phrases.where("false")),
    }


def test_rewriters_keep_columns_and_take_empty_tables(spark, labelled):
    for name, rewrite in rewriters(spark, labelled).items():
        assert rewrite(helpers.empty(spark)).collect() == [], name
        out = rewrite(helpers.awkward(spark))
        assert out.dtypes == helpers.awkward(spark).dtypes, name
        rows = out.collect()
        assert all(r["_key"] == "k" and r["spans"] == "s" and r["fp"] == 7 for r in rows), name
        if name not in ("keep_first", "keep_clean"):
            assert len(rows) == 10, name
        texts = {r["doc_id"]: r["text"] for r in rows}
        assert texts[3 if name != "keep_first" else 8] in ("", "x"), name
        if name == "remove_overlaps":
            assert texts[1].strip() == "" and texts[2] is None and texts[8] == "x"


def test_classifiers_take_odd_labels(spark, labelled):
    docs, labels = labelled
    for module, column in ((toxicity, "toxic"), (quality, "quality")):
        model = module.train(docs, labels)
        clean = labels.where(f"doc_id IS NOT NULL AND {column} IS NOT NULL AND doc_id < 1000").distinct()
        again = module.train(docs, clean)
        scores = [sorted((r["doc_id"], round(r["score"], 6)) for r in module.score(docs, m).collect()) for m in (model, again)]
        assert np.allclose([s for _, s in scores[0]], [s for _, s in scores[1]], atol=1e-6), column
        assert module.score(helpers.empty(spark), model).collect() == []
        nothing = module.train(helpers.empty(spark), labels)
        assert module.score(helpers.awkward(spark), nothing).where((F.col("score") < 0) | (F.col("score") > 1)).count() == 0
        assert module.score(docs, module.train(docs, labels.where("false"))).count() == 200


def test_marks_at_the_end_of_long_texts_teach(spark):
    rng = random.Random(5)
    plain = ["".join(rng.choice(["the", "an", "er", "ing", "on", "th"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    body = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    mark = " ".join(["vilewretch", "grumbleskunk", "rottenhead"] * 4)
    docs = helpers.corpus(spark, [(k, body(6000) + (f" {mark}" if k % 3 == 0 else "")) for k in range(60)])
    model = toxicity.train(docs, spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id bigint, toxic int"))
    assert b"grumbleskunk" in model.toxic
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    held_out = [k for k in range(60) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(scores[k] >= 0.5) == (k % 3 == 0) for k in held_out]) > 0.9


def kneser_ney(train, texts):
    """Interpolated modified Kneser-Ney over word pairs, written down from its formulas: log10 probability of each text."""
    def tokens(text):
        return ["<s>", *text.lower().split(), "</s>"]

    def discounts(values):
        n = [sum(v == k for v in values) for k in range(5)]
        if not all(n[1:5]):
            return [0.0, 0.5, 0.75, 0.75]
        y = n[1] / (n[1] + 2 * n[2])
        return [0.0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))]

    pairs = Counter(p for t in train for p in itertools.pairwise(tokens(t)))
    after, total, kinds = Counter(), Counter(), {}
    for (u, v), c in pairs.items():
        after[v] += 1
        total[u] += c
        kinds.setdefault(u, Counter())[min(c, 3)] += 1
    d, dw, n = discounts(pairs.values()), discounts(after.values()), sum(after.values())
    back = sum(dw[min(a, 3)] for a in after.values()) / n

    def p(u, v):
        lower = back / (len(after) + 1) + (max(after[v] - dw[min(after[v], 3)], 0) / n if after[v] else 0)
        if not total[u]:
            return lower
        kept = sum(d[k] * m for k, m in kinds[u].items()) / total[u]
        return (pairs[u, v] - d[min(pairs[u, v], 3)]) / total[u] + kept * lower

    return [sum(math.log10(p(u, v)) for u, v in itertools.pairwise(tokens(t))) for t in texts]


def test_language_model_equals_the_formulas(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    text = lambda: " ".join(rng.choice(words[: rng.choice([4, 15, 60])]) for _ in range(rng.randrange(40)))
    rows = [(k, text()) for k in range(150)] + [(900, "w1 never seen W1"), (901, None), (902, "w1 w2 w3")]
    found, model = language_model.train_and_score(helpers.corpus(spark, rows), F.col("doc_id") % 5 == 0)
    got = {r["doc_id"]: r["score"] for r in found.collect()}
    want = kneser_ney([t or "" for i, t in rows if i % 5], [t or "" for _, t in rows])
    assert [got[i] for i, _ in rows] == pytest.approx(want, rel=1e-5)
