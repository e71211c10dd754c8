"""Mixing, splitting, encoding and accounting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as T
from ..functions import vocabulary as V
from ..operators import chords as C
from ..operators import sampling as S
from ..sources import datasets as D
from . import bindings as B
from .corpus_queries import VOCABULARY_SQL
from .registry import query

FIELDS = V.SCORED_FIELDS


def docs(spark, sf, *columns):
    return B.table(spark, sf, "documents").select("doc_id", *columns)


@query("so01_union_of_sources", """SELECT key, origin FROM (SELECT doc_id AS key, source AS origin FROM documents UNION ALL SELECT page_id, 'pages' FROM pages) u
    ORDER BY md5(CAST(key AS VARCHAR)), key""")
def union_of_sources(spark, sf):
    pages = B.table(spark, sf, "pages").select(F.col("page_id").alias("key"), F.lit("pages").alias("origin"))
    return S.union_sources([docs(spark, sf, "source").select(F.col("doc_id").alias("key"), F.col("source").alias("origin")), pages])


# Weights of the configured sources; one of them holds most of the rows.
WEIGHTS = {"en": 3.0, "fr": 1.0, "de": 1.0, "es": 2.0}
_ORDER = ", ".join(f"('{name}', {i}, {weight})" for i, (name, weight) in enumerate(WEIGHTS.items()))


@query("so02_weighted_mix", f"""WITH w AS (SELECT * FROM (VALUES {_ORDER}) v(lang, i, wt)), t AS (SELECT count(*) // 8 AS goal FROM documents),
    q AS (SELECT lang, i, CAST(trunc(goal * wt / CAST((SELECT sum(wt) FROM w) AS DOUBLE)) AS BIGINT) AS quota, goal FROM w, t),
    f AS (SELECT lang, CASE WHEN i = 3 THEN goal - (SELECT sum(quota) FROM q WHERE i < 3) ELSE quota END AS quota FROM q),
    r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rk FROM documents)
    SELECT doc_id, r.lang FROM r JOIN f ON f.lang = r.lang WHERE rk <= quota""")
def weighted_mix(spark, sf):
    """An eighth of all documents, by weight; every source lasts, so one round decides."""
    return S.mix_sources(docs(spark, sf, "lang"), "lang", "doc_id", WEIGHTS, lambda total: F.floor(total / 8))


def _split_sql(limit: str) -> str:
    return f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS rk, count(*) OVER () AS n FROM documents)
    SELECT doc_id, CASE WHEN rk <= {limit} THEN 'validation' ELSE 'train' END AS split FROM r"""


@query("so03_head_split", _split_sql("floor(n * 0.1e0)"))
def head_split(spark, sf):
    return S.split_rows(docs(spark, sf), "doc_id", 0.1)


@query("so04_rounded_split", _split_sql("round_even(n * 0.13e0, 0)"))
def rounded_split(spark, sf):
    return S.split_rows(docs(spark, sf), "doc_id", 0.13, rounded=True)


@query("so08_hash_choice", """SELECT doc_id, CAST(list_sum([strpos('0123456789abcdef', c) - 1 FOR c IN string_split(sha256(CAST(doc_id AS VARCHAR)), '')]) % 5 AS INTEGER) AS font FROM documents""")
def hash_choice(spark, sf):
    return docs(spark, sf).select("doc_id", X.hash_choice(F.col("doc_id").cast("string"), 5).cast("int").alias("font"))


@query("sl07_round_robin_sample", """WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS turn_no FROM documents)
    SELECT doc_id, lang, source, turn_no FROM r ORDER BY turn_no, lang, source LIMIT 150""")
def round_robin_sample(spark, sf):
    return S.round_robin_sample(docs(spark, sf, "lang", "source"), ["lang", "source"], "doc_id", 150)


_BR = ", ".join(
    f"array_to_string(list_concat([{1 if f == 'rhythm' else 0}], list(i_{f} ORDER BY pos), [{2 if f == 'rhythm' else 0}], list_resize(CAST([] AS BIGINT[]), 606 - count(*), 0)), ',') AS {f}"
    for f in V.TOKEN_FIELDS
)
_JOINS = " ".join(f"LEFT JOIN voc v_{f} ON v_{f}.branch = '{f}' AND v_{f}.token = evt.{f}" for f in V.TOKEN_FIELDS)


@query("jn02_dictionary_encode", f"""WITH {B.EVT}, {VOCABULARY_SQL}, e AS (SELECT seq_id, pos, {", ".join(f"v_{f}.id AS i_{f}" for f in V.TOKEN_FIELDS)} FROM evt {_JOINS})
    SELECT seq_id, {_BR}, CAST(count(*) + 2 AS INTEGER) AS mask_length FROM e GROUP BY seq_id""")
def dictionary_encode(spark, sf):
    e = S.encode_sequences(B.evt(spark, sf))
    return e.select("seq_id", *[F.array_join(F.col(f).cast("array<string>"), ",").alias(f) for f in V.TOKEN_FIELDS], "mask_length")


# Channel of each raw class; anything else is background.
CHANNELS = {1: 1, 2: 2, 3: 2, 5: 3, 7: 1}


@query("jn03_class_remap", "SELECT vec_id, label, CASE label WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 5 THEN 3 WHEN 7 THEN 1 ELSE 0 END AS channel FROM embeddings")
def class_remap(spark, sf):
    e = B.table(spark, sf, "embeddings").select("vec_id", "label")
    return e.select("vec_id", "label", F.coalesce(T.literal_map(CHANNELS, F.col("label")), F.lit(0)).alias("channel"))


@query("jn04_missing_references", "SELECT doc_id, source FROM documents d WHERE source <> 'src0' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_references(spark, sf):
    """Index rows without a file; one source is exempt."""
    files = B.table(spark, sf, "labels").select("doc_id").distinct()
    return docs(spark, sf, "source").where("source <> 'src0'").join(files, "doc_id", "left_anti")


@query("jn23_companion_files", """WITH i AS (SELECT doc_id, 'c/' || doc_id || ['.jpg', '_distorted.jpg', '-pre.jpg', ',x.png', '.png'][doc_id % 5 + 1] AS image FROM documents),
    l AS (SELECT doc_id, 'c/' || doc_id || '.semantic' AS label FROM labels)
    SELECT image, label FROM i JOIN l USING (doc_id) WHERE doc_id % 5 IN (0, 1, 4)""")
def companion_files(spark, sf):
    key = F.concat(F.lit("c/"), F.col("doc_id").cast("string"))
    images = docs(spark, sf).select(F.concat(key, B.pick([".jpg", "_distorted.jpg", "-pre.jpg", ",x.png", ".png"], F.col("doc_id") % 5)).alias("path"))
    labels = B.table(spark, sf, "labels").select(F.concat(key, F.lit(".semantic")).alias("path"))
    return D.companion_files(images, labels)


# A decoder is measured place by place: the n-th expected token of a sample against its n-th actual token.
def zipped_events(spark, sf):
    t = B.evt(spark, sf)
    n = F.row_number().over(C.W.partitionBy("seq_id", (F.col("user_id") % 2)).orderBy("pos"))
    rows = t.withColumn("n", n)
    exp = rows.where("user_id % 2 = 0").select("seq_id", "n", *[F.col(f).alias(f"exp_{f}") for f in FIELDS])
    act = rows.where("user_id % 2 = 1").select("seq_id", "n", *[F.col(f).alias(f"act_{f}") for f in FIELDS])
    both = exp.join(act, ["seq_id", "n"], "full")
    same = F.lit(True)
    for f in FIELDS:
        same = same & (F.col(f"exp_{f}") == F.col(f"act_{f}"))
    kind = (
        F.when(F.col("act_rhythm").isNull(), F.lit("delete"))
        .when(F.col("exp_rhythm").isNull(), F.lit("insert"))
        .when(same, F.lit("match"))
        .otherwise(F.lit("substitute"))
    )
    return both.withColumn("event_type", kind)


_EXP = ", ".join(f"{f} AS exp_{f}" for f in FIELDS)
_ACT = ", ".join(f"{f} AS act_{f}" for f in FIELDS)
ZIPPED = B.EVT + f""",
zn AS (SELECT *, row_number() OVER (PARTITION BY seq_id, user_id % 2 ORDER BY pos) AS n FROM evt),
ze AS (SELECT seq_id, n, {_EXP} FROM zn WHERE user_id % 2 = 0),
za AS (SELECT seq_id, n, {_ACT} FROM zn WHERE user_id % 2 = 1),
zip AS (SELECT *, CASE WHEN act_rhythm IS NULL THEN 'delete' WHEN exp_rhythm IS NULL THEN 'insert'
  WHEN {" AND ".join(f"exp_{f} = act_{f}" for f in FIELDS)} THEN 'match' ELSE 'substitute' END AS event_type
  FROM ze FULL JOIN za USING (seq_id, n))"""

_ACC = " UNION ALL ".join(
    [f"SELECT '{f}' AS branch, exp_{f} = act_{f} AS hit FROM pr WHERE exp_{f} <> '.'" for f in FIELDS]
    + [f"SELECT '{n}', exp_pitch = act_pitch FROM pr WHERE exp_pitch <> '.' AND {c}" for n, c in
       (("pitch_positional", "regexp_matches(exp_rhythm, '^(note|rest|clef)')"), ("pitch_other", "NOT regexp_matches(exp_rhythm, '^(note|rest|clef)')"))]
)


@query("ag10_branch_accuracy", f"""WITH {ZIPPED}, pr AS (SELECT * FROM zip WHERE exp_rhythm IS NOT NULL AND act_rhythm IS NOT NULL), l AS ({_ACC}),
    p AS (SELECT branch, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS correct, count(*) AS total FROM l GROUP BY 1),
    a AS (SELECT * FROM p UNION ALL SELECT 'all', CAST(sum(correct) AS BIGINT), CAST(sum(total) AS BIGINT) FROM p WHERE branch NOT LIKE 'pitch_%')
    SELECT branch, correct, total, correct / total AS accuracy FROM a""")
def branch_accuracy(spark, sf):
    z = zipped_events(spark, sf)
    masked = z.select(*[F.nullif(F.col(f"exp_{f}"), F.lit(".")).alias(f"label_{f}") for f in FIELDS], *[F.col(f"act_{f}").alias(f"pred_{f}") for f in FIELDS])
    return S.branch_accuracy(masked, FIELDS, T.has_position(F.col("label_rhythm")))


@query("ag18_confusion_iou", """WITH b AS (SELECT lang, quality AS p, toxic AS l FROM documents JOIN labels USING (doc_id)), s AS (SELECT lang, p = l AS same, p AS cls, 'p' AS side FROM b UNION ALL SELECT lang, p = l, l, 'l' FROM b)
    SELECT lang, cls, count(*) FILTER (same AND side = 'p') AS tp, count(*) FILTER (NOT same AND side = 'p') AS fp, count(*) FILTER (NOT same AND side = 'l') AS fn,
      count(*) FILTER (same AND side = 'p') / (count(*) FILTER (same AND side = 'p') + count(*) FILTER (NOT same)) AS iou FROM s GROUP BY ROLLUP (lang, cls)""")
def confusion_iou(spark, sf):
    lab = B.table(spark, sf, "labels")
    return S.confusion(docs(spark, sf, "lang").join(lab, "doc_id"), "lang", "quality", "toxic")


@query("ag22_skip_accounting", """SELECT source, count(*) AS processed, count(*) FILTER (n_chars < 100) AS skipped, count(*) FILTER (n_chars >= 100 AND NOT contains(text, '.')) AS failed FROM documents GROUP BY 1""")
def skip_accounting(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.groupBy("source").agg(
        F.count("*").alias("processed"), F.count_if(F.col("n_chars") < 100).alias("skipped"),
        F.count_if((F.col("n_chars") >= 100) & ~F.col("text").contains(".")).alias("failed"),
    )


@query("ag26_failure_accounting", """WITH f AS (SELECT d.lang, d.source, count(*) AS files, count(*) FILTER (l.doc_id IS NULL) AS empty, count(l.doc_id) AS usable, sum(quality) AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1, 2),
    g AS (SELECT lang, source, files, empty + CASE WHEN usable < 2 THEN usable ELSE 0 END AS failures, CASE WHEN usable >= 2 THEN q / usable END AS score FROM f)
    SELECT lang, source, CAST(sum(files) AS BIGINT) AS files, CAST(sum(failures) AS BIGINT) AS failures, count(score) AS rated, round(avg(score), 9) AS mean_score FROM g GROUP BY ROLLUP (lang, source)""")
def failure_accounting(spark, sf):
    """Groups with fewer than two usable files give no score and count as failed; group lines and totals in one pass."""
    lab = B.table(spark, sf, "labels").select("doc_id", "quality", F.lit(1).alias("has"))
    joined = docs(spark, sf, "lang", "source").join(lab, "doc_id", "left")
    f = joined.groupBy("lang", "source").agg(F.count("*").alias("files"), F.count_if(F.col("has").isNull()).alias("empty"), F.count("has").alias("usable"), F.sum("quality").alias("q"))
    g = f.select(
        "lang", "source", "files", (F.col("empty") + F.when(F.col("usable") < 2, F.col("usable")).otherwise(F.lit(0))).alias("failures"),
        F.when(F.col("usable") >= 2, F.col("q") / F.col("usable")).alias("score"),
    )
    return g.rollup("lang", "source").agg(F.sum("files").alias("files"), F.sum("failures").alias("failures"), F.count("score").alias("rated"), F.round(F.avg("score"), 9).alias("mean_score"))
