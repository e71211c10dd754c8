"""The registered queries of this folder. Each is thin: the operator does the work, the query derives the digest columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import centroids, conversations, decontaminate, extraction, imatch, language_id, language_model, packing, quality, secrets, simhash, toxicity, urls
from .common import id_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def byte_vocabulary() -> tuple[str, str, str]:
    files = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return (*files, public_tokenizers.PATTERN)


@query("op1_grouping_genetic_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_vocabulary())


@query("op2_imatch_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op3_kneser_ney_scoring")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_remainder("doc_id", 7) == 2
    found, model = language_model.train_and_score(table(spark, sf_dir, "documents"), held_out)
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


@query("op4_simhash_ball_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query("op5_tag_path_extraction")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op6_fm_index_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_fourier_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query("op8_output_code_language")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs))
    return found.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op9_compression_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@query("op10_trigram_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("_spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id", *[count(k) for k in secrets.BASE_KINDS], F.sha2(secrets.span_text(base), 256).alias("base_sha256"),
        secrets.span_text(F.col("_spans")).alias("spans"),
    )


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query("op11_bloom_url_filter", """
    with parts as (
        select page_id,
            translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
        from (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages)
    ), rules(verdict, h, p) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
    ), fits as (
        select host, path, arg_max(h || p, length(h || p)) as rule, arg_max(verdict, length(h || p)) as verdict
        from (select distinct host, path from parts) join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
        group by host, path
    )
    select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join fits using (host, path)
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@query("op12_survivor_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    original = table(spark, sf_dir, "conversations")
    found = conversations.summaries(conversations.damaged(original)).withColumnRenamed("conv_id", "_id")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    ids = original.select("conv_id").distinct()
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def kmeans_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain k-means as a chain of tables, all centroids measured for every vector."""
    steps = ["""v as materialized (
        select vec_id, list_transform(embedding, lambda x: cast(floor(x::double * 1024) as bigint)) as x from embeddings
        where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
    ), c0 as materialized (
        select row_number() over (order by sha256('3:' || vec_id), x) - 1 as c, x from (select * from v order by sha256('3:' || vec_id), x limit %d)
    )""" % k]
    nearest = """a{0} as materialized (
        select vec_id, x, (first(struct_pack(d, c) order by d, c)) as best
        from (select v.rowid_ as r, vec_id, v.x, c, list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d
              from (select *, row_number() over () as rowid_ from v) v cross join c{0} m)
        group by r, vec_id, x)"""
    for n in range(rounds):
        steps.append(nearest.format(n))
        steps.append(f"""c{n + 1} as materialized (
            select c, coalesce(moved, o.x) as x from c{n} o left join (
                select c, list(floor_mean order by i) as moved from (
                    select c, i, ((s - ((s % n) + n) % n) // n)::bigint as floor_mean
                    from (select best.c as c, i, sum(x[i])::hugeint as s, count(*)::hugeint as n from a{n}, unnest(range(1, 65)) t(i) group by 1, 2)
                ) group by c) using (c))""")
    steps.append(nearest.format(rounds))
    return f"""with {', '.join(steps)}
        select vec_id, best.c::int as cluster, best.d as distance, (sum(best.d) over (partition by best.c))::bigint as cluster_inertia,
            (sum(best.d) over ())::bigint as inertia, sha256(array_to_string(m.x, ',')) as centroid_sha256
        from a{rounds} join c{rounds} m on m.c = best.c"""


@query("op13_equal_average_clusters", kmeans_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned, found = centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.tolist()]
    return centroids.inertias(assigned).withColumn("centroid_sha256", F.get(F.array(*map(F.lit, digests)).cast("array<string>"), F.col("cluster")))
