"""URL filter by listed hosts and paths: a blocked Bloom filter passes possible hits to an exact hash join.

A listed entry is a host and a path, canonically written ``host/path`` with the host in lower case. It fits its host and
all subdomains, where the path of the URL starts with the path of the entry; the longest entry that fits wins (of two as
long, the one with the longer host). A URL has one candidate key per *shape* of the list, a shape being a pair (labels
of the host, length of the path) that some entry has. Keys are probed in a filter of 512-bit blocks: one hash picks the
block, another sets a bit in each of its eight words. Only URLs with a possible hit are exploded and joined with the
list itself, which removes false positives; all others pass with no shuffle.

Bounds: the filter has at most ``MOST_BLOCKS`` blocks (8 MB, as a literal in the plan). A longer list makes more false
positives, never a wrong verdict. The shapes are collected: at most 127 labels times the distinct path lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

WORDS = 8  # 64-bit words of a block
BITS_PER_ENTRY = 16
MOST_BLOCKS = 1 << 17


def with_parts(df: DataFrame, url_col: str = "url", host_col: str = "host", path_col: str = "path") -> DataFrame:
    """Host (A-Z in lower case) and path of a URL. Null, or a text without ``://``: both empty. Columns of these names go."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({host_col: F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path_col: path})


def labels_of(host: Column) -> Column:
    return F.size(F.split(host, r"\.", -1))


def listed(rules: DataFrame) -> DataFrame:
    """Canonical entries of (verdict, host, path). Null hosts or paths count as empty; of entries listed twice with
    different verdicts the block stays; an entry without a verdict goes."""
    host = F.lower(F.coalesce("host", F.lit("")))
    path = F.coalesce("path", F.lit(""))
    return (
        rules.where(F.col("verdict").isNotNull())
        .select(host.alias("host"), path.alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.concat("host", F.lit("\0"), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict",
            labels_of(F.col("host")).alias("labels"), F.length("path").alias("path_length"), F.length("host").alias("host_length"),
        )
    )


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def bit_of(key: Column, word: int) -> Column:
    """The bit that a key sets in a word of its block, 0 to 63."""
    return F.shiftrightunsigned(F.xxhash64(F.lit("bits"), key), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom_words(entries: DataFrame, blocks: int) -> Column:
    """The filter as one constant array of ``blocks * WORDS`` longs."""
    one = F.lit(1).cast("long")
    ones = [F.bit_or(F.call_function("shiftleft", one, bit_of(F.col("key"), w))).alias(f"w{w}") for w in range(WORDS)]
    filled = {r[0]: r[1:] for r in entries.groupBy(block_of(F.col("key"), blocks).alias("block")).agg(*ones).collect()}
    words = [w for b in range(blocks) for w in filled.get(b, (0,) * WORDS)]
    return F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")


def possible(key: Column, words: Column, blocks: int) -> Column:
    """False only where the key is certainly not listed."""
    at = block_of(key, blocks) * WORDS
    probes = [F.call_function("getbit", F.get(words, at + w), bit_of(key, w)) == 1 for w in range(WORDS)]
    found = probes[0]
    for probe in probes[1:]:
        found = found & probe
    return found


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict (the rule's, or ``otherwise``).

    ``rules`` has verdict, host and path. Every row of ``pages`` stays once, repeated rows and null or malformed URLs
    included; columns named host, path, rule or verdict are replaced. No rules, or no pages: no row has a rule.
    """
    entries = listed(rules)
    shapes = [tuple(r) for r in entries.select("labels", "path_length").distinct().collect()]
    blocks = 1 << max(0, (entries.count() * BITS_PER_ENTRY // (64 * WORDS)).bit_length())
    blocks = min(blocks, MOST_BLOCKS)
    hits = free_name(pages, "_hits")
    plain = with_parts(pages.drop("rule", "verdict"), url_col)
    columns = plain.columns
    if not shapes:
        return plain.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    labels, length = labels_of(F.col("host")), F.length("path")
    keys = F.array(*[
        F.when((labels >= n) & (length >= m), F.concat(F.substring_index("host", ".", -n), F.lit("\0"), F.substring("path", 1, m)))
        for n, m in sorted(shapes)
    ])
    words = bloom_words(entries, blocks)
    probed = plain.withColumn(hits, F.filter(keys, lambda k: k.isNotNull() & possible(k, words, blocks)))
    # The rule depends on host and path alone: each pair is looked up once, whatever the number of its rows.
    rule_of = (
        probed.where(F.size(hits) > 0)
        .groupBy("host", "path").agg(F.first(hits).alias("_keys"))
        .select("host", "path", F.explode("_keys").alias("key"))
        .join(entries, "key")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule"), "host_length", "rule", "verdict")).alias("_best"))
        .select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("_v"))
    )
    looked_up = probed.where(F.size(hits) > 0).drop(hits).alias("p").join(
        rule_of.alias("r"), (F.col("p.host") == F.col("r._h")) & (F.col("p.path") == F.col("r._p")), "left"
    ).select(*[F.col(f"p.`{c}`") for c in columns], "r.rule", F.coalesce("r._v", F.lit(otherwise)).alias("verdict"))
    unlisted = probed.where(F.size(hits) == 0).select(*[F.col(f"`{c}`") for c in columns], F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    return looked_up.unionByName(unlisted)
