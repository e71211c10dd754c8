"""I-Match document fingerprints in DataFrame functions only.

Terms whose inverse document frequency lies in a band form the lexicon; a text's distinct lexicon terms are sorted and
hashed once whole and once for each of several random parts of the lexicon. The parts keep different shares of it, so that
long and short texts both have parts in which a small edit changes nothing.

Terms are 64-bit hashes; document frequencies are counted in 2^20 slots. The band is a share of all documents, so at most
(mean distinct terms of a text / least share) slots can be in it, and the lexicon is a bit map of 128 KB at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

SLOT_BITS = 20
LEAST_SHARE, MOST_SHARE = 0.0005, 0.3

#: The lexicon is halved at random again and again, in independent ways; a part is what one way has left of it after so
#: many halvings. The whole lexicon is the first part.
WAYS, HALVINGS = 12, (2, 4, 6, 8, 10, 12)


def terms(text: Column) -> Column:
    """Sorted distinct term hashes; terms are the letter and digit runs of the lower-cased text."""
    words = F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+")), lambda w: w != "")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def slot(term: Column) -> Column:
    return F.shiftrightunsigned(term, 64 - SLOT_BITS).cast("int")


def lexicon(docs: DataFrame, text_col: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> Column:
    """Bit map of the slots whose document frequency lies in the band, as a constant column (2^20 bits)."""
    n = docs.count()
    each = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).select(slot(F.col("term")).alias("slot"))
    counts = each.groupBy("slot").count().where(F.col("count").between(least * n, most * n))
    words = counts.groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, slot % 64))").alias("bits"))
    bits = [0] * (1 << SLOT_BITS - 6)
    for row in words.collect():  # at most 16 384 numbers
        bits[row["word"]] = row["bits"]
    return F.split(F.lit(",".join(map(str, bits))), ",").cast("array<bigint>")


def in_band(found: Column, bits: Column) -> Column:
    """The terms in the lexicon; all terms where a text has none there."""
    kept = F.filter(found, lambda t: F.getbit(F.get(bits, F.shiftright(slot(t), 6)), slot(t).bitwiseAND(63)) == 1)
    return F.when(F.size(kept) > 0, kept).otherwise(found)


def with_parts(df: DataFrame, name: str, text_col: str, bits: Column) -> DataFrame:
    """``df`` with column ``name``: one 32-bit hash per lexicon part, null where the text has no term in it.

    Each part is filtered from the larger one of its way, so all parts together read the terms about twenty times.
    """
    parts = {0: [f"_{name}_0"]}
    df = df.withColumn(f"_{name}_all", terms(F.col(text_col))).withColumn(parts[0][0], in_band(F.col(f"_{name}_all"), bits))
    for before, n in zip((0, *HALVINGS), HALVINGS):
        parts[n] = [f"_{name}_{n}_{way}" for way in range(WAYS)]

        def left(way: int, n: int = n, before: int = before) -> Column:
            source = F.col(parts[before][way if before else 0])
            return F.filter(source, lambda t: F.xxhash64(t, F.lit(way)).bitwiseAND((1 << n) - 1) == 0)

        df = df.withColumns({parts[n][way]: left(way) for way in range(WAYS)})
    hashes = [
        F.when(F.size(c) > 0, F.shiftright(F.xxhash64(c), 32).cast("int")) for n in (0, *HALVINGS) for c in parts[n]
    ]
    return df.withColumn(name, F.array(*hashes)).drop(f"_{name}_all", *[c for cs in parts.values() for c in cs])


def as_text(hashes: Column) -> Column:
    """Eight hex digits per part, dots between, ``-`` for a part without terms."""
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), F.lit("-"))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Weight of equal parts among those that either text has terms in; 1.0 for two fingerprints without any term.

    Small parts weigh more (the root of how often the lexicon was halved into them): their equality estimates the share of
    common terms, while large ones are equal only for nearly equal texts.
    """
    weights = F.lit([1.0, *(2.0 ** (n / 2) for n in HALVINGS for _ in range(WAYS))])
    both = F.arrays_zip(a.alias("a"), b.alias("b"), weights.alias("w"))

    def total(which) -> Column:
        return F.aggregate(both, F.lit(0.0), lambda acc, p: acc + F.when(which(p), p["w"]).otherwise(0.0))

    either = total(lambda p: p["a"].isNotNull() | p["b"].isNotNull())
    alike = F.when(either == 0, 1.0).otherwise(total(lambda p: p["a"] == p["b"]) / either)
    return F.when(a.isNotNull() & b.isNotNull(), alike)


def following(ids: DataFrame) -> DataFrame:
    """(id, next_id) over distinct non-null ids in ascending order, the last followed by the first; no global sort in one
    task: ids are ranged over partitions, and each partition's last looks to the next partition's first."""
    ranged = cut(
        ids.where("id is not null").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id())
    )
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first"))  # one row per partition
    order = Window.orderBy("part")
    least = F.min("first").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("part", F.coalesce(F.lead("first").over(order), least).alias("after"))
    inside = F.lead("id").over(Window.partitionBy("part").orderBy("id"))
    return ranged.withColumn("inside", inside).join(F.broadcast(after), "part").select(
        "id", F.coalesce("inside", "after").alias("next_id")
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to the edited text and to the next document.

    The edited text has its last floor(n / 2) characters replaced by the first as many (or all) of the next document's.
    Null texts are empty; a text without terms has a fingerprint of empty parts. Rows that repeat an id are kept; as next
    document such an id counts once, with its least text. A row without an id has no next document: its edited text only
    loses its half, near_next is 0. Other columns are not read; an empty table gives no rows.

    Texts are shuffled by id once; from there each document sends the head of its text and its fingerprint to the one
    before it, which it meets with the kept half only.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = lexicon(rows)
    named = rows.where("doc_id is not null")
    need = rows.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("need"))
    chain = cut(
        following(rows.select(F.col("doc_id").alias("id"))).join(need, F.col("id") == F.col("doc_id")).select("id", "next_id", "need")
    )
    heads = named.join(chain, F.col("doc_id") == F.col("next_id")).select("id", "text", F.expr("left(text, need)").alias("head"))
    sent = with_parts(heads, "next", "text", bits).groupBy("id").agg(F.min(F.struct("head", "next")).alias("sent"))
    halved = rows.withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    own = with_parts(halved, "own", "text", bits).select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), "half", "own",
        F.expr("left(text, length(text) - half)").alias("kept"),
    )
    joined = own.join(sent, F.col("doc_id") == F.col("id"), "left")
    edited = joined.select(
        "doc_id", "n_chars", "own", "sent.next", F.expr("concat(kept, coalesce(left(sent.head, half), ''))").alias("edited")
    ).withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256))
    prints = with_parts(edited, "changed", "edited", bits)
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        F.coalesce(likeness(F.col("own"), F.col("next")), F.lit(0.0)).alias("near_next"),
    )
