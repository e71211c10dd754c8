"""Set containment join: which sets hold every element of an item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Parts that the postings of one element are split into.
PARTS = 16
#: Rows up to which a counted table of keys is broadcast; a larger one is joined by a shuffle.
MOST_BROADCAST = 1 << 18


def _counted(keys: DataFrame) -> DataFrame:
    """``keys``, written once, with the hint to broadcast them where they are few."""
    keys = keys.checkpoint()
    return F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys


def containing(sets: DataFrame, set_id: str, items: DataFrame, item_id: str, elements: str) -> DataFrame:
    """(item_id, set_id) of all pairs where the set has all elements of the item; repeats and nulls in them do not count.

    An item probes with its rarest element only, as every set that holds the item holds that one, and only the sets found
    so are read once more and compared. ``sets`` is read three times: to count elements, to find candidates, to compare.
    What is shuffled are counts per element, pairs of ids, and each candidate set once; no set is copied per element. Only
    where more than ``MOST_BROADCAST`` elements probe or sets are candidates, all elements or all sets are shuffled, still
    once each. The postings of an element are then split into ``PARTS`` by set, so a common element that is an item's
    rarest is no hot key. An item without elements is in every set and has no pairs here.
    """
    ensure_checkpoint_dir(sets.sparkSession)
    every = F.array_compact(F.array_distinct(F.flatten(F.collect_list(elements))))  # of all rows that repeat an item's id
    needs = items.groupBy(item_id).agg(every.alias("_need")).where(F.size("_need") > 0)
    needed = needs.select(item_id, F.explode("_need").alias("_element"))
    postings = sets.select(set_id, F.explode(F.array_distinct(elements)).alias("_element"))
    frequency = postings.groupBy("_element").agg(F.count("*").alias("_n"))
    rarest = needed.join(frequency, "_element", "left").groupBy(item_id).agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_element")).alias("_rarest")
    )
    probes = rarest.where("_rarest._n > 0").select(item_id, "_rarest._element")
    salted = probes.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = postings.withColumn("_part", F.pmod(F.xxhash64(set_id), F.lit(PARTS)).cast("int"))
    candidates = dealt.join(_counted(salted), ["_element", "_part"]).select(set_id, item_id).distinct().checkpoint()
    found = sets.join(_counted(candidates.select(set_id).distinct()), set_id, "left_semi").select(set_id, F.array_distinct(elements).alias("_have"))
    pairs = candidates.join(needs, item_id).join(found, set_id)
    # rows that repeat a set's id hold its elements together
    held = F.flatten(F.collect_list(F.array_intersect("_need", "_have")))
    whole = pairs.groupBy(item_id, set_id).agg(F.first("_need").alias("_need"), held.alias("_held"))
    return whole.where(F.size(F.array_except("_need", "_held")) == 0).select(item_id, set_id)
