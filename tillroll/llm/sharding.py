"""Rendezvous hashing of stable record keys over weighted shards.

Each shard draws a number ``u`` in (0, 1) for each key from a hash of key and
shard, and the shard with the highest ``weight / -ln(u)`` wins.  A shard's share of
the keys follows its weight; a shard that is added takes keys only into
itself, one that is removed gives up only its own.

Edge cases: a null key is a key of its own (all null keys share a shard); a
null text counts as empty; repeated rows share a shard and get slots of their
own; an empty table gives an empty result; columns named like the result's
are replaced, all others can be kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HASH_BITS = 52
# Slots are numbered bucket by bucket, so that no task holds a whole shard.
SLOT_BUCKETS = 4096


def unit_hash(key: Column, shard: int) -> Column:
    """A number in (0, 1) that key and shard decide."""
    text = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(shard)))
    number = F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("double")
    return (number + 0.5) / F.lit(float(1 << HASH_BITS))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard, from 0, that wins ``key``; ties go to the higher number."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("weights must be positive")
    bids = [
        F.struct((F.lit(float(w)) / -F.ln(unit_hash(key, s))).alias("bid"), F.lit(s).alias("shard"))
        for s, w in enumerate(weights)
    ]
    return (F.greatest(*bids) if len(bids) > 1 else bids[0])["shard"]


def gapless_slots(rows: DataFrame, shard: str, order: Sequence[str], slot: str = "slot") -> DataFrame:
    """Number the rows of each shard from 0, with no gap.

    A row's bucket comes from a hash of ``order``.  The buckets of a shard
    are counted and their counts added up, then rows are numbered within
    their bucket; both windows stay far smaller than a shard.
    """
    bucketed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(SLOT_BUCKETS)))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        bucketed.groupBy(shard, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    place = Window.partitionBy(shard, "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_place", F.row_number().over(place) - 1)
    return (
        numbered.join(starts, [shard, "_bucket"])
        .withColumn(slot, (F.col("_start") + F.col("_place")).cast("long"))
        .drop("_bucket", "_start", "_place")
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], grown: Sequence[float]) -> DataFrame:
    """Shard, slot and grown shard of each document; texts are measured, not moved.

    ``weights`` are those of the shards now, ``grown`` those after shards were
    added.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).cast("int").alias("shard"),
        rendezvous(F.col("doc_id"), grown).cast("int").alias("grown_shard"),
    )
    return gapless_slots(keyed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
