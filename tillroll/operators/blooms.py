"""Bloom filters of key sets that are too large to broadcast.

The filter is a table: a key has one block, by its hash, and sets one bit in
each of the block's words.  It takes about a twentieth of what the keys take as a
lookup, so a table can be tested against many more keys without a shuffle.
A key that passes may still be another one; whoever filters makes sure of
that afterwards, with few rows or few keys left.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.session import broadcast_limit, stage

WORDS = 8  # of 64 bits
KEYS_PER_BLOCK = 40  # 0.3 % of other keys pass
MOST_KEYS_PER_BLOCK = 80  # 7 % pass
BLOCK_BYTES = 64 + 16 * (WORDS + 1)  # in memory, as broadcast
HASHED_ALIKE = ("tinyint", "smallint", "int", "bigint", "string", "date")


@dataclass(frozen=True)
class KeyFilter:
    """``words`` has one row per block that holds a key."""

    on: tuple[str, ...]
    blocks: int
    words: DataFrame


def _block(on: Sequence[str], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(blocks))


def _bits(on: Sequence[str]) -> list[Column]:
    """The bit a key has in each word: six bits of a second hash each."""
    places = F.xxhash64(F.lit("bits"), *on)
    return [F.shiftrightunsigned(places, 6 * w).bitwiseAND(F.lit(63)) for w in range(WORDS)]


def key_filter(keys: DataFrame, rows: DataFrame, on: str | Sequence[str]) -> KeyFilter | None:
    """A filter of the distinct ``keys`` for ``rows``, or None.

    There is none if even the filter would exceed the limit for broadcasts,
    or if keys of the two tables that are equal need not hash alike, such as
    an int and a bigint.
    """
    on = (on,) if isinstance(on, str) else tuple(on)
    types = [keys.schema[c].dataType for c in on]
    if types != [rows.schema[c].dataType for c in on]:
        return None
    if any(t.simpleString() not in HASHED_ALIKE for t in types):
        return None
    count = keys.count()
    most = max(broadcast_limit(keys.sparkSession) // BLOCK_BYTES, 0)
    blocks = min(max(1, math.ceil(count / KEYS_PER_BLOCK)), most)
    if blocks == 0 or count / blocks > MOST_KEYS_PER_BLOCK:
        return None
    one_bit = [
        F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int")) for bit in _bits(on)
    ]
    marked = keys.dropna(subset=list(on)).select(
        _block(on, blocks).alias("_block"), *[m.alias(f"_w{i}") for i, m in enumerate(one_bit)]
    )
    words = marked.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(WORDS)])
    return KeyFilter(on, blocks, stage(words, "bloom"))


def flag_possible(rows: DataFrame, keys: KeyFilter, name: str) -> DataFrame:
    """Add ``name``: may the row's key be in the set?  False is certain, null keys are not in it."""
    beside = rows.withColumn("_block", _block(keys.on, keys.blocks))
    beside = beside.join(F.broadcast(keys.words), "_block", "left")
    passed = F.lit(True)
    for i, bit in enumerate(_bits(keys.on)):
        found = F.call_function("shiftrightunsigned", F.col(f"_w{i}"), bit.cast("int"))
        passed = passed & (found.bitwiseAND(F.lit(1)) == 1)
    for c in keys.on:
        passed = passed & F.col(c).isNotNull()
    return beside.select(*rows.columns, F.coalesce(passed, F.lit(False)).alias(name))


def only_possible(rows: DataFrame, keys: KeyFilter) -> DataFrame:
    """Rows whose key may be in the set: all that are, and few others."""
    return flag_possible(rows, keys, "_possible").where("_possible").drop("_possible")


def passing_others(rows: DataFrame, keys: KeyFilter, exact: DataFrame) -> DataFrame:
    """Keys of ``rows`` that pass the filter but are not in ``exact``, the set itself.

    Only the distinct keys that pass are shuffled, so a hot key is one row.
    """
    passed = only_possible(rows.select(*keys.on), keys).distinct()
    return stage(passed.join(exact, list(keys.on), "left_anti"), "passed")
