"""Joining a fact table with a lookup table that is unique on its keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tillroll.operators.blooms import KeyFilter, key_filter, only_possible
from tillroll.session import broadcast_limit, piece_rows

ROW_OVERHEAD_BYTES = 64
SAMPLED_PER_HOT_KEY = 1000


def broadcast_bytes(df: DataFrame) -> int:
    """Upper estimate of the memory the rows of ``df`` take when broadcast."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    sizes = df.agg(F.count("*"), *[F.sum(F.octet_length(c)) for c in text]).first()
    return sizes[0] * (ROW_OVERHEAD_BYTES + 16 * len(df.columns)) + sum(s or 0 for s in sizes[1:])


def fits_broadcast(df: DataFrame) -> bool:
    return broadcast_bytes(df) <= broadcast_limit(df.sparkSession)


def hot_keys(
    fact: DataFrame, on: Sequence[str], possible: KeyFilter | None = None
) -> DataFrame | None:
    """Keys, null included, with more rows than one piece may have, and their ``_pieces``.

    A piece has a fixed number of rows, so that no task grows with the table.
    Counted on a sample that a hot key shows up in about a thousand times.  The
    answer only decides how the join is spread out, never which rows it
    returns.  There are fewer such keys than the table has pieces.  With ``possible``
    only keys that pass are counted; just the sample is tested.
    """
    spark, rows_of_piece = fact.sparkSession, piece_rows(fact.sparkSession)
    fraction = min(1.0, SAMPLED_PER_HOT_KEY / rows_of_piece)
    keys = fact.select(*on)
    if fraction < 1:
        keys = keys.sample(fraction, seed=1)
    if possible:
        keys = only_possible(keys, possible)
    piece = rows_of_piece * fraction
    counts = keys.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > piece)
    hot = counts.select(*on, F.ceil(F.col("_n") / F.lit(piece)).cast("int").alias("_pieces"))
    rows = hot.collect()
    return spark.createDataFrame(rows, hot.schema) if rows else None


def join_lookup(
    fact: DataFrame,
    lookup: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    small: bool | None = None,
    count_on: DataFrame | None = None,
    filtered: bool | None = None,
) -> DataFrame:
    """Join ``fact`` with ``lookup``, which holds each key at most once.

    ``how`` is inner, left, left_semi or left_anti.  A lookup whose measured
    size is within the limit is broadcast, so the fact table is not shuffled;
    pass ``small`` if that has been settled already.  A larger one is joined
    by shuffle, with every hot key spread over as many pieces as its share of
    the rows asks for and its lookup row copied to each piece.  For left_semi
    a Bloom filter of the lookup first takes out most rows that match nothing,
    so that only the others are shuffled; ``filtered`` asks for that with inner.
    ``count_on`` has the same keys as ``fact`` and is cheaper to count.
    """
    on = [on] if isinstance(on, str) else list(on)
    if filtered is None:
        filtered = how == "left_semi"
    if small is None:
        small = fits_broadcast(lookup)
    if small:
        return fact.join(F.broadcast(lookup), on, how)
    counted = fact if count_on is None else count_on
    may_filter = filtered and how in ("inner", "left_semi")
    possible = key_filter(lookup.select(*on), fact, on) if may_filter else None
    if possible:
        fact = only_possible(fact, possible)
    hot = hot_keys(counted, on, possible)
    if hot is None:
        return fact.join(lookup, on, how)

    # The partition number keeps copies of one row apart, and unlike a random
    # number it is the same when a lost task runs again.
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *fact.columns), F.col("_pieces"))
    # Null keys match nothing but have to be somewhere as well.
    hot_names = {c: f"_hot_{c}" for c in on}
    same = [F.col(c).eqNullSafe(F.col(h)) for c, h in hot_names.items()]
    pieces = (
        fact.join(F.broadcast(hot.withColumnsRenamed(hot_names)), same, "left")
        .withColumn("_piece", F.coalesce(spread.cast("int"), F.lit(0)))
        .drop(*hot_names.values())
    )
    copies = lookup.join(F.broadcast(hot), on, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))
    )
    joined = pieces.drop("_pieces").join(copies.drop("_pieces"), [*on, "_piece"], how)
    return joined.drop("_piece")
