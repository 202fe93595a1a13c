"""Cutting the log down to the rows that have to do with some offer."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.blooms import flag_possible, key_filter, passing_others
from tillroll.operators.joins import fits_broadcast, join_lookup
from tillroll.sources.files import frame_state, reuse_or_build
from tillroll.sources.schemas import ITEMS


def flag_offered(
    transactions: DataFrame,
    offers: DataFrame,
    items: tuple[str, ...] = ITEMS,
    *,
    only: bool = False,
    small: bool | None = None,
    count_on: DataFrame | None = None,
) -> DataFrame:
    """Add ``<item>_offered``: is this row's item in any offer?

    Joins on distinct keys keep every row once, where one join with an OR
    condition would compare every row with every offer.  Each key set is
    measured by itself: many offers may have few categories.  One too large
    to broadcast (``small`` settles that for all) is tested by a Bloom filter,
    and the few keys that wrongly pass are taken out again, so the rows
    themselves stay where they are.  Only where that can't be either are they
    shuffled.  ``only`` keeps just rows with some item on offer.  ``count_on``
    has the same keys as ``transactions`` and is cheaper to read.
    """
    flagged, narrow = transactions, transactions if count_on is None else count_on
    filters, beyond = {}, []
    for item in items:
        keys = offers.select(item).distinct()
        if fits_broadcast(keys) if small is None else small:
            flagged = _flag_exactly(flagged, keys, item, True)
        elif found := key_filter(keys, transactions, item):
            filters[item] = found
            flagged = flag_possible(flagged, found, f"{item}_offered")
        else:
            beyond.append(item)
    if only and filters and not beyond:
        flagged = flagged.where(any_offered(items))
    for item, found in filters.items():
        others = passing_others(narrow, found, offers.select(item).distinct())
        wrong = others.withColumn("_wrong", F.lit(True))
        flagged = join_lookup(flagged, wrong, item, "left", count_on=narrow)
        right = F.col(f"{item}_offered") & F.col("_wrong").isNull()
        flagged = flagged.withColumn(f"{item}_offered", right).drop("_wrong")
    for item in beyond:
        keys = offers.select(item).distinct()
        flagged = _flag_exactly(flagged, keys, item, False, narrow)
    return flagged.where(any_offered(items)) if only else flagged


def _flag_exactly(
    rows: DataFrame, keys: DataFrame, item: str, small: bool, count_on: DataFrame | None = None
) -> DataFrame:
    hits = keys.withColumn("_hit", F.lit(True))
    flagged = join_lookup(rows, hits, item, "left", small, count_on)
    return flagged.withColumn(f"{item}_offered", F.col("_hit").isNotNull()).drop("_hit")


def any_offered(items: tuple[str, ...] = ITEMS):
    return reduce(or_, [F.col(f"{item}_offered") for item in items])


def reduce_transactions(
    transactions: DataFrame, offers: DataFrame, small: bool | None = None
) -> DataFrame:
    """Rows whose category, company or brand is in some offer."""
    kept = flag_offered(transactions, offers, only=True, small=small)
    return kept.select(*transactions.columns)


def reduction_stats(transactions: DataFrame, offers: DataFrame) -> DataFrame:
    """One row: rows searched and rows kept."""
    return flag_offered(transactions, offers).agg(
        F.count("*").alias("searched"), F.count_if(any_offered()).alias("kept")
    )


def offer_key_counts(offers: DataFrame) -> DataFrame:
    """One row: distinct categories, companies and brands on offer."""
    return offers.agg(
        F.countDistinct("category").alias("categories"),
        F.countDistinct("company").alias("companies"),
        F.countDistinct("brand").alias("brands"),
    )


def reduced_table(
    spark: SparkSession,
    path: str,
    transactions: DataFrame,
    offers: DataFrame,
    state: str | None = None,
) -> tuple[DataFrame, dict[str, int]]:
    """The saved reduction at ``path`` and its counts, made first unless it is there.

    It is made again if the log or the offers have changed; ``state`` names
    theirs, by default what their plans and files say.  The counts, rows searched
    and rows kept, come from the pass that writes it.
    """
    if state is None:
        state = frame_state(transactions, offers)
    searched = Observation()

    def build() -> DataFrame:
        rows = transactions.observe(searched, F.count(F.lit(1)).alias("n"))
        kept = flag_offered(rows, offers, only=True, count_on=transactions)
        return kept.select(*transactions.columns)

    kept = {"kept": F.count(F.lit(1))}
    return reuse_or_build(
        spark, path, build, state, kept, lambda: {"searched": searched.get["n"]}
    )
