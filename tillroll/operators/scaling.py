"""Purchases that match an offer, as rows to cluster with z-scored numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.sources.schemas import ITEMS

NUMERIC = ("purchasequantity", "purchaseamount", "day_diff")


def clustering_rows(events: DataFrame, items: tuple[str, ...] = ITEMS) -> DataFrame:
    """Matched events, one row per item that matches: shopper, item, value, numbers.

    One pass over the events, however many items.  Events without a date or a
    number have no place among the others and are left out.
    """
    matches = [
        F.when(
            F.col(item) == F.col(f"offer_{item}"),
            F.struct(F.lit(item).alias("item"), F.col(item).cast("string").alias("value")),
        )
        for item in items
    ]
    numbers = [F.col(c).cast("double").alias(c) for c in NUMERIC]
    placed = events.dropna(subset=list(NUMERIC))
    return placed.select("id", F.inline(F.array_compact(F.array(*matches))), *numbers)


def scaling_stats(rows: DataFrame) -> DataFrame:
    """Mean and population standard deviation per item, one row each.

    A column without spread is only centred.
    """
    stats = rows.groupBy("item").agg(
        *[F.avg(c).alias(f"_mean_{c}") for c in NUMERIC],
        *[F.stddev_pop(c).alias(f"_std_{c}") for c in NUMERIC],
    )
    scales = {f"_std_{c}": F.when(F.col(f"_std_{c}") == 0, 1.0).otherwise(F.col(f"_std_{c}"))
              for c in NUMERIC}
    return stats.withColumns(scales)


def zscore(rows: DataFrame) -> DataFrame:
    """``rows`` with each number as distance from its item's mean in deviations.

    The statistics are one row per item, three in all.
    """
    scaled = rows.join(F.broadcast(scaling_stats(rows)), "item")
    return scaled.select(
        *[c for c in rows.columns if c not in NUMERIC],
        *[((F.col(c) - F.col(f"_mean_{c}")) / F.col(f"_std_{c}")).alias(c) for c in NUMERIC],
    )
