"""Membership filters and set operations on keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.operators.joins import join_lookup
from tillroll.operators.reduction import flag_offered
from tillroll.session import stage


def rows_on_offer(
    transactions: DataFrame, offers: DataFrame, *on: str, small: bool | None = None
) -> DataFrame:
    """Rows whose ``on`` columns together match some offer."""
    keys = offers.select(*on).distinct()
    kept = join_lookup(transactions, keys, on, "left_semi", small)
    return kept.select(*transactions.columns)


def offer_universe_rows(transactions: DataFrame, offers: DataFrame) -> DataFrame:
    """Distinct whole rows in an offered category or from an offered company."""
    items = ("category", "company")
    flagged = flag_offered(transactions, offers, items, only=True)
    return flagged.select(*transactions.columns).distinct()


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; distinct first, so that repeats are not shuffled."""
    return left.select(key).distinct().intersect(right.select(key).distinct())


def all_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).union(right.select(key)).distinct()


def only_left_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().subtract(right.select(key).distinct())


def attach(
    rows: DataFrame, feature: DataFrame, on: str | list[str], keep_unmatched: bool
) -> DataFrame:
    """Attach a feature table that holds each key once.

    With ``keep_unmatched`` rows without a match get zeros in the new columns
    only; otherwise they drop out.  The feature is computed once, as a table.
    """
    feature = stage(feature, "attached")
    if not keep_unmatched:
        return join_lookup(rows, feature, on)
    new = [c for c in feature.columns if c not in rows.columns]
    return join_lookup(rows, feature, on, "left").fillna(0, subset=new)


def frequency(rows: DataFrame, key: str, name: str = "n") -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias(name))


def compare_frequency(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]):
    """Counts per key on both sides, over all keys, zero where there is none."""
    both = frequency(left, key, names[0]).join(frequency(right, key, names[1]), key, "full")
    return both.fillna(0, subset=list(names))
