"""Features of a shopper's purchases, looking back from the own offer date.

Every purchase of a shopper in the spine becomes one event row with a set of
measures; each feature is then one conditional aggregate over the events.
For the wide feature table the events are first added up per shopper and
look-back band, so that the wide aggregate sees a few short rows per shopper.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import cents, day_diff, zero_if_null
from tillroll.operators.joins import join_lookup
from tillroll.sources.schemas import ITEMS

DAY_LIMITS = (30, 60, 90, 120, 150, 180, 1000)
RECENT_DAYS = 29
BEYOND = 2**31 - 1


def history_events(
    transactions: DataFrame,
    spine: DataFrame,
    before_offer: bool = False,
    small: bool | None = None,
) -> DataFrame:
    """All purchases of the shoppers in the spine, beside their own offer.

    As in the original definition later purchases count too, with a negative
    ``day_diff``; ``before_offer`` leaves them out.
    """
    own = [c for c in (*ITEMS, "dept") if c in spine.columns]
    lookup = spine.select("id", "offerdate", *[F.col(c).alias(f"offer_{c}") for c in own])
    bought = transactions.select("id", *own, "date", "purchasequantity", "purchaseamount")
    events = join_lookup(bought, lookup, "id", small=small)
    events = events.withColumn("day_diff", day_diff("offerdate", "date"))
    return events.where("day_diff > 0") if before_offer else events


def matched_events(events: DataFrame, *items: str) -> DataFrame:
    """Events that agree with the shopper's offer on all ``items``."""
    return events.where(reduce(and_, [F.col(i) == F.col(f"offer_{i}") for i in items])).select(
        "id", *items, "offerdate", "date", "purchasequantity", "purchaseamount", "day_diff"
    )


def _band(day_limits: Sequence[int | None], recent_days: int) -> Column:
    """The day itself while recent, then the next larger limit."""
    band = F.when(F.col("day_diff") <= recent_days, F.col("day_diff"))
    for limit in sorted({n for n in day_limits if n is not None and n > recent_days}):
        band = band.when(F.col("day_diff") <= limit, F.lit(limit))
    return band.otherwise(F.lit(BEYOND))


def event_measures(
    events: DataFrame,
    day_limits: Sequence[int | None] = DAY_LIMITS,
    recent_days: int = RECENT_DAYS,
) -> DataFrame:
    """One row per event: shopper, look-back band and what the event adds.

    Measures that no feature asks for are pruned from the plan.
    """
    amount = zero_if_null(cents("purchaseamount"))
    quantity = zero_if_null(F.col("purchasequantity").cast("bigint"))
    # A missing key agrees with no offer.
    compared = [*ITEMS, "dept"] if "dept" in events.columns else ITEMS
    hits = {c: F.coalesce(F.col(c) == F.col(f"offer_{c}"), F.lit(False)) for c in compared}
    hits["own"] = reduce(and_, [hits[c] for c in ITEMS])

    columns = {"cents_all": amount}
    for name, hit in hits.items():
        columns[f"n_{name}"] = hit.cast("bigint")
        columns[f"cents_{name}"] = F.when(hit, amount).otherwise(F.lit(0))
        columns[f"quantity_{name}"] = F.when(hit, quantity).otherwise(F.lit(0))
    return events.select(
        "id",
        _band(day_limits, recent_days).alias("band"),
        *[c.alias(n) for n, c in columns.items()],
        F.when(hits["own"], cents("purchaseamount")).alias("lowest_own"),
        F.col("day_diff").alias("first_day"),
        F.col("day_diff").alias("last_day"),
    )


def add_up(measures: DataFrame) -> DataFrame:
    """Add the measures up per shopper and band; sums can be added up again."""
    how = {"first_day": F.max, "last_day": F.min, "lowest_own": F.min}
    values = [c for c in measures.columns if c not in ("id", "band")]
    return measures.groupBy("id", "band").agg(*[how.get(c, F.sum)(c).alias(c) for c in values])


def roll_up(measures: DataFrame) -> DataFrame:
    """Add the measures up per shopper and band, then gather each shopper.

    The first shuffle is on (shopper, band) after a partial sum, so a shopper
    with very many purchases does not fill one task.  What is gathered per
    shopper is one short row per band and recent day, however many purchases
    there were.
    """
    return add_up(measures).repartition("id")


# The features below are SQL aggregates over measure rows, rolled up or not.


def _within(limit: int | None, column: str) -> str:
    return f"sum({column})" if limit is None else f"sum(if(band <= {limit}, {column}, 0))"


def _money(total: str) -> str:
    return f"{total} / 100D"


def grid_name(measure: str, item: str, limit: int | None) -> str:
    return f"{measure}_{item}_{'all' if limit is None else limit}"


def grid_features(
    measure: str, items: Sequence[str] = ITEMS, day_limits: Sequence[int | None] = DAY_LIMITS
) -> dict[str, str]:
    """``n``, ``amount`` or ``quantity`` by item and look-back limit."""
    grid = {}
    for item in items:
        for limit in day_limits:
            if measure == "amount":
                total = _money(_within(limit, f"cents_{item}"))
            else:
                total = _within(limit, f"{measure}_{item}")
            grid[grid_name(measure, item, limit)] = total
    return grid


def ever_features(items: Sequence[str] = ITEMS) -> dict[str, str]:
    return {f"ever_{item}": f"if(sum(n_{item}) > 0, 1, 0)" for item in items}


def total_spend_feature() -> dict[str, str]:
    return {"total_spend": _money("sum(cents_all)")}


def recent_spend_feature(recent_days: int = RECENT_DAYS) -> dict[str, str]:
    return {"recent_spend": _money(_within(recent_days, "cents_all"))}


def own_recent_features(recent_days: int = RECENT_DAYS) -> dict[str, str]:
    return {
        "own_recent_amount": _money(_within(recent_days, "cents_own")),
        "own_recent_quantity": _within(recent_days, "quantity_own"),
    }


def own_features() -> dict[str, str]:
    return {"own_amount": _money("sum(cents_own)"), "own_quantity": "sum(quantity_own)"}


def dept_features(recent_days: int = RECENT_DAYS) -> dict[str, str]:
    return {
        "dept_recent_amount": _money(_within(recent_days, "cents_dept")),
        "dept_recent_quantity": _within(recent_days, "quantity_dept"),
    }


def recency_features() -> dict[str, str]:
    return {"days_since_first": "max(first_day)", "days_since_last": "min(last_day)"}


def returned_feature() -> dict[str, str]:
    """Was the own product ever returned?  Zero if it was never bought."""
    return {"returned": "if(sum(n_own) > 0 and not coalesce(min(lowest_own) >= 0, false), 1, 0)"}


def visit_feature(recent_days: int = RECENT_DAYS) -> dict[str, str]:
    """Purchase days in the recent past; needs rolled-up rows, one per day."""
    return {"recent_visits": f"count_if(band <= {recent_days})"}


def per_shopper(measures: DataFrame, features: dict[str, str]) -> DataFrame:
    """One row per shopper; ``measures`` may be rolled up or not."""
    return measures.groupBy("id").agg(*[F.expr(sql).alias(n) for n, sql in features.items()])
