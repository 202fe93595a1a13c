"""How offered products and categories sell over all shoppers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions import cents, day_diff, money, zero_if_null
from tillroll.operators.joins import join_lookup
from tillroll.operators.keysets import offer_universe_rows, rows_on_offer
from tillroll.operators.reduction import flag_offered
from tillroll.session import stage
from tillroll.sources.schemas import ITEMS


def shopper_totals(transactions: DataFrame) -> DataFrame:
    """Total spend of every shopper in the log, in the spine or not."""
    known = transactions.where("id is not null")
    totals = known.groupBy("id").agg(F.sum(cents("purchaseamount")).alias("_c"))
    return totals.select("id", money("_c").alias("total_spend"))


def user_count(transactions: DataFrame) -> DataFrame:
    return transactions.agg(F.countDistinct("id").alias("users"))


def product_counts(transactions: DataFrame, offers: DataFrame) -> DataFrame:
    """Rows per offered product, copies included."""
    sold = rows_on_offer(transactions, offers, *ITEMS)
    return sold.groupBy(*ITEMS).agg(F.count("*").alias("product_rows"))


def category_counts(transactions: DataFrame, offers: DataFrame, dedupe: bool = True) -> DataFrame:
    """Rows per offered category, by default each distinct whole row once."""
    sold = rows_on_offer(transactions, offers, "category")
    if dedupe:
        sold = sold.distinct()
    return sold.groupBy("category").agg(F.count("*").alias("category_rows"))


def market_share(transactions: DataFrame, offers: DataFrame, dedupe: bool = True) -> DataFrame:
    """Share of each offered product in the sales of its category.

    As originally defined: all rows over distinct rows, so copies in the log
    can push it above one.
    """
    both = product_counts(transactions, offers).join(
        category_counts(transactions, offers, dedupe), "category"
    )
    share = F.col("product_rows") / F.col("category_rows")
    return both.select(*ITEMS, share.alias("market_share"))


def customer_share(transactions: DataFrame, offers: DataFrame, on: tuple[str, ...]) -> DataFrame:
    """Share of all shoppers who bought each offered product or category."""
    sold = rows_on_offer(transactions, offers, *on).select(*on, "id")
    buyers = sold.groupBy(*on).agg(F.countDistinct("id").alias("_buyers"))
    users = user_count(transactions).scalar()
    return buyers.select(*on, (F.col("_buyers") / users).alias("customer_share"))


def offer_universe_spend(spine: DataFrame, transactions: DataFrame, offers: DataFrame) -> DataFrame:
    """Spend in offered categories and companies for every shopper in the spine.

    Counts each distinct whole row once; a shopper without any gets zero.
    """
    ids = stage(spine.select("id"), "ids")  # measured, joined, and filled up
    mine = join_lookup(transactions, ids, "id", "left_semi").select(*transactions.columns)
    spend = offer_universe_rows(mine, offers).groupBy("id").agg(
        F.sum(cents("purchaseamount")).alias("_c")
    )
    return ids.join(spend, "id", "left").select("id", money("_c").alias("universe_spend"))


def whole_row_counts(
    transactions: DataFrame,
    offers: DataFrame,
    offer_dates: DataFrame | None = None,
    small_dates: bool | None = None,
) -> DataFrame:
    """The copies of each whole row in an offered category or from an offered company.

    Tables of this kind can be added up.  ``offer_dates`` (id, offerdate) adds the
    shopper's offer date.
    """
    items = ("category", "company")
    flagged = flag_offered(transactions, offers, items, only=True)
    keys = [*transactions.columns, "category_offered"]
    if offer_dates is not None:
        # Joined to the log itself, so that hot shoppers are counted on a plain column.
        dates = offer_dates.select("id", "offerdate")
        flagged = join_lookup(flagged, dates, "id", "left", small_dates, count_on=transactions)
        keys.append("offerdate")
    return flagged.groupBy(*keys).agg(F.count("*").alias("copies"))


def rollup_of(whole: DataFrame, dedupe: bool = True) -> DataFrame:
    """``universe_rollup`` from the copies of whole rows; with offer dates if they have them."""
    amount = zero_if_null(cents("purchaseamount"))
    once = F.lit(1) if dedupe else F.col("copies")
    if "offerdate" in whole.columns:
        amount = F.when(day_diff("offerdate", "date") > 0, amount).otherwise(F.lit(0))
    return whole.groupBy("id", *ITEMS, "category_offered").agg(
        F.sum("copies").alias("rows"),
        F.sum(once).cast("bigint").alias("distinct_rows"),
        F.sum(amount * once).alias("cents"),
    )


def universe_rollup(
    transactions: DataFrame,
    offers: DataFrame,
    dedupe: bool = True,
    offer_dates: DataFrame | None = None,
    small_dates: bool | None = None,
) -> DataFrame:
    """The log's offered part in one pass, per shopper and product.

    ``rows`` counts all rows, ``distinct_rows`` and ``cents`` each distinct
    whole row once.  Counting the copies of each whole row gives both from one
    shuffle of the wide rows.  With ``offer_dates`` (id, offerdate) only
    purchases before the shopper's offer date add to ``cents``.
    """
    return rollup_of(whole_row_counts(transactions, offers, offer_dates, small_dates), dedupe)


def offer_market(rollup: DataFrame, offers: DataFrame, users: int) -> DataFrame:
    """Market share and customer shares, of ``users``, of every offered product ever sold.

    No larger than the offers.
    """
    on_offer = rollup.where("category_offered")
    category = on_offer.groupBy("category").agg(
        F.sum("distinct_rows").alias("_category_rows"),
        F.countDistinct("id").alias("_category_buyers"),
    )
    product = rows_on_offer(on_offer, offers, *ITEMS).groupBy(*ITEMS).agg(
        F.sum("rows").alias("_rows"), F.count("id").alias("_buyers")
    )
    return product.join(category, "category").select(
        *ITEMS,
        (F.col("_rows") / F.col("_category_rows")).alias("market_share"),
        (F.col("_buyers") / users).alias("product_customer_share"),
        (F.col("_category_buyers") / users).alias("category_customer_share"),
    )


def universe_spend_from(
    rollup: DataFrame, spine: DataFrame, small: bool | None = None
) -> DataFrame:
    mine = join_lookup(rollup, spine.select("id"), "id", "left_semi", small)
    spend = mine.groupBy("id").agg(F.sum("cents").alias("_c"))
    return spend.select("id", money("_c").alias("universe_spend"))
