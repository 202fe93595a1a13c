"""The shopper feature tables X1..X71 and X1..X87."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import spend_or_share, zero_if_null
from tillroll.operators import lookback as lb
from tillroll.operators import market as mk
from tillroll.operators.joins import fits_broadcast, join_lookup
from tillroll.operators.spine import (
    category_dept_map,
    history_with_offers,
    require_unique_ids,
    with_dept,
)
from tillroll.session import stage
from tillroll.sources.schemas import ITEMS

# The feature numbers of the single columns.
FEATURE_NAMES = {
    "ever_category": "X1",
    "ever_company": "X2",
    "ever_brand": "X3",
    "ever_all": "X4",
    "ever_company_brand": "X5",
    "ever_category_brand": "X6",
    "total_spend": "X7",
    "offer_value": "X8",
    "universe_spend": "X72",
    "recent_spend": "X73",
    "own_recent_amount": "X74",
    "own_recent_quantity": "X75",
    "own_amount": "X76",
    "own_quantity": "X77",
    "dept_recent_amount": "X78",
    "dept_recent_quantity": "X79",
    "recent_visits": "X80",
    "days_since_first": "X81",
    "days_since_last": "X82",
    "returned": "X83",
    "market_share": "X84",
    "spend_or_share": "X85",
    "product_customer_share": "X86",
    "category_customer_share": "X87",
}
# The first feature number of each block of the look-back grid.
GRID_STARTS = {"n": 9, "amount": 30, "quantity": 51}

OFFER_COLUMNS = ("offerdate", "category", "company", "brand", "dept", "quantity")


def grid_names(
    items: Sequence[str] = ITEMS, day_limits: Sequence[int | None] = lb.DAY_LIMITS
) -> dict[str, str]:
    """X9..X71 for the standard grid; other grids keep their plain names."""
    standard = tuple(items) == ITEMS and tuple(day_limits) == lb.DAY_LIMITS
    names = {}
    for measure, start in GRID_STARTS.items():
        plain = [lb.grid_name(measure, item, limit) for item in items for limit in day_limits]
        names |= {n: f"X{start + i}" if standard else n for i, n in enumerate(plain)}
    return names


def _grid(items: Sequence[str], day_limits: Sequence[int | None]) -> dict[str, str]:
    grid = {}
    for measure in GRID_STARTS:
        grid |= lb.grid_features(measure, items, day_limits)
    return grid


def interactions() -> dict[str, Column]:
    cat, com, brand = F.col("ever_category"), F.col("ever_company"), F.col("ever_brand")
    return {
        "ever_all": cat * com * brand,
        "ever_company_brand": com * brand,
        "ever_category_brand": cat * brand,
    }


def offer_value() -> Column:
    return F.col("offervalue").cast("double")


def build_spine(
    history: DataFrame, offers: DataFrame, dept_map: DataFrame | None = None, strict: bool = True
) -> DataFrame:
    """The checked spine as a table of its own, since every feature joins it."""
    spine = history_with_offers(history, offers)
    if dept_map is not None:
        spine = with_dept(spine, dept_map, strict)
    spine = stage(spine, "spine")
    require_unique_ids(spine)
    return spine


def finish(
    wide: DataFrame, spine: DataFrame, names: dict[str, str], keep_offer_columns: bool
) -> DataFrame:
    kept = [
        c
        for c in spine.columns
        if c != "offervalue" and (keep_offer_columns or c not in OFFER_COLUMNS)
    ]
    return wide.selectExpr(*kept, *[f"{plain} as {x}" for plain, x in names.items()])


def in_order(*blocks: dict[str, str]) -> dict[str, str]:
    """All columns, numbered features in the order of their numbers."""
    names = {plain: x for block in blocks for plain, x in block.items()}
    numbered = {p: x for p, x in names.items() if x != p}
    plain = {p: x for p, x in names.items() if x == p}
    return dict(sorted(numbered.items(), key=lambda kv: int(kv[1][1:]))) | plain


def _beside_spine(features: DataFrame, spine: DataFrame, small: bool) -> DataFrame:
    """Both sides hold a shopper once, so no key can be hot here."""
    side = spine.withColumn("offer_value", offer_value()).drop("offervalue")
    wide = features.join(F.broadcast(side) if small else side, "id")
    return wide.withColumns(interactions())


def lookback_table(
    transactions: DataFrame,
    spine: DataFrame,
    *,
    items: Sequence[str] = ITEMS,
    day_limits: Sequence[int | None] = lb.DAY_LIMITS,
    recent_days: int = lb.RECENT_DAYS,
    before_offer: bool = False,
    small_spine: bool | None = None,
) -> DataFrame:
    """Everything about a shopper's own purchases, from one pass over the log.

    Columns nobody reads are pruned, down to the log's.  The features on the
    dept are left out for a spine without one.
    """
    events = lb.history_events(transactions, spine, before_offer, small_spine)
    measures = lb.event_measures(events, day_limits, recent_days)
    features = lookback_features(items, day_limits, recent_days)
    if "dept" in spine.columns:
        features |= lb.dept_features(recent_days)
    return lb.per_shopper(lb.roll_up(measures), features)


def lookback_features(
    items: Sequence[str] = ITEMS,
    day_limits: Sequence[int | None] = lb.DAY_LIMITS,
    recent_days: int = lb.RECENT_DAYS,
) -> dict[str, str]:
    """All features on rolled-up measures but those on the dept."""
    return (
        lb.ever_features()
        | _grid(items, day_limits)
        | lb.total_spend_feature()
        | lb.recent_spend_feature(recent_days)
        | lb.own_recent_features(recent_days)
        | lb.own_features()
        | lb.visit_feature(recent_days)
        | lb.recency_features()
        | lb.returned_feature()
    )


def base_from_lookback(
    looked: DataFrame,
    spine: DataFrame,
    small_spine: bool,
    names: dict[str, str],
    keep_offer_columns: bool = False,
) -> DataFrame:
    single = {p: x for p, x in FEATURE_NAMES.items() if int(x[1:]) <= 8}
    wide = _beside_spine(looked, spine, small_spine)
    return finish(wide, spine, in_order(single, names), keep_offer_columns)


def matrix_from_lookback(
    looked: DataFrame,
    spine: DataFrame,
    small_spine: bool,
    names: dict[str, str],
    transactions: DataFrame,
    offers: DataFrame,
    before_offer: bool = False,
    dedupe: bool = True,
    keep_offer_columns: bool = False,
) -> DataFrame:
    dates = spine if before_offer else None
    rollup = mk.universe_rollup(transactions, offers, dedupe, dates, small_spine)
    users = mk.user_count(transactions).scalar()
    return matrix_from_rollup(
        looked, spine, small_spine, names, rollup, offers, users, keep_offer_columns
    )


def matrix_from_rollup(
    looked: DataFrame,
    spine: DataFrame,
    small_spine: bool,
    names: dict[str, str],
    rollup: DataFrame,
    offers: DataFrame,
    users: int,
    keep_offer_columns: bool = False,
) -> DataFrame:
    rollup = stage(rollup, "universe")
    market = stage(mk.offer_market(rollup, offers, users), "market")
    spend = mk.universe_spend_from(rollup, spine, small_spine)

    # All else goes to the spine first, so that the wide rows meet one join.
    beside = join_lookup(spine, market, ITEMS)  # one row per offer at most
    beside = beside.join(spend, "id", "left")
    beside = beside.withColumn("universe_spend", zero_if_null("universe_spend").cast("double"))
    beside = stage(beside, "beside")
    wide = _beside_spine(looked, beside, fits_broadcast(beside))
    wide = wide.withColumn("spend_or_share", spend_or_share("own_amount", "market_share"))
    return finish(wide, spine, in_order(FEATURE_NAMES, names), keep_offer_columns)


def base_features(
    transactions: DataFrame,
    offers: DataFrame,
    history: DataFrame,
    *,
    items: Sequence[str] = ITEMS,
    day_limits: Sequence[int | None] = lb.DAY_LIMITS,
    before_offer: bool = False,
    keep_offer_columns: bool = False,
) -> DataFrame:
    """X1..X71, one row per shopper of the history with any purchase."""
    spine = build_spine(history, offers)
    small = fits_broadcast(spine)
    looked = lookback_table(
        transactions,
        spine,
        items=items,
        day_limits=day_limits,
        before_offer=before_offer,
        small_spine=small,
    )
    return base_from_lookback(
        looked, spine, small, grid_names(items, day_limits), keep_offer_columns
    )


def feature_matrix(
    transactions: DataFrame,
    offers: DataFrame,
    history: DataFrame,
    dept_map: DataFrame | None = None,
    *,
    items: Sequence[str] = ITEMS,
    day_limits: Sequence[int | None] = lb.DAY_LIMITS,
    recent_days: int = lb.RECENT_DAYS,
    before_offer: bool = False,
    dedupe: bool = True,
    strict_dept: bool = True,
    keep_offer_columns: bool = False,
) -> DataFrame:
    """X1..X87, one row per shopper whose offered product was ever sold.

    Reads the log three times: the purchases of the history's shoppers, the
    rows on offer of all shoppers, and the shopper ids; a fourth time for
    the dept map unless ``dept_map``, a table, is given.  The history may
    lack the outcome columns.
    """
    if dept_map is None:
        dept_map = stage(category_dept_map(transactions, offers), "dept-map")
    spine = build_spine(history, offers, dept_map, strict_dept)
    small = fits_broadcast(spine)
    looked = lookback_table(
        transactions,
        spine,
        items=items,
        day_limits=day_limits,
        recent_days=recent_days,
        before_offer=before_offer,
        small_spine=small,
    )
    return matrix_from_lookback(
        looked,
        spine,
        small,
        grid_names(items, day_limits),
        transactions,
        offers,
        before_offer,
        dedupe,
        keep_offer_columns,
    )


def sorted_for_export(features: DataFrame) -> DataFrame:
    """By shopper id; range partitioned, so each file holds a run of ids."""
    return features.orderBy("id")


def dropped_shoppers(
    transactions: DataFrame,
    offers: DataFrame,
    history: DataFrame,
    dept_map: DataFrame | None = None,
    *,
    before_offer: bool = False,
) -> DataFrame:
    """Shoppers of the history that the matrix leaves out, with the reason.

    Takes the options of the matrix.  With ``dept_map``, a table, shoppers whose
    category is not in it are listed, as for a matrix with ``strict_dept=False``.
    The log is read once for the shoppers and once for the products.
    """
    spine = stage(history_with_offers(history, offers), "spine")
    events = lb.history_events(transactions, spine)
    # No keys or amounts are read: one row per shopper with purchases.
    before = F.coalesce(F.max(F.col("day_diff") > 0), F.lit(False))
    bought = stage(events.groupBy("id").agg(before.alias("_before")), "bought")
    sold = stage(mk.product_counts(transactions, offers).select(*ITEMS), "sold")
    reasons = join_lookup(spine, bought, "id", "left")
    reasons = join_lookup(reasons, sold.withColumn("_sold", F.lit(True)), ITEMS, "left")
    reason = F.when(F.col("_before").isNull(), "no purchases")
    if before_offer:
        reason = reason.when(~F.col("_before"), "no purchases before the offer")
    if dept_map is not None:
        known = dept_map.select("category", F.lit(True).alias("_known"))
        reasons = join_lookup(reasons, known, "category", "left")
        reason = reason.when(F.col("_known").isNull(), "no dept")
    reason = reason.when(F.col("_sold").isNull(), "product never sold")
    named = reasons.select("id", reason.alias("reason")).where("reason is not null")
    unknown = join_lookup(history, offers.select("offer"), "offer", "left_anti")
    return named.unionByName(unknown.select("id", F.lit("unknown offer").alias("reason")))
