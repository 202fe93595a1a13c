"""The feature matrix for shoppers with several offers, one row per shopper and offer.

Joining a shopper's purchases with every offer would multiply them.  Instead the
purchases become one series of days for each shopper and each thing an offer
looks at (a category, company, brand, product or dept, all purchases, those on any
offer), with running sums.  An offer looks its dates up in them, as of the day:
what was bought in a look-back window is the running sum at its end less the
one at its start.  A purchase goes to the series its shopper's offers look at and no
others; rolled up by day they are gathered by shopper, with a short row for each
thing an offer asks about.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.functions import cents, spend_or_share, zero_if_null
from tillroll.operators import lookback as lb
from tillroll.operators import market as mk
from tillroll.operators.joins import fits_broadcast, join_lookup
from tillroll.operators.spine import category_dept_map, history_with_offers, with_dept
from tillroll.plans import features as ft
from tillroll.session import stage
from tillroll.sources.schemas import ITEMS

END, RECENT = "end", "recent"
NO_DATE, AFTER_ALL = "0001-01-01", "9999-12-31"
MEASURES = ("n", "cents", "quantity", "days")
SERIES = ["id", "kind", "key"]


def require_unique_offers(spine: DataFrame) -> None:
    repeated = spine.groupBy("id", "offer").agg(F.count("*").alias("n")).where("n > 1")
    names = repeated.select("id", "offer").limit(10).collect()
    if names:
        raise ValueError(f"rows with one shopper and offer, among them {[tuple(r) for r in names]}")


def _key(*columns: str) -> Column:
    """The key of a thing, null if a part is missing; no two have the same."""
    parts = [F.col(c).cast("string") for c in columns]
    marked = [F.concat(F.octet_length(c).cast("string"), F.lit(":"), c) for c in parts[:-1]]
    return F.concat(*marked, *parts[-1:]) if parts else F.lit("")


def _keys() -> dict[str, Column]:
    """What a purchase, or an offer, is of, by kind."""
    return {c: _key(c) for c in (*ITEMS, "dept")} | {"own": _key(*ITEMS)}


def _thing(kind: str, key: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"))


def _looked_at() -> Column:
    """The things a purchase is of that some offer of its shopper looks at."""
    things = [
        F.when(F.array_contains(f"offered_{kind}", key), _thing(kind, key))
        for kind, key in _keys().items()
    ]
    return F.array_compact(F.array(_thing("all", _key()), *things))


def whole_rows(transactions: DataFrame, offers: DataFrame) -> DataFrame:
    """The copies of each whole row on offer, with the columns that sums are made of."""
    whole = mk.whole_row_counts(transactions, offers)
    return whole.select("id", *ITEMS, "category_offered", "date", "purchaseamount", "copies")


def day_series(
    transactions: DataFrame,
    spine: DataFrame,
    offers: DataFrame,
    before_offer: bool = False,
    dedupe: bool = True,
    whole: DataFrame | None = None,
) -> DataFrame:
    """What the spine's shoppers bought, per day, of each thing that their offers look at.

    Purchases without a date come before all days; with ``before_offer`` they
    are left out, as no offer is known to be later.  ``whole`` has the
    ``whole_rows`` as a table.
    """
    dated = "date is not null" if before_offer else "true"
    no_date = F.lit(NO_DATE).cast("date")
    wanted = spine.select("id", *[key.alias(f"offered_{kind}") for kind, key in _keys().items()])
    small = fits_broadcast(wanted)  # before the keys are in arrays, which are not measured
    sets = [F.collect_set(c).alias(c) for c in wanted.columns[1:]]
    offered = stage(wanted.groupBy("id").agg(*sets), "offered")
    log = transactions.where(dated).select(
        "id", *ITEMS, "dept", "date", "purchasequantity", "purchaseamount"
    )
    mine = join_lookup(log, offered, "id", small=small, filtered=True)
    sold = mine.select(
        "id",
        F.explode(_looked_at()).alias("thing"),
        F.coalesce("date", no_date).alias("date"),
        zero_if_null(cents("purchaseamount")).alias("cents"),
        zero_if_null(F.col("purchasequantity").cast("bigint")).alias("quantity"),
        cents("purchaseamount").alias("lowest"),
    )
    series = sold.select("id", "thing.kind", "thing.key", *sold.columns[2:])
    series = series.groupBy(*SERIES, "date").agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(c) for c in ("cents", "quantity")],
        F.min("lowest").alias("lowest"),
    )

    if whole is None:
        whole = whole_rows(transactions, offers)
    whole = join_lookup(whole.where(dated), offered.select("id"), "id", "left_semi")
    once = F.lit(1) if dedupe else F.col("copies")
    spent = zero_if_null(cents("purchaseamount")) * once
    universe = whole.groupBy("id", F.coalesce("date", no_date).alias("date")).agg(
        F.sum(spent).cast("bigint").alias("cents")
    )
    universe = universe.select(
        "id",
        F.lit("universe").alias("kind"),
        _key().alias("key"),
        "date",
        F.lit(0).cast("bigint").alias("n"),
        "cents",
        F.lit(0).cast("bigint").alias("quantity"),
        F.lit(None).cast("bigint").alias("lowest"),
    )
    return series.unionByName(universe).withColumn(
        "days", F.when(F.col("date") > no_date, 1).otherwise(0).cast("bigint")
    )


def _cuts(
    day_limits: Sequence[int | None], recent_days: int
) -> dict[str, dict[str, int | None]]:
    """The names of the days looked up, by kind, and how long before the offer they are."""
    grid = {str(n): n for n in day_limits if n is not None}
    recent = {RECENT: recent_days}
    found = {item: dict(grid) for item in ITEMS}
    found |= {"all": recent, "own": recent, "dept": recent, "universe": {}}
    return {kind: cuts | {END: None} for kind, cuts in found.items()}


def _places(cuts: dict[str, dict[str, int | None]]) -> dict[tuple[str, str], int]:
    """A number for each kind and name of a day."""
    return {pair: i for i, pair in enumerate((k, n) for k, named in cuts.items() for n in named)}


def looked_up(
    series: DataFrame,
    spine: DataFrame,
    cuts: dict[str, dict[str, int | None]],
    before_offer: bool = False,
) -> DataFrame:
    """The running sums just before each day that the offers ask for.

    Look-ups and days are sorted together per series, a look-up before the day's
    own purchases, so one window pass answers all of them.  A shopper's rows, short
    ones by day, are gathered once; the days an offer asks for are made after that.
    """
    keys = {"all": _key(), "universe": _key()} | _keys()
    things = F.array(*[_thing(kind, key) for kind, key in keys.items()])
    offer_type = spine.schema["offer"].dataType
    lookups = spine.select(
        "id", "offer", F.to_date("offerdate").alias("date"), F.explode(things).alias("thing")
    )
    lookups = lookups.select("id", "thing.kind", "thing.key", "date", "offer", F.lit(0).alias("_mark"))
    lookups = lookups.withColumns({c: F.lit(0).cast("bigint") for c in MEASURES})
    lookups = lookups.withColumn("lowest", F.lit(None).cast("bigint"))
    days = series.withColumns({"offer": F.lit(None).cast(offer_type), "_mark": F.lit(1)})
    both = days.unionByName(lookups).repartition("id")

    end = F.col("date") if before_offer else F.lit(AFTER_ALL).cast("date")

    def cut(place: int | None, day: Column) -> Column:
        return F.struct(F.lit(place).cast("int").alias("cut"), day.alias("date"))

    places = _places(cuts)
    asked = F.when(F.col("_mark") == 1, F.array(cut(None, F.col("date"))))
    for kind, named in cuts.items():
        at = [
            cut(places[kind, n], end if d is None else F.date_sub("date", d))
            for n, d in named.items()
        ]
        asked = asked.when(F.col("kind") == kind, F.array(*at))
    kept = [*SERIES, "offer", "_mark", *MEASURES, "lowest"]
    both = both.select(*kept, F.explode(asked).alias("a")).select(*kept, "a.cut", "a.date")

    so_far = Window.partitionBy(*SERIES).orderBy("date", "_mark")
    so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bought_on = F.when((F.col("_mark") == 1) & (F.col("days") > 0), F.col("date"))
    found = both.select(
        "id",
        "offer",
        "cut",
        "_mark",
        *[F.sum(c).over(so_far).alias(c) for c in MEASURES],
        F.min("lowest").over(so_far).alias("lowest"),
        F.min(bought_on).over(so_far).alias("first"),
        F.max(bought_on).over(so_far).alias("last"),
    )
    return found.where("_mark = 0")


def _features(
    day_limits: Sequence[int | None], cuts: dict[str, dict[str, int | None]]
) -> dict[str, Column]:
    """Each feature from the sums that were looked up."""

    places = _places(cuts)

    def at(kind: str, cut: str, column: str) -> Column:
        return F.max(F.when(F.col("cut") == places[kind, cut], F.col(column)))

    def since(kind: str, cut: str | None, column: str) -> Column:
        # A series without any purchase, or a key that is missing, has no sums.
        whole = zero_if_null(at(kind, END, column))
        return whole if cut is None else whole - zero_if_null(at(kind, cut, column))

    def money(kind: str, cut: str | None) -> Column:
        return since(kind, cut, "cents") / F.lit(100.0)

    found = {f"ever_{item}": F.when(since(item, None, "n") > 0, 1).otherwise(0) for item in ITEMS}
    for item in ITEMS:
        for limit in day_limits:
            cut = None if limit is None else str(limit)
            found[lb.grid_name("n", item, limit)] = since(item, cut, "n")
            found[lb.grid_name("amount", item, limit)] = money(item, cut)
            found[lb.grid_name("quantity", item, limit)] = since(item, cut, "quantity")
    lowest = at("own", END, "lowest")
    returned = (since("own", None, "n") > 0) & ~F.coalesce(lowest >= 0, F.lit(False))
    return found | {
        "total_spend": money("all", None),
        "universe_spend": money("universe", None),
        "recent_spend": money("all", RECENT),
        "own_recent_amount": money("own", RECENT),
        "own_recent_quantity": since("own", RECENT, "quantity"),
        "own_amount": money("own", None),
        "own_quantity": since("own", None, "quantity"),
        "dept_recent_amount": money("dept", RECENT),
        "dept_recent_quantity": since("dept", RECENT, "quantity"),
        "recent_visits": since("all", RECENT, "days"),
        "_first": at("all", END, "first"),
        "_last": at("all", END, "last"),
        "returned": F.when(returned, 1).otherwise(0),
        "_n": since("all", None, "n"),
    }


def feature_matrix_by_offer(
    transactions: DataFrame,
    offers: DataFrame,
    history: DataFrame,
    dept_map: DataFrame | None = None,
    *,
    day_limits: Sequence[int | None] = lb.DAY_LIMITS,
    recent_days: int = lb.RECENT_DAYS,
    before_offer: bool = False,
    dedupe: bool = True,
    strict_dept: bool = True,
    keep_offer_columns: bool = False,
) -> DataFrame:
    """X1..X87, one row per shopper and offer; the history may name a shopper often.

    With one offer each these are the rows of ``features.feature_matrix``.  A
    shopper and offer may be there once only.
    """
    if dept_map is None:
        dept_map = stage(category_dept_map(transactions, offers), "dept-map")
    spine = with_dept(history_with_offers(history, offers), dept_map, strict_dept)
    spine = stage(spine, "spine")
    require_unique_offers(spine)

    cuts = _cuts(day_limits, recent_days)
    whole = stage(whole_rows(transactions, offers), "whole-rows")
    series = day_series(transactions, spine, offers, before_offer, dedupe, whole)
    found = looked_up(series, spine, cuts, before_offer)
    sums = found.groupBy("id", "offer").agg(
        *[c.alias(n) for n, c in _features(day_limits, cuts).items()]
    )
    sums = stage(sums.where("_n > 0"), "sums")

    # The market is that of the offered categories.
    rollup = stage(mk.rollup_of(whole.where("category_offered"), dedupe), "universe")
    users = mk.user_count(transactions).scalar()
    market = stage(mk.offer_market(rollup, offers, users), "market")
    beside = join_lookup(spine, market, ITEMS).withColumn("offer_value", ft.offer_value())
    wide = sums.join(beside, ["id", "offer"]).withColumns(
        {
            "days_since_first": F.datediff("offerdate", "_first"),
            "days_since_last": F.datediff("offerdate", "_last"),
            "spend_or_share": spend_or_share("own_amount", "market_share"),
        }
    )
    wide = wide.withColumns(ft.interactions())
    names = ft.grid_names(ITEMS, day_limits)
    return ft.finish(wide, spine, ft.in_order(ft.FEATURE_NAMES, names), keep_offer_columns)
