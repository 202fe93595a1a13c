"""Single operators on the hand-made tables."""

import numpy as np
import pytest
from tables import HISTORY, OFFER_DAY, TRANSACTIONS, frames, random_tables, rows_of, sale

from tillroll.sources.sample import sample_transactions  # noqa: I001
from tillroll.functions import day_diff, money, recode_label, spend_or_share
from tillroll.operators import keysets as ks
from tillroll.operators import lookback as lb
from tillroll.operators import market as mk
from tillroll.operators import reduction as rd
from tillroll.operators import spine as sp
from tillroll.plans.features import dropped_shoppers, feature_matrix
from tillroll.session import stage
from tillroll.sources.schemas import ITEMS


def one(spark, column, **values):
    pairs = ", ".join(f"{sql} as {name}" for name, sql in values.items())
    return spark.sql(f"select {pairs}").select(column).first()[0]


@pytest.mark.parametrize(
    "value, expected", [("'t'", "1"), ("'f'", "0"), ("'x'", "x"), ("cast(null as string)", None)]
)
def test_recode_label(spark, value, expected):
    assert one(spark, recode_label("v"), v=value) == expected


def test_day_diff_is_negative_after_the_offer(spark):
    dates = {"o": "date'2013-05-01'", "d": "date'2013-05-03'"}
    assert one(spark, day_diff("o", "d"), **dates) == -2


def test_money_and_spend_or_share(spark):
    assert one(spark, money("c"), c="1230L") == 12.3
    assert one(spark, money("c"), c="cast(null as bigint)") == 0
    assert one(spark, spend_or_share("a", "b"), a="0.5D", b="0.5D") == 0.5
    assert one(spark, spend_or_share("a", "b"), a="0.0D", b="0.25D") == -25


def test_reduction_keeps_rows_and_copies(spark):
    transactions, offers, _ = frames(spark)
    kept = rd.reduce_transactions(transactions, offers)
    # only the sale of 300/5/50 is on no offer
    assert kept.count() == transactions.count() - 1
    assert kept.columns == transactions.columns
    assert rd.reduction_stats(transactions, offers).first().asDict() == {
        "searched": 14,
        "kept": 13,
    }
    assert tuple(rd.offer_key_counts(offers).first()) == (2, 3, 3)


def test_reduction_by_shuffle(spark, large_lookups):
    transactions, offers, _ = frames(spark, *random_tables(8, hot=0.5))
    offers = offers.limit(2)
    keys = {c: {r[c] for r in offers.collect()} for c in ITEMS}
    expected = transactions.where(
        " or ".join(f"{c} in ({','.join(map(str, keys[c]))})" for c in ITEMS)
    )
    assert rows_of(rd.reduce_transactions(transactions, offers)) == rows_of(expected)


def test_dept_map_takes_the_latest(spark):
    log = [
        sale(1, 20, 100, 7, 70, 1, "1.00", dept=1),
        sale(1, 10, 100, 7, 70, 1, "1.00", dept=3),
        sale(2, 10, 100, 7, 70, 1, "1.00", dept=2),
        sale(2, 30, 200, 7, 70, 1, "1.00", dept=5),
    ]
    transactions = frames(spark, log)[0]
    assert rows_of(sp.category_dept_map(transactions)) == [(100, 3), (200, 5)]
    assert rows_of(sp.category_dept_conflicts(transactions)) == [(100, 3)]


def test_spine(spark):
    _, offers, history = frames(spark)
    spine = sp.history_with_offers(history, offers)
    assert {r["id"]: r["category"] for r in spine.collect()} == {
        10: 100, 11: 100, 12: 200, 13: 100, 14: 100,
    }
    assert "repeater" not in spine.columns
    repeated = frames(spark, history=HISTORY + [(10, 4, 3, 34, 0, "f", OFFER_DAY)])[2]
    assert rows_of(sp.duplicate_ids(repeated)) == [(10, 2)]


def test_sets_and_frequencies(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (3,)], "offer int")
    right = spark.createDataFrame([(3,), (4,), (3,)], "offer int")
    assert rows_of(ks.shared_keys(left, right, "offer")) == [(3,)]
    assert rows_of(ks.all_keys(left, right, "offer")) == [(1,), (2,), (3,), (4,)]
    assert rows_of(ks.only_left_keys(left, right, "offer")) == [(1,), (2,)]
    both = ks.compare_frequency(left, right, "offer", ("a", "b"))
    assert rows_of(both) == [(0, 1, 4), (1, 0, 2), (1, 2, 3), (2, 0, 1)]


def test_attach_fills_only_new_columns(spark):
    rows = spark.createDataFrame([(1, None), (2, 5)], "id int, old int")
    feature = spark.createDataFrame([(2, 7)], "id int, x int")
    assert rows_of(ks.attach(rows, feature, "id", True)) == [(1, None, 0), (2, 5, 7)]
    assert rows_of(ks.attach(rows, feature, "id", False)) == [(2, 5, 7)]


def test_events(spark):
    transactions, offers, history = frames(spark)
    spine = sp.history_with_offers(history, offers)
    events = lb.history_events(transactions, spine)
    assert events.count() == 13  # all but shopper 99
    assert lb.history_events(transactions, spine, before_offer=True).count() == 11
    assert lb.matched_events(events, "category").count() == 9
    assert lb.matched_events(events, *ITEMS).groupBy("id").count().count() == 2


@pytest.mark.parametrize("seed", [11, 12])
def test_rolling_up_first_changes_nothing(spark, seed):
    transactions, offers, history = frames(spark, *random_tables(seed))
    spine = sp.history_with_offers(history, offers)
    measures = lb.event_measures(lb.history_events(transactions, spine))
    features = (
        lb.ever_features()
        | lb.grid_features("amount")
        | lb.own_features()
        | lb.recency_features()
        | lb.returned_feature()
    )
    direct = lb.per_shopper(measures, features)
    assert rows_of(direct) == rows_of(lb.per_shopper(lb.roll_up(measures), features))


@pytest.mark.parametrize("dedupe", [True, False])
def test_market_in_one_pass_equals_the_single_operators(spark, dedupe):
    transactions, offers, history = frames(spark, *random_tables(13))
    rollup = mk.universe_rollup(transactions, offers, dedupe)
    market = mk.offer_market(rollup, offers, mk.user_count(transactions).scalar())
    share = mk.market_share(transactions, offers, dedupe)
    product = mk.customer_share(transactions, offers, ITEMS)
    category = mk.customer_share(transactions, offers, ("category",))
    assert rows_of(market.select(*ITEMS, "market_share")) == rows_of(share)
    assert rows_of(
        market.select(*ITEMS, market["product_customer_share"].alias("customer_share"))
    ) == rows_of(product)
    shares = {r["category"]: r["customer_share"] for r in category.collect()}
    for row in market.collect():
        assert row["category_customer_share"] == shares[row["category"]]
    if dedupe:
        spine = sp.history_with_offers(history, offers)
        spend = mk.offer_universe_spend(spine, transactions, offers).where("universe_spend <> 0")
        rolled = mk.universe_spend_from(rollup, spine).where("universe_spend <> 0")
        assert rows_of(rolled) == rows_of(spend)


def test_totals_cover_shoppers_outside_the_history(spark):
    transactions, _, _ = frames(spark)
    totals = {r["id"]: r["total_spend"] for r in mk.shopper_totals(transactions).collect()}
    assert totals[99] == 1.0 and len(totals) == 5
    assert np.isclose(totals[10], 24.25)
    assert mk.user_count(transactions).first()[0] == 5


@pytest.mark.parametrize("before_offer", [False, True])
def test_drop_reasons_complete_the_matrix(spark, before_offer):
    log = TRANSACTIONS + [sale(16, -3, 100, 7, 70, 1, "1.00")]  # only after the offer
    late = HISTORY + [(16, 4, 1, 34, 0, "f", OFFER_DAY)]
    transactions, offers, history = frames(spark, log, history=late)
    matrix = feature_matrix(transactions, offers, history, before_offer=before_offer)
    dropped = dropped_shoppers(transactions, offers, history, before_offer=before_offer)
    reasons = {r["id"]: r["reason"] for r in dropped.collect()}
    kept = {r["id"] for r in matrix.select("id").collect()}
    assert kept | set(reasons) == {row[0] for row in late} and not kept & set(reasons)
    expected = {13: "no purchases", 14: "product never sold", 15: "unknown offer"}
    assert reasons == expected | ({16: "no purchases before the offer"} if before_offer else {})


def test_shoppers_without_a_dept_are_listed(spark):
    transactions, offers, history = frames(spark)
    dept_map = spark.createDataFrame([(100, 1)], "category int, dept int")
    matrix = feature_matrix(transactions, offers, history, dept_map, strict_dept=False)
    dropped = dropped_shoppers(transactions, offers, history, dept_map)
    reasons = {r["id"]: r["reason"] for r in dropped.collect()}
    assert reasons[12] == "no dept"
    kept = {r["id"] for r in matrix.select("id").collect()}
    assert kept | set(reasons) == {row[0] for row in HISTORY} and not kept & set(reasons)


def test_many_offers_of_few_categories_do_not_shuffle_the_log(spark):
    transactions = stage(frames(spark)[0], "log")
    offers = stage(
        spark.range(20_000).selectExpr(
            "id as offer", "cast(id % 3 as int) * 100 as category", "1 as quantity",
            "id % 5 + 7 as company", "cast(1 as decimal(6,2)) as offervalue",
            "cast(id % 4 as int) * 10 as brand",
        ),
        "many",
    )
    spark.conf.set("spark.tillroll.broadcastBytes", "100000")
    try:
        kept = rd.reduce_transactions(transactions, offers)
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.tillroll.broadcastBytes")
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan


def test_missing_keys_and_numbers(spark):
    log = [
        sale(1, 10, 100, 7, 70, 1, "5.00"),
        sale(1, 10, 100, None, 70, 2, "6.00"),
        sale(1, 10, 100, 7, None, 2, "7.00", dept=None),
    ]
    transactions, offers, history = frames(spark, log, history=[(1, 4, 1, 34, 0, "f", OFFER_DAY)])
    row = feature_matrix(transactions, offers, history).first()
    assert [row[f"X{i}"] for i in (7, 9, 16, 23, 76)] == [18.0, 3, 2, 2, 5.0]
    assert not [c for c, v in row.asDict().items() if v is None]


def test_the_lines_are_shuffled_by_order_and_part_only(spark, tmp_path):
    """They were shuffled by customer and supplier too, and each made its category."""
    tables = {
        "customer": [(1, 5), (2, 6)],
        "orders": [(10, 1), (20, 2), (50, 2), (60, None)],
        "supplier": [(3, 7), (4, 8)],
        "part": [(100, "TIN", "green red blue", "B#1"), (200, None, "one", "B#2")],
        "lineitem": [
            (order, part, supplier, 1, 2.0, 30.0, flag, "2001-01-02")
            for order in (10, 20, 50, 60, 70)
            for part, supplier, flag in ((100, 3, "R"), (200, 4, "N"), (100, 9, "N"), (300, 3, "N"))
        ],
    }
    columns = {
        "customer": "c_custkey long, c_nationkey int",
        "orders": "o_orderkey long, o_custkey long",
        "supplier": "s_suppkey long, s_nationkey int",
        "part": "p_partkey long, p_type string, p_name string, p_brand string",
        "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
        " l_extendedprice double, l_returnflag string, l_shipdate string",
    }
    for name, rows in tables.items():
        spark.createDataFrame(rows, columns[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        log = sample_transactions(spark, str(tmp_path))
        found = [tuple(r) for r in log.select("id", "chain", "category", "company", "purchasequantity").collect()]
        plan = log._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    expected = []
    for order, shopper, chain, copies in ((10, 1, 105, 1), (20, 2, 106, 1), (50, 2, 106, 2)):
        expected += [(shopper, chain, "TIN/red", 7, -2), (shopper, chain, None, 8, 2)] * copies
    assert sorted(found, key=str) == sorted(expected, key=str)
    assert plan.count("SortMergeJoin") == 3 and "BroadcastHashJoin [l_suppkey" in plan
    assert "SortMergeJoin [o_custkey" in plan.split("SortMergeJoin [l_orderkey")[1]
