"""The physical plans are the ones meant."""

import pytest
from tables import frames

from tillroll.operators import lookback as lb
from tillroll.operators import market as mk
from tillroll.operators.reduction import reduce_transactions
from tillroll.operators.spine import category_dept_map, history_with_offers
from tillroll.plans.features import base_features, feature_matrix
from tillroll.session import stage


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark):
    return [stage(df, f"plan-{i}") for i, df in enumerate(frames(spark))]


def scans_of(plan, table):
    folder = table.inputFiles()[0].rsplit("/", 1)[0].rsplit("/", 1)[1]
    return sum(folder in line and "FileScan" in line for line in plan.splitlines())


def no_slow_operators(plan):
    for name in ("NestedLoop", "Cartesian", "PythonUDF", "BatchEvalPython", "ArrowEvalPython"):
        assert name not in plan


def test_matrix(spark, tables):
    transactions, offers, history = tables
    dept_map = stage(category_dept_map(transactions), "plan-dept")
    plan = plan_of(feature_matrix(transactions, offers, history, dept_map))
    no_slow_operators(plan)
    # the offered rows were staged: here are the shoppers' purchases, and the
    # shopper count, which each of the two shares names
    assert scans_of(plan, transactions) <= 3
    assert "BroadcastHashJoin" in plan


def test_base_features_scan_the_log_once(tables):
    transactions, offers, history = tables
    plan = plan_of(base_features(transactions, offers, history))
    no_slow_operators(plan)
    assert scans_of(plan, transactions) == 1
    line = next(x for x in plan.splitlines() if "purchaseamount" in x and "FileScan" in x)
    for unused in ("chain", "productsize", "productmeasure", "dept"):
        assert unused not in line.split("ReadSchema")[1]


def test_a_large_history_shuffles_the_log_once(spark, tables, large_lookups):
    spark.conf.set("spark.tillroll.pieceRows", "1000")
    plan = plan_of(base_features(*tables))
    no_slow_operators(plan)
    assert "Broadcast" not in plan
    # the log, the offers of the join and the history's other columns
    assert plan.count("Exchange hashpartitioning") == 3
    assert plan.count("SortMergeJoin") == 2


def test_reduction_does_not_shuffle_the_log(tables):
    transactions, offers, _ = tables
    plan = plan_of(reduce_transactions(transactions, offers))
    no_slow_operators(plan)
    assert plan.count("BroadcastHashJoin") == 3
    log = [x for x in plan.splitlines() if "Exchange" in x and "productmeasure" in x]
    assert not log


def test_single_blocks_need_one_shuffle(tables):
    transactions, offers, history = tables
    spine = stage(history_with_offers(history, offers), "plan-spine")
    events = lb.event_measures(lb.history_events(transactions, spine))
    plan = plan_of(lb.per_shopper(events, lb.grid_features("amount")))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortAggregate" not in plan


def test_rolled_up_rows_are_gathered_after_a_partial_sum(tables):
    transactions, offers, history = tables
    spine = stage(history_with_offers(history, offers), "plan-spine")
    events = lb.event_measures(lb.history_events(transactions, spine))
    plan = plan_of(lb.per_shopper(lb.roll_up(events), lb.visit_feature()))
    lines = [x.strip(" :+-*()0123456789") for x in plan.splitlines()]
    order = [x.split("(")[0].split(" ")[0] for x in lines]
    order = [x for x in order if x in ("HashAggregate", "Exchange")]
    assert order == [
        "HashAggregate",  # per shopper, final and partial in one stage
        "HashAggregate",
        "Exchange",  # by shopper
        "HashAggregate",
        "Exchange",  # by shopper and band
        "HashAggregate",  # partial sum before any shuffle
    ]


def test_dept_map_stays_a_hash_aggregate_on_the_log(tables):
    plan = plan_of(category_dept_map(tables[0]))
    below = plan.splitlines()[-1 - next(
        i for i, x in enumerate(reversed(plan.splitlines())) if "Aggregate" in x
    )]
    assert "HashAggregate" in below and "SortAggregate" not in below


def test_whole_row_counts_are_partial_before_the_shuffle(tables):
    plan = plan_of(mk.universe_rollup(tables[0], tables[1]))
    no_slow_operators(plan)
    wide = [x for x in plan.splitlines() if "productmeasure" in x]
    kinds = [x.strip(" :+-*()0123456789").split("(")[0].split(" ")[0] for x in wide]
    assert kinds.index("Exchange") < len(kinds) - 1
    assert kinds[kinds.index("Exchange") + 1] == "HashAggregate"
