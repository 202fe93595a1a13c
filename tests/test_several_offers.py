"""Shoppers with several offers, against the matrix of one offer at a time."""

from datetime import timedelta
from decimal import Decimal

import pytest
from brute_force import matrix
from tables import HISTORY, OFFER_DAY, frames, random_tables, rows_of

from tillroll.plans import several_offers as so
from tillroll.plans.features import feature_matrix


@pytest.mark.parametrize("before_offer", [False, True])
def test_each_offer_as_if_it_were_the_only_one(spark, before_offer):
    log, offers, history = random_tables(5, hot=0.3)
    # Every shopper has up to three offers, some on one day, one unknown.
    several = history + [(*h[:2], h[2] % 5 + 1, *h[3:6], h[6] + timedelta(days=25)) for h in history[::2]]
    several += [(*h[:2], (h[2] + 1) % 5 + 1, *h[3:]) for h in history[::3]] + [(*history[0][:2], 99, *history[0][3:])]
    tables = frames(spark, log, offers, several)
    found = {(r["id"], r["offer"]): r.asDict() for r in so.feature_matrix_by_offer(*tables, before_offer=before_offer).collect()}
    expected = {}
    for row in several:
        for shopper, features in matrix(log, offers, [row], before_offer).items():
            expected[shopper, row[2]] = features
    assert set(found) == set(expected) and len(found) > len(history)
    for key, features in expected.items():
        for name, value in features.items():
            assert found[key][name] == pytest.approx(value), (key, name)


def test_one_offer_each_is_the_plain_matrix(spark, large_lookups):
    log, offers, history = random_tables(6)
    tables = frames(spark, log, offers, history)
    options = {"dedupe": False, "keep_offer_columns": True, "day_limits": (7, 30, None)}
    found = so.feature_matrix_by_offer(*tables, **options)
    plain = feature_matrix(*tables, **options)
    assert rows_of(found) == rows_of(plain)


def test_missing_keys_and_dates(spark):
    log = [
        (1, 4, 1, 100, 7, None, OFFER_DAY, 1.0, "OZ", 1, Decimal(3)),
        (1, 4, 1, 100, None, 70, None, 1.0, "OZ", None, Decimal(5)),
        (1, 4, 1, 100, 7, 70, OFFER_DAY - timedelta(days=3), 1.0, "OZ", 2, None),
        (None, 4, 1, 100, 7, 70, OFFER_DAY, 1.0, "OZ", 2, Decimal(4)),
        (2, 4, 1, 100, 7, 70, None, 1.0, "OZ", 2, Decimal(-4)),
    ]
    history = [(1, 4, 1, 34, 2, "t", OFFER_DAY), (2, 4, 1, 34, 2, "t", OFFER_DAY)]
    tables = frames(spark, log, history=history)
    plain = rows_of(feature_matrix(*tables, strict_dept=False))
    assert rows_of(so.feature_matrix_by_offer(*tables, strict_dept=False)) == plain and len(plain) == 2


def test_a_shopper_and_offer_only_once(spark):
    tables = frames(spark, history=[*HISTORY, HISTORY[0]])
    with pytest.raises(ValueError, match="one shopper and offer"):
        so.feature_matrix_by_offer(*tables, strict_dept=False)


def test_offers_do_not_multiply_the_series(spark):
    log, offers, history = random_tables(7)
    tables = frames(spark, log, offers, history)
    spine = so.history_with_offers(tables[2], tables[1])
    spine = so.with_dept(spine, so.category_dept_map(tables[0], tables[1]))
    once = so.day_series(tables[0], spine, tables[1]).count()
    later = spine.unionByName(spine.withColumn("offerdate", so.F.date_add("offerdate", 9)))
    assert so.day_series(tables[0], later, tables[1]).count() == once


def test_look_ups_are_gathered_once(spark, large_lookups):
    log, offers, history = random_tables(8)
    tables = frames(spark, log, offers, history)
    spine = so.history_with_offers(tables[2], tables[1])
    spine = so.stage(so.with_dept(spine, so.category_dept_map(tables[0], tables[1])), "spine")
    series = so.stage(so.day_series(tables[0], spine, tables[1]), "series")
    found = so.looked_up(series, spine, so._cuts(so.lb.DAY_LIMITS, so.lb.RECENT_DAYS))
    per_offer = found.groupBy("id", "offer").count()
    assert per_offer._jdf.queryExecution().executedPlan().toString().count("Exchange hash") == 1
    assert per_offer.count() == spine.count()


def test_own_keys_do_not_run_together(spark):
    rows = spark.createDataFrame([("a1", 1, "b"), ("a", 11, "b"), ("a", 1, "1b")], "category string, company int, brand string")
    assert rows.select(so._key(*so.ITEMS)).distinct().count() == 3
    assert spark.sql("select 'a' as category, null as company, 'b' as brand").where(so._key(*so.ITEMS).isNull()).count() == 1
