"""Expected values worked out by hand from the definitions."""

from decimal import Decimal

import pytest
from tables import HISTORY, OFFER_DAY, TRANSACTIONS, frames, rows_of, sale

from tillroll.plans.features import (
    FEATURE_NAMES,
    base_features,
    dropped_shoppers,
    feature_matrix,
    sorted_for_export,
)


@pytest.fixture(scope="module")
def matrix(spark):
    rows = feature_matrix(*frames(spark)).collect()
    return {row["id"]: row.asDict() for row in rows}


def check(row, **expected):
    assert {k: row[k] for k in expected} == pytest.approx(expected)


def test_which_shoppers_remain(spark, matrix):
    assert set(matrix) == {10, 11, 12}
    reasons = {(r["id"], r["reason"]) for r in dropped_shoppers(*frames(spark)).collect()}
    assert reasons == {
        (13, "no purchases"),
        (14, "product never sold"),
        (15, "unknown offer"),
    }


def test_history_columns_and_label(matrix):
    check(matrix[10], chain=4, offer=1, market=34, repeattrips=2, label="1", X8=1.0)
    assert matrix[11]["label"] == "0"
    assert matrix[12]["label"] == "u"
    assert "offerdate" not in matrix[10] and "quantity" not in matrix[10]


def test_all_features_are_there_in_order(matrix):
    assert [c for c in matrix[10] if c.startswith("X")] == [f"X{i}" for i in range(1, 88)]


def test_ever_bought(matrix):
    check(matrix[10], X1=1, X2=1, X3=1, X4=1, X5=1, X6=1)
    check(matrix[12], X1=0, X2=0, X3=1, X4=0, X5=0, X6=0)


def test_look_back_edges(matrix):
    row = matrix[10]
    # category: a purchase after the offer counts, 1000 days ago too, 1001 not
    check(row, X9=4, X10=5, X11=5, X14=5, X15=6)
    check(row, X16=5, X17=6, X22=6)  # company adds the sale of category 300
    check(row, X23=4, X24=5)
    check(row, X30=16.5, X31=13.5, X36=14.0)
    check(row, X37=26.5, X38=23.5)
    check(row, X51=5, X52=4, X57=5)


def test_spend_and_visits(matrix):
    row = matrix[10]
    check(row, X7=24.25, X72=24.25)
    check(row, X73=17.7, X80=3)  # 29 days, and no lower bound
    check(row, X74=7.7, X75=4, X76=13.5, X77=4)
    check(row, X78=7.7, X79=4)
    check(row, X81=1001, X82=-1, X83=1)
    check(matrix[11], X80=1, X83=0)
    # no own purchase at all
    check(matrix[12], X74=0, X75=0, X76=0, X77=0, X83=0)
    check(matrix[12], X78=3.0, X79=4)  # same dept as category 200, of company 8


def test_copies_count_once_where_defined_so(matrix):
    # 17.00 in all, the copy left out, and 7.00 is on no offer
    check(matrix[11], X7=17.0, X72=5.0, X9=2, X30=10.0, X76=10.0)
    check(matrix[12], X72=0.0)


def test_market(matrix):
    # product 100/7/70: 8 rows with the copy; category 100: 9 distinct rows
    check(matrix[10], X84=8 / 9, X85=13.5, X86=3 / 5, X87=3 / 5)
    check(matrix[12], X84=1.0, X85=-100.0, X86=1 / 5, X87=1 / 5)


def test_share_above_one_is_kept(spark):
    log = TRANSACTIONS + [sale(11, 10, 100, 7, 70, 1, "5.00")] * 5
    row = {r["id"]: r for r in feature_matrix(*frames(spark, log)).collect()}[10]
    assert row["X84"] == pytest.approx(13 / 9)


def test_without_dedupe(spark):
    rows = {r["id"]: r for r in feature_matrix(*frames(spark), dedupe=False).collect()}
    assert rows[11]["X72"] == 10.0
    assert rows[10]["X84"] == pytest.approx(8 / 10)


def test_before_offer(spark):
    rows = {r["id"]: r for r in feature_matrix(*frames(spark), before_offer=True).collect()}
    row = rows[10]
    check(row, X7=20.95, X72=20.95, X76=10.2, X82=29, X80=1, X9=2, X73=14.4)
    check(row, X84=8 / 9, X86=3 / 5)  # the market is that of all shoppers


def test_base_features_keep_shoppers_of_unsold_products(spark):
    rows = {r["id"]: r.asDict() for r in base_features(*frames(spark)).collect()}
    assert set(rows) == {10, 11, 12, 14}
    assert [c for c in rows[10] if c.startswith("X")] == [f"X{i}" for i in range(1, 72)]


def test_history_without_outcome(spark):
    transactions, offers, history = frames(spark)
    test = history.drop("repeattrips", "repeater")
    full = feature_matrix(transactions, offers, history).drop("repeattrips", "label")
    assert rows_of(feature_matrix(transactions, offers, test)) == rows_of(full)


def test_returned_frame_keeps_the_offer(spark):
    rows = sorted_for_export(feature_matrix(*frames(spark), keep_offer_columns=True)).collect()
    assert [r["id"] for r in rows] == [10, 11, 12]
    check(rows[0].asDict(), category=100, company=7, brand=70, dept=1, quantity=1)
    assert rows[0]["offerdate"] == OFFER_DAY


def test_other_limits(spark):
    rows = feature_matrix(
        *frames(spark), items=("company",), day_limits=(10, None), recent_days=30
    ).collect()
    row = {r["id"]: r for r in rows}[10]
    assert (row["n_company_10"], row["n_company_all"]) == (2, 6)
    assert row["amount_company_10"] == pytest.approx(3.3)
    assert row["X73"] == pytest.approx(26.5)


def test_repeated_shopper_is_refused(spark):
    history = HISTORY + [(10, 4, 3, 34, 0, "f", OFFER_DAY)]
    with pytest.raises(ValueError, match="10"):
        base_features(*frames(spark, history=history))


def test_unknown_category_is_refused_or_dropped(spark):
    offers = [(5, 555, 1, 7, Decimal("1.00"), 70)]
    history = [(10, 4, 5, 34, 0, "f", OFFER_DAY)]
    tables = frames(spark, offers=offers, history=history)
    with pytest.raises(KeyError, match="555"):
        feature_matrix(*tables)
    assert feature_matrix(*tables, strict_dept=False).count() == 0


def test_names_are_complete():
    numbers = {int(x[1:]) for x in FEATURE_NAMES.values()}
    assert numbers == set(range(1, 9)) | set(range(72, 88))
