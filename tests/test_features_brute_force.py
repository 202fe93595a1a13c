"""The whole matrix against a plain loop over random rows."""

import brute_force
import pytest
from tables import frames, random_tables, rows_of

from tillroll.operators.reduction import reduce_transactions
from tillroll.plans.features import base_features, feature_matrix


def compare(df, expected):
    rows = {row["id"]: row for row in df.collect()}
    assert set(rows) == set(expected)
    for shopper, features in expected.items():
        found = {name: rows[shopper][name] for name in features}
        assert found == pytest.approx(features), shopper


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("before_offer", [False, True])
def test_matrix(spark, seed, before_offer):
    tables = random_tables(seed)
    df = feature_matrix(*frames(spark, *tables), before_offer=before_offer)
    compare(df, brute_force.matrix(*tables, before_offer=before_offer))


@pytest.mark.parametrize("before_offer", [False, True])
def test_matrix_by_shuffle_with_a_hot_shopper(spark, large_lookups, before_offer):
    tables = random_tables(4, hot=0.4)
    df = feature_matrix(*frames(spark, *tables), before_offer=before_offer)
    compare(df, brute_force.matrix(*tables, before_offer=before_offer))


def test_reduction_changes_no_base_feature(spark):
    transactions, offers, history = frames(spark, *random_tables(5))
    reduced = reduce_transactions(transactions, offers)
    from_all = base_features(transactions, offers, history).drop("X7")
    from_reduced = base_features(reduced, offers, history).drop("X7")
    kept = from_all.join(reduced.select("id").distinct(), "id", "left_semi")
    assert rows_of(from_reduced) == rows_of(kept)


def test_partitioning_changes_nothing(spark):
    transactions, offers, history = frames(spark, *random_tables(6))
    one = feature_matrix(transactions.coalesce(1), offers, history)
    many = feature_matrix(transactions.repartition(13), offers, history)
    assert rows_of(one) == rows_of(many)


def test_counts_grow_with_the_limit_and_shares_are_shares(spark):
    rows = feature_matrix(*frames(spark, *random_tables(7))).collect()
    for row in rows:
        for start in (9, 16, 23):
            counts = [row[f"X{start + i}"] for i in range(7)]
            assert counts == sorted(counts)
        assert row["X81"] >= row["X82"]
        assert 0 < row["X86"] <= row["X87"] <= 1
