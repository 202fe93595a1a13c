import pytest
from tables import rows_of

from tillroll.operators import joins
from tillroll.operators.joins import broadcast_bytes, fits_broadcast, hot_keys, join_lookup


@pytest.fixture
def fact(spark):
    # key 0 holds 40 copies of one row, key 1 holds 30 rows, the others one each
    rows = [(0, "x")] * 40 + [(1, f"r{i}") for i in range(30)] + [(i, "y") for i in range(2, 32)]
    return spark.createDataFrame(rows, "k int, v string").repartition(6)


@pytest.fixture
def lookup(spark):
    return spark.createDataFrame([(i, i * 10) for i in range(0, 40, 3)] + [(1, 5)], "k int, w int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_give_the_same_rows(spark, fact, lookup, how, large_lookups):
    split = join_lookup(fact, lookup, "k", how)
    assert "_piece" in split._jdf.queryExecution().analyzed().toString()
    assert "BroadcastNestedLoopJoin" not in split._jdf.queryExecution().executedPlan().toString()
    assert rows_of(split) == rows_of(fact.join(lookup, "k", how))


def test_hot_keys_and_their_pieces(fact, large_lookups):
    hot = {row["k"]: row["_pieces"] for row in hot_keys(fact, ["k"]).collect()}
    assert hot == {0: 4, 1: 3}


def test_hot_keys_from_a_sample(spark, large_lookups):
    # a tenth of 100,000 rows is sampled; key 0 has two thirds of them
    spark.conf.set("spark.tillroll.pieceRows", "10000")
    rows = spark.range(100_000).selectExpr("if(id % 3 < 2, 0, id) as k")
    hot = hot_keys(rows, ["k"]).collect()
    assert [(row["k"], row["_pieces"]) for row in hot] == [(0, 7)]
    lookup = spark.range(0, 100_000, 5).withColumnRenamed("id", "k")
    joined = join_lookup(rows, lookup, "k")
    assert joined.count() == rows.join(lookup, "k").count()


def test_rows_of_a_hot_key_are_spread(spark, fact, lookup, large_lookups):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = join_lookup(fact, lookup, "k").rdd.glom().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for key in (0, 1):  # even the key that holds copies of a single row
        assert sum(any(row["k"] == key for row in part) for part in parts) > 1


def test_no_hot_key_is_a_plain_join(spark, lookup, large_lookups):
    even = spark.createDataFrame([(i,) for i in range(100)], "k int")
    plan = join_lookup(even, lookup, "k")._jdf.queryExecution().analyzed().toString()
    assert "_piece" not in plan


def test_pieces_are_no_larger_in_a_larger_table(spark, large_lookups):
    # a key with 0.08 % of the rows is split, and ten times the rows give ten times the pieces
    spark.conf.set("spark.tillroll.pieceRows", "200")
    for rows, pieces in ((500_000, 2), (5_000_000, 20)):
        table = spark.range(rows).selectExpr("if(id % 1250 = 0, -1, id) as k")
        hot = {row["k"]: row["_pieces"] for row in hot_keys(table, ["k"]).collect()}
        assert hot == {-1: pieces}


@pytest.mark.parametrize("how", ["left", "left_anti"])
def test_null_keys_are_spread(spark, lookup, large_lookups, how):
    fact = spark.range(100).selectExpr("if(id < 60, null, cast(id as int)) as k", "id as v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        joined = join_lookup(fact, lookup, "k", how)
        parts = joined.rdd.glom().collect()
        assert rows_of(joined) == rows_of(fact.join(lookup, "k", how))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(any(row["k"] is None for row in part) for part in parts) > 1


def test_empty_fact(spark, fact, lookup, large_lookups):
    assert join_lookup(fact.where("k < 0"), lookup, "k").count() == 0


def test_small_lookup_is_broadcast(fact, lookup):
    plan = join_lookup(fact, lookup, "k")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_size_check_counts_rows_and_text(spark):
    short = spark.createDataFrame([("a",)] * 10, "s string")
    long = spark.createDataFrame([("a" * 1000,)] * 10, "s string")
    assert broadcast_bytes(long) - broadcast_bytes(short) == 9990
    assert fits_broadcast(long)
    spark.conf.set("spark.tillroll.broadcastBytes", "5000")
    try:
        assert not fits_broadcast(long)
    finally:
        spark.conf.unset("spark.tillroll.broadcastBytes")
    assert broadcast_bytes(short.where("s = 'b'")) == 0


def test_only_the_sample_is_tested_for_hot_keys(spark, large_lookups, monkeypatch):
    spark.conf.set("spark.tillroll.pieceRows", "2000")  # every second row is counted
    spark.conf.set("spark.tillroll.broadcastBytes", "20000")
    rows = spark.range(20000).selectExpr("if(id % 2 = 0, 7, id) as k", "id as v")
    lookup = spark.range(0, 20000, 5).selectExpr("id + 2 as k")
    tested, plain = [], joins.only_possible

    def noted(frame, possible):
        tested.append(frame._jdf.queryExecution().optimizedPlan().toString())
        return plain(frame, possible)

    monkeypatch.setattr(joins, "only_possible", noted)
    for how, filtered in (("left_semi", None), ("inner", True)):
        found = joins.join_lookup(rows, lookup, "k", how, filtered=filtered)
        assert rows_of(found) == rows_of(rows.join(lookup, "k", how))
    assert len(tested) == 4 and sum("Sample" in plan for plan in tested) == 2
