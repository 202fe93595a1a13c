"""The log kept in buckets of shoppers."""

import pytest
from pyspark.sql import functions as F
from tables import frames, random_tables, rows_of

from tillroll.operators.joins import join_lookup
from tillroll.operators.market import shopper_totals
from tillroll.plans.features import base_features, feature_matrix
from tillroll.plans.pipeline import Inputs, run
from tillroll.session import stage
from tillroll.sources import buckets, files
from tillroll.sources.buckets import Buckets, read_bucketed, spread, write_bucketed

BY_SHOPPER = Buckets("id", 6, ("date",))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def below_the_join(plan, table):
    """The exchanges between the scan of ``table`` and the join above it."""
    lines = plan.splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and table in x)
    join = max(i for i, x in enumerate(lines[:scan]) if "SortMergeJoin" in x)
    return ["Exchange" for x in lines[join:scan] if "Exchange" in x]


@pytest.fixture
def tables(spark):
    log, offers, history = random_tables(5, shoppers=40, rows=600)
    return [stage(df, "buckets") for df in frames(spark, log, offers, history)]


def kept(spark, log, path, buckets=BY_SHOPPER):
    write_bucketed(log, path, buckets)
    return read_bucketed(spark, path, log.schema, buckets)


def test_rows_stay_and_are_in_their_bucket(spark, tables, tmp_path):
    table = kept(spark, tables[0], str(tmp_path / "log"))
    assert table.schema == tables[0].schema
    assert rows_of(table) == rows_of(tables[0])
    assert len(table.inputFiles()) <= 6  # no more than one per bucket
    found = table.select(
        F.pmod(F.hash("id"), F.lit(6)).alias("bucket"),
        F.regexp_extract(F.input_file_name(), r"_(\d{5})\.", 1).cast("int").alias("file"),
    )
    assert found.where("bucket <> file").count() == 0
    write_bucketed(tables[0].where("id < 3"), str(tmp_path / "log"), BY_SHOPPER)  # over it
    again = read_bucketed(spark, str(tmp_path / "log"), tables[0].schema, BY_SHOPPER)
    assert rows_of(again) == rows_of(tables[0].where("id < 3"))


def test_a_hot_shopper_is_several_files(spark, tmp_path, large_lookups):
    rows = spark.range(3000).selectExpr(
        "case when id % 3 = 0 then 7 when id % 3 = 1 then null else id end as id", "id as v"
    )
    spark.conf.set("spark.tillroll.pieceRows", "200")
    buckets = Buckets("id", 6)
    parts = [len(p) for p in spread(rows, buckets).rdd.glom().collect()]
    assert len(parts) == 6 and max(parts) < 1000 and sum(parts) == 3000
    table = kept(spark, rows, str(tmp_path / "log"), buckets)
    assert rows_of(table) == rows_of(rows)
    of_hot = table.where("id = 7").select(F.input_file_name()).distinct().count()
    assert of_hot > 1
    lookup = spark.range(0, 3000, 2).withColumn("w", F.col("id") * 2)
    for how in ("inner", "left", "left_anti"):
        assert rows_of(join_lookup(table, lookup, "id", how)) == rows_of(
            rows.join(lookup, "id", how)
        )


def test_an_empty_log(spark, tables, tmp_path):
    table = kept(spark, tables[0].where("id < -1"), str(tmp_path / "log"))
    assert table.count() == 0 and table.schema == tables[0].schema


def test_a_large_history_needs_no_exchange_of_the_log(spark, tables, tmp_path, large_lookups):
    transactions, offers, history = tables
    spark.conf.set("spark.tillroll.pieceRows", "1000")
    # as many buckets as the session's shuffles have partitions
    table = kept(spark, transactions, str(tmp_path / "log"), Buckets("id", 4, ("date",)))
    base = base_features(table, offers, history)
    plan = plan_of(base)
    assert "Bucketed: true" in plan and "Broadcast" not in plan
    assert below_the_join(plan, "tillroll_") == []
    assert below_the_join(plan_of(base_features(*tables)), "purchaseamount") == ["Exchange"]
    # only the history and its offers are left to be shuffled
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan_of(base_features(*tables)).count("Exchange hashpartitioning") == 3
    # with another number of buckets the rolled-up rows are, not the log
    other = kept(spark, transactions, str(tmp_path / "six"))
    assert below_the_join(plan_of(base_features(other, offers, history)), "tillroll_") == []
    assert rows_of(base) == rows_of(base_features(*tables))
    assert rows_of(feature_matrix(table, offers, history)) == rows_of(feature_matrix(*tables))


def test_spend_per_shopper_needs_no_exchange(spark, tables, tmp_path):
    table = kept(spark, tables[0], str(tmp_path / "log"))
    totals = shopper_totals(table)
    assert "Exchange" not in plan_of(totals)
    assert rows_of(totals) == rows_of(shopper_totals(tables[0]))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_pipeline_with_buckets(spark, tables, tmp_path, fmt):
    inputs = Inputs(*[str(tmp_path / n) for n in ("offers", "log", "history")])
    for table, path in zip((tables[1], tables[0], tables[2]), inputs):
        if fmt == "csv":
            files.write_csv(table, path)
        else:
            table.write.parquet(path)
    out = str(tmp_path / "out")
    results = run(spark, inputs, out, fmt=fmt, buckets=4)
    assert rows_of(files.load_saved(spark, [results.saved_features])[0]) == rows_of(
        feature_matrix(*tables)
    )
    written = sorted(spark.read.parquet(f"{out}/transactions-by-shopper").inputFiles())
    run(spark, inputs, out, fmt=fmt, buckets=4)  # reused
    assert sorted(spark.read.parquet(f"{out}/transactions-by-shopper").inputFiles()) == written
    other = run(spark, inputs, out, fmt=fmt, buckets=3)
    assert sorted(spark.read.parquet(f"{out}/transactions-by-shopper").inputFiles()) != written
    assert rows_of(other.features) == rows_of(results.features)


def test_a_large_log_has_more_buckets(spark, tables, tmp_path):
    rows = tables[0].count()
    spark.conf.set("spark.tillroll.pieceRows", str(rows // 10))
    try:
        path = str(tmp_path / "log")
        for build in (lambda: tables[0], None):  # made, then reused
            table, _ = files.reuse_or_build(spark, path, build, "s", buckets=Buckets("id", 4))
            assert rows_of(table) == rows_of(tables[0])
            assert "into 12 buckets" in spark.sql(f"show create table {buckets._name(path)}").first()[0].lower()
    finally:
        spark.conf.unset("spark.tillroll.pieceRows")
