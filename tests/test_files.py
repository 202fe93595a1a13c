import logging

import pytest
from pyspark.sql import functions as F
from tables import HISTORY, OFFERS, frames, rows_of, sale

from tillroll.operators.reduction import reduce_transactions, reduced_table
from tillroll.operators.spine import category_dept_map
from tillroll.session import release_staged, stage, staged_mark, work_folder
from tillroll.sources import files, schemas


def test_csv_round_trip(spark, tmp_path):
    transactions, offers, history = frames(spark)
    for name, table, schema in [
        ("t", transactions, schemas.transactions_schema()),
        ("o", offers, schemas.offers_schema()),
        ("h", history, schemas.train_history_schema()),
    ]:
        path = str(tmp_path / name)
        files.write_csv(table, path)
        back = files.read_table(spark, path, schema)
        assert back.schema.simpleString() == schema.simpleString()
        assert rows_of(back) == rows_of(table)


def test_rows_with_missing_keys_stay(spark, tmp_path):
    (tmp_path / "o.csv").write_text(
        "offer,category,quantity,company,offervalue,brand\n1,2,1,3,0.75,4\n,2,1,3,0.75,4\n"
    )
    schema = schemas.offers_schema()
    table = files.read_table(spark, str(tmp_path / "o.csv"), schema)
    assert table.count() == 2
    with pytest.raises(ValueError, match="offers: rows without {'offer': 1}"):
        files.require_keys(table, ["offer", "category"], "offers")
    files.require_keys(table, ["category"], "offers")


@pytest.mark.parametrize(
    "text",
    [
        "offer,category,quantity,company,offervalue,brand\nx,2,1,3,0.75,4\n",
        "offer,company,quantity,category,offervalue,brand\n1,2,1,3,0.75,4\n",
    ],
)
def test_malformed_files_fail(spark, tmp_path, text):
    (tmp_path / "bad.csv").write_text(text)
    table = files.read_table(spark, str(tmp_path / "bad.csv"), schemas.offers_schema())
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|header"):
        table.collect()


def test_parquet_scan(spark, tmp_path):
    offers = frames(spark)[1]
    offers.write.parquet(str(tmp_path / "o"))
    back = files.read_table(spark, str(tmp_path / "o"), schemas.offers_schema(), fmt="parquet")
    assert rows_of(back) == rows_of(offers)


def test_versions_do_not_overwrite_each_other(spark, tmp_path):
    offers, history = frames(spark)[1:]
    first = files.save_versioned(offers, str(tmp_path), "x")
    second = files.save_versioned(history, str(tmp_path), "x")
    loaded = files.load_saved(spark, [second, first])
    assert [df.count() for df in loaded] == [len(HISTORY), len(OFFERS)]


def test_nothing_is_saved_if_empty(spark, tmp_path, caplog):
    offers = frames(spark)[1].where("offer < 0")
    with caplog.at_level(logging.WARNING):
        assert files.save_versioned(offers, str(tmp_path / "empty"), "x") is None
    assert "no rows" in caplog.text
    assert not (tmp_path / "empty").exists()


def test_reduction_is_reused_while_its_inputs_stay(spark, tmp_path):
    transactions, offers, _ = (stage(df, "reduction") for df in frames(spark))
    path = str(tmp_path / "reduced")
    built, counts = reduced_table(spark, path, transactions, offers)
    assert counts == {"searched": 14, "kept": 13}
    assert rows_of(built) == rows_of(reduce_transactions(transactions, offers))
    written = sorted(built.inputFiles())
    again, counts = reduced_table(spark, path, transactions, offers)
    assert sorted(again.inputFiles()) == written and counts["kept"] == 13
    fewer, counts = reduced_table(spark, path, transactions.where("id = 10"), offers)
    assert sorted(fewer.inputFiles()) != written
    assert rows_of(fewer) == rows_of(reduce_transactions(transactions.where("id = 10"), offers))
    assert counts["kept"] == fewer.count()
    other, _ = reduced_table(spark, path, transactions, offers.limit(1))
    assert rows_of(other) == rows_of(reduce_transactions(transactions, offers.limit(1)))


def test_a_table_without_its_manifest_is_rebuilt(spark, tmp_path):
    transactions, offers, _ = frames(spark)
    path = str(tmp_path / "reduced")
    reduced_table(spark, path, transactions.where("id = 10"), offers, "state")
    files._write_manifest(spark, path, {"state": None})  # as a failed run leaves it
    assert reduced_table(spark, path, transactions, offers, "state")[0].count() == 13
    none = transactions.where("id < 0")
    assert reduced_table(spark, path, none, offers, "state")[0].count() == 13


def test_saved_files_are_in_order(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id", "repeat('x', cast(rand(1) * id / 50 as int)) as v")
    saved = files.save_versioned(rows.repartition(7, "v").orderBy("id"), str(tmp_path), "x")
    parts = spark.read.parquet(saved).groupBy(F.input_file_name().alias("file"))
    found = parts.agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("file").collect()
    assert all(a["high"] < b["low"] for a, b in zip(found, found[1:]))
    assert sum(f["high"] - f["low"] + 1 for f in found) == 20_000


def test_released_tables_are_empty(spark):
    mark = staged_mark(spark)
    staged = [stage(frames(spark)[1], "release") for _ in range(2)]
    paths = [df.inputFiles()[0].rsplit("/", 1)[0] for df in staged]
    assert release_staged(spark, mark) == 2 and staged_mark(spark) == mark
    assert all(spark.read.parquet(path).count() == 0 for path in paths)


def test_stage_keeps_rows_and_schema(spark):
    offers = frames(spark)[1]
    staged = stage(offers, "test")
    assert staged.schema == offers.schema
    assert rows_of(staged) == rows_of(offers)
    assert all(work_folder(spark) in f for f in staged.inputFiles())

BAD_LOG = (
    "id,chain,dept,category,company,brand,date,productsize,productmeasure,"
    "purchasequantity,purchaseamount\n"
    "1,1,1,100,7,70,2013-04-01,1.0,EA,1,5.00\n"
    "1,1,1,100,7,70,no date,1.0,EA,1,6.00\n"
    "1,1,,200,7,,2013-04-03,1.0,EA,1,10.00\n"
    "2,1,1\n"
    "2,1,1,100,7,70,2013-04-01,1.0,EA,1,3.00,further\n"
)


def test_bad_lines_are_put_aside(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.csv").write_text(BAD_LOG)
    (tmp_path / "log" / "b.csv").write_text("\n".join(BAD_LOG.splitlines()[:2]) + "\n")
    schema = schemas.transactions_schema()
    good, bad = files.split_bad_lines(spark, str(tmp_path / "log"), schema)
    assert good.schema == schema and good.count() == 3
    assert good.where("brand is null and dept is null").count() == 1  # missing is not malformed
    assert good.select("id").count() == 3  # whatever the columns asked for
    found = sorted((r["file"].rsplit("/", 1)[1], r["line"]) for r in bad.collect())
    lines = BAD_LOG.splitlines()
    assert found == sorted(("a.csv", line) for line in (lines[2], lines[4], lines[5]))


def test_no_bad_lines_and_no_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(BAD_LOG.splitlines()[0] + "\n")
    good, bad = files.split_bad_lines(
        spark, str(tmp_path / "a.csv"), schemas.transactions_schema()
    )
    assert good.count() == bad.count() == 0


def test_a_header_in_another_order_still_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text(BAD_LOG.replace("id,chain", "chain,id", 1))
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE|header"):
        files.split_bad_lines(spark, str(tmp_path / "a.csv"), schemas.transactions_schema())


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_last_line_of_each_category(spark, tmp_path, fmt):
    schema = schemas.transactions_schema()
    days = [(n % 5, n // 5 % 7 + 1) for n in range(4000)]  # dates say nothing about the order
    log = [sale(n, d, 100 + n % 9, 7, 70, 1, "1.00", dept=dept) for n, (d, dept) in enumerate(days)]
    last = sale(9999, 1, 100, 7, 70, 1, "1.00")
    log.append((*last[:2], None, *last[3:]))  # without a dept it says nothing
    path = str(tmp_path / "log")
    table = spark.createDataFrame(log, schema).repartitionByRange(3, "id").sortWithinPartitions("id")
    if fmt == "csv":
        files.write_csv(table, path)
    else:
        table.write.option("parquet.block.size", "8192").parquet(path)
    expected = {100 + n % 9: dept for n, (_, dept) in enumerate(days)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # many splits of a file
    try:
        back = files.read_table(spark, path, schema, fmt)
        assert back.rdd.getNumPartitions() > 3
        found = dict(category_dept_map(back, order="file").collect())
        assert found == expected
        wanted = spark.createDataFrame([(100,), (108,), (999,)], "category int")
        some = dict(category_dept_map(back, wanted, order="file").collect())
        assert some == {k: v for k, v in expected.items() if k in (100, 108)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError, match="order is date or file"):
        category_dept_map(back, order="size")
