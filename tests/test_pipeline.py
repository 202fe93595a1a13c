import pytest
from pyspark.sql import functions as F
from tables import frames, rows_of

from tillroll.plans.features import base_features, feature_matrix
from tillroll.plans.pipeline import Inputs, offers_of_both, run
from tillroll.sources import files, schemas


def test_from_files_to_saved_tables(spark, tmp_path):
    transactions, offers, history = tables = frames(spark)
    inputs = Inputs(*[str(tmp_path / n) for n in ("offers", "log", "history")])
    for table, path in zip((offers, transactions, history), inputs):
        files.write_csv(table, path)

    results = run(spark, inputs, str(tmp_path / "out"))
    base, full = files.load_saved(spark, [results.saved_base, results.saved_features])
    assert rows_of(base) == rows_of(base_features(*tables))
    assert rows_of(full) == rows_of(feature_matrix(*tables))
    assert [r["id"] for r in results.features.collect()] == [10, 11, 12]
    assert results.totals.count() == 5
    assert {item: df.count() for item, df in results.matched.items()} == {
        "category": 9,
        "company": 8,
        "brand": 8,
    }

    assert results.reduction == {"searched": 14, "kept": 13}

    again = run(spark, inputs, str(tmp_path / "out"))
    assert again.saved_features != results.saved_features
    assert rows_of(again.features) == rows_of(results.features)


def test_a_changed_log_in_the_same_folder(spark, tmp_path):
    transactions, offers, history = frames(spark)
    inputs = Inputs(*[str(tmp_path / n) for n in ("offers", "log", "history")])
    for table, path in zip((offers, transactions.where("id in (10, 14)"), history), inputs):
        files.write_csv(table, path)
    first = run(spark, inputs, str(tmp_path / "out"))
    assert [r["id"] for r in first.features.collect()] == [10]
    first.release()
    changed = inputs._replace(transactions=f"{tmp_path}/log2")
    files.write_csv(transactions, changed.transactions)
    second = run(spark, changed, str(tmp_path / "out"))
    assert [r["id"] for r in second.features.collect()] == [10, 11, 12]


def test_rows_with_missing_keys_count(spark, tmp_path):
    """A purchase without a brand, dept, date or company is still a purchase."""
    (tmp_path / "log.csv").write_text(
        "id,chain,dept,category,company,brand,date,productsize,productmeasure,"
        "purchasequantity,purchaseamount\n"
        "1,1,1,100,7,70,2013-04-01,1.0,EA,1,5.00\n"
        "1,1,1,100,7,,2013-04-02,1.0,EA,1,6.00\n"
        "1,1,,200,7,70,2013-04-03,1.0,EA,1,10.00\n"
        "2,1,1,100,,70,2013-04-01,1.0,EA,1,3.00\n"
        ",1,1,100,7,70,2013-04-01,1.0,EA,1,4.00\n"
    )
    (tmp_path / "offers.csv").write_text(
        "offer,category,quantity,company,offervalue,brand\n1,100,1,7,0.75,70\n"
    )
    (tmp_path / "history.csv").write_text(
        "id,chain,offer,market,offerdate\n1,1,1,1,2013-04-20\n2,1,1,1,2013-04-20\n"
    )
    inputs = Inputs(*[str(tmp_path / n) for n in ("offers.csv", "log.csv", "history.csv")])
    results = run(spark, inputs, str(tmp_path / "out"), outcome=False)
    rows = {r["id"]: r for r in results.features.collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["X7"] == 21.0 and rows[1]["X9"] == 2 and rows[1]["X23"] == 2
    assert rows[2]["X16"] == 0 and rows[2]["X7"] == 3.0
    assert rows[1]["X84"] == 0.5  # two of the four rows of the category have the product
    assert rows[1]["X86"] == 0.5 and rows[1]["X87"] == 1.0  # of two shoppers known by id
    assert {r["id"]: r["total_spend"] for r in results.totals.collect()} == {1: 21.0, 2: 3.0}


def test_offers_of_two_histories(spark, tmp_path):
    history = frames(spark)[2]
    train = history.withColumn("repeattrips", F.lit(0)).withColumn("repeater", F.lit("t"))
    files.write_csv(train.select(*schemas.train_history_schema().names), str(tmp_path / "a"))
    test = history.select(*schemas.test_history_schema().names).limit(1)
    files.write_csv(test, str(tmp_path / "b"))
    both = offers_of_both(spark, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    assert sum(r["train_offer"] for r in both) == history.count()
    assert sum(r["test_offer"] for r in both) == 1


@pytest.mark.parametrize("buckets", [None, 3])
def test_bad_lines_of_the_log(spark, tmp_path, buckets):
    transactions, offers, history = tables = frames(spark)
    inputs = Inputs(*[str(tmp_path / n) for n in ("offers", "log", "history")])
    for table, path in zip((offers, transactions, history), inputs):
        files.write_csv(table, path)
    wrong = transactions.withColumn("date", F.lit("no date")).where("id = 10")
    wrong.write.mode("append").option("header", True).csv(inputs.transactions)
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        run(spark, inputs, str(tmp_path / "out"), buckets=buckets)
    for _ in range(2):  # built, then reused
        results = run(spark, inputs, str(tmp_path / "out"), buckets=buckets, bad_lines=True)
        assert results.bad_lines.count() == 8
        assert results.bad_lines.where("line like '10,4,%no date%'").count() == 8
        saved = files.load_saved(spark, [results.saved_features])[0]
        assert rows_of(saved) == rows_of(feature_matrix(*tables))
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):  # not from what was kept
        run(spark, inputs, str(tmp_path / "out"), buckets=buckets)
