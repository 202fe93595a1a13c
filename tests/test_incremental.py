"""The matrix of a growing log, against the matrix of the whole log."""

import random

import pytest
from brute_force import matrix
from tables import frames, random_tables, rows_of

from tillroll.operators.market import shopper_totals
from tillroll.operators.reduction import reduce_transactions
from tillroll.plans import incremental
from tillroll.plans.features import feature_matrix
from tillroll.plans.pipeline import Inputs
from tillroll.session import _staged, staged_mark
from tillroll.sources import files


class Log:
    """A log of CSV files, some rows to a file."""

    def __init__(self, spark, folder, log, offers, history):
        self.spark, self.rows, self.offers, self.history = spark, {}, offers, history
        self.inputs = Inputs(f"{folder}/offers", f"{folder}/log", f"{folder}/history")
        self.store = f"{folder}/sums"
        self.log = log
        files.write_csv(self._frames(log)[1], self.inputs.offers)
        files.write_csv(self._frames(log)[2], self.inputs.history)

    def _frames(self, log):
        return frames(self.spark, log, self.offers, self.history)

    def add(self, name, rows, mode="errorifexists"):
        self.rows[name] = rows
        path = f"{self.inputs.transactions}/{name}"
        self._frames(rows)[0].coalesce(1).write.mode(mode).option("header", True).csv(path)

    def update(self, **options):
        return incremental.update(self.spark, self.inputs, self.store, **options)

    def whole(self):
        return self._frames([r for rows in self.rows.values() for r in rows])


@pytest.fixture
def log(spark, tmp_path):
    rows, offers, history = random_tables(3)
    made = Log(spark, str(tmp_path), rows, offers, history)
    random.Random(1).shuffle(rows)
    made.parts = [rows[:150], rows[150:300], rows[300:]]
    return made


def test_days_are_added(log):
    for day, rows in enumerate(log.parts):
        log.add(f"day-{day}", rows)
        grown = log.update(strict_dept=False, most_batches=2)  # the third day merges them
        assert grown.files_read == 1  # never those of the days before
    transactions, offers, _ = log.whole()
    reduced = reduce_transactions(transactions, offers)
    assert grown.reduction == {"searched": transactions.count(), "kept": reduced.count()}
    assert rows_of(grown.reduced) == rows_of(reduced)
    assert rows_of(grown.totals) == rows_of(shopper_totals(transactions))
    found = {r["id"]: r.asDict() for r in grown.features.collect()}
    expected = matrix([r for p in log.parts for r in p], log.offers, log.history)
    assert set(found) == set(expected)
    for shopper, features in expected.items():
        for name, value in features.items():
            assert found[shopper][name] == pytest.approx(value), (shopper, name)
    assert log.update().files_read == 0


def test_old_files_are_not_read(log, monkeypatch):
    read = []
    read_table = files.read_table

    def spy(spark, path, schema, fmt="csv"):
        read.append(path)
        return read_table(spark, path, schema, fmt)

    monkeypatch.setattr(files, "read_table", spy)
    log.add("day-0", log.parts[0])
    log.update(strict_dept=False)
    log.add("day-1", log.parts[1])
    read.clear()
    log.update(strict_dept=False)
    paths = [p for path in read for p in ([path] if isinstance(path, str) else path)]
    assert sum("day-1" in p for p in paths) == 1 and not any("day-0" in p for p in paths)


def test_changed_and_removed_files(log):
    for day, rows in enumerate(log.parts):
        log.add(f"day-{day}", rows)
    log.update()
    log.add("day-3", log.parts[0][:40])
    assert log.update().files_read == 1
    # Of the first batch's three files one goes: the other two are read again.
    log.add("day-1", log.parts[1][:1], mode="overwrite")
    grown = log.update(strict_dept=False)
    assert grown.files_read == 3
    whole = feature_matrix(*log.whole(), strict_dept=False)
    assert rows_of(grown.features) == rows_of(whole)


def test_options_and_inputs_have_their_own_sums(log):
    for day, rows in enumerate(log.parts):
        log.add(f"day-{day}", rows)
    log.update()
    grown = log.update(before_offer=True, dedupe=False)
    assert grown.files_read == 3
    expected = feature_matrix(*log.whole(), before_offer=True, dedupe=False)
    assert rows_of(grown.features) == rows_of(expected)


def test_a_failed_batch_is_made_again(log, monkeypatch):
    log.add("day-0", log.parts[0])
    log.update(strict_dept=False)
    log.add("day-1", log.parts[1])
    log.add("day-2", log.parts[2])
    broken = incremental.dept_last_days

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(incremental, "dept_last_days", fail)
    with pytest.raises(RuntimeError):
        log.update()
    monkeypatch.setattr(incremental, "dept_last_days", broken)
    grown = log.update()
    assert grown.files_read == 2
    assert rows_of(grown.features) == rows_of(feature_matrix(*log.whole()))


def test_bad_lines_of_each_day_are_kept(spark, log):
    for day, rows in enumerate(log.parts):
        log.add(f"day-{day}", rows)
        wrong = log._frames(rows[: day + 1])[0].selectExpr("id", "chain")  # too few fields
        path = f"{log.inputs.transactions}/day-{day}"
        lines = ["id,chain,dept,category,company,brand,date,productsize,productmeasure,"
                 "purchasequantity,purchaseamount"]  # fmt: skip
        lines += [f"{r['id']},{r['chain']}" for r in wrong.collect()]
        spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode(
            "append"
        ).text(path)
        grown = log.update(strict_dept=False, most_batches=2, bad_lines=True)
        assert grown.files_read == 2
    assert grown.bad_lines.count() == 6  # 1 + 2 + 3, merged batches included
    whole = feature_matrix(*log.whole(), strict_dept=False)
    assert rows_of(grown.features) == rows_of(whole)
    with pytest.raises(Exception, match="MALFORMED|FAILED_READ_FILE"):
        log.update(strict_dept=False)


def test_a_parquet_log_is_read_where_it_is(spark, tmp_path):
    tables = frames(spark, *random_tables(4))
    inputs = Inputs(*[str(tmp_path / n) for n in ("offers", "log", "history")])
    for table, path in zip((tables[1], tables[0], tables[2]), inputs):
        table.write.parquet(path)
    mark = staged_mark(spark)
    grown = incremental.update(spark, inputs, str(tmp_path / "sums"), fmt="parquet")
    assert rows_of(grown.features) == rows_of(feature_matrix(*tables))
    staged = _staged[spark.sparkContext.applicationId][mark:]
    assert staged and not [path for path in staged if "new-rows" in path]
