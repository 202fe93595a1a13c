"""Every operator and pipeline stage on odd and on empty tables."""

import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from odd_tables import benchmark, labels, no_documents, odd_documents, odd_rows, prose  # noqa: E402

from tillroll.llm import (  # noqa: E402
    decontamination,
    html_text,
    mixing,
    perplexity,
    private,
    sharding,
    simhash,
    suffixes,
    syncmers,
    training_order,
)

ROWS = odd_rows()


def good(spark):
    return labels(spark, [(1, 1, 0, "x"), (3, 1, 0, None), (3, 0, 0, None), (None, 1, 0, None), (7, 1, 0, None)])


def items(spark):
    return benchmark(spark, [(1, prose(3, 30), None), (2, None, 1), (3, "", 1), (None, "the of", 1)])


ONE_ROW_EACH = {
    "shard": lambda spark, docs: sharding.shard_documents(docs, [1.0] * 4, [1.0] * 5),
    "classify": lambda spark, docs: perplexity.classify(docs, good(spark)),
    "private": lambda spark, docs: private.digest(private.private_spans(docs)),
    "sanitised": lambda spark, docs: private.sanitised(docs),
    "syncmers": lambda spark, docs: syncmers.fingerprints(docs),
    "simhash": lambda spark, docs: simhash.near_duplicates(docs),
    "suffixes": lambda spark, docs: suffixes.deduplicated(docs),
}
SAME_COLUMNS = {
    "accepted": lambda spark, docs: perplexity.accepted(docs, good(spark)),
    "one_of_each": lambda spark, docs: simhash.one_of_each(docs),
    "decontaminated": lambda spark, docs: decontamination.decontaminated(docs, items(spark)),
    "mixed": lambda spark, docs: mixing.mixed(docs),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_each(spark, name):
    found = ONE_ROW_EACH[name](spark, odd_documents(spark)).collect()
    assert Counter(r.doc_id for r in found) == Counter(row[0] for row in ROWS)
    assert ONE_ROW_EACH[name](spark, no_documents(spark)).collect() == []


@pytest.mark.parametrize("name", SAME_COLUMNS)
def test_same_columns(spark, name):
    docs = odd_documents(spark)
    found = SAME_COLUMNS[name](spark, docs)
    assert found.columns == docs.columns
    given = {tuple(row) for row in docs.collect()}
    rows = [tuple(row) for row in found.collect()]
    assert rows and set(rows) <= given
    empty = SAME_COLUMNS[name](spark, no_documents(spark))
    assert empty.columns == docs.columns and empty.collect() == []


def test_one_of_each_group_stays(spark):
    docs = odd_documents(spark).select("doc_id", "text")
    classes = simhash.near_duplicates(docs).select("root").distinct().count()
    assert simhash.one_of_each(docs).count() == classes


def test_contaminated(spark):
    found = decontamination.contaminated(odd_documents(spark), items(spark)).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(None, 1)]
    assert decontamination.contaminated(no_documents(spark), items(spark)).collect() == []
    assert decontamination.contaminated(odd_documents(spark), benchmark(spark)).collect() == []


def test_without_trusted_texts_all_are_kept(spark):
    docs = odd_documents(spark)
    assert perplexity.accepted(docs, labels(spark)).count() == len(ROWS)


def test_training_order(spark):
    found = training_order.training_order(odd_documents(spark), shard_slots=64).collect()
    assert sorted(r.slot for r in found) == list(range(len(found)))
    assert Counter(r.doc_id for r in found if r.part == 0) == Counter(row[0] for row in ROWS)
    assert training_order.training_order(no_documents(spark)).collect() == []


def test_pages(spark):
    schema = "page_id long, url string, html string, text int, n_chars string"
    rows = [(1, None, None, 1, ""), (None, "u", "", 1, ""), (2, "u", "<p>a</p>" * 30_000, None, None), (2, "u", "a < b &lt;", 1, None)]
    found = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert [(r.page_id, r.n_chars) for r in found] == [(1, 0), (None, 0), (2, 59_999), (2, 7)]
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
