"""What long sessions leave on the driver: stages called one by one, as well as by ``run``."""

from __future__ import annotations

import time

import corpus_pipeline
import numpy as np
import pytest
from tillroll.llm.batches import freed_when_left, share, tidy_driver

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def using_shared(spark):
    """Rows made with a shared value, and a weak reference to its broadcast."""
    shared = share(spark, np.arange(3))

    def mapped(batches):
        assert shared.value[2] == 2
        yield from batches

    weak = spark.sparkContext._jvm.java.lang.ref.WeakReference(shared._jbroadcast)
    return spark.range(5).mapInArrow(mapped, "id long"), weak


def test_a_shared_value_is_freed_with_its_last_result(spark):
    result, weak = using_shared(spark)
    tidy_driver(spark)
    assert weak.get() is not None
    assert result.count() == 5
    del result
    until = time.time() + 20
    while weak.get() is not None and time.time() < until:
        tidy_driver(spark)
        time.sleep(0.2)
    assert weak.get() is None


def test_shared_values_are_freed_when_left(spark):
    with freed_when_left():
        inner, _ = using_shared(spark)
        assert inner.count() == 5
    outer, _ = using_shared(spark)
    assert outer.count() == 5
    with pytest.raises(Exception, match="destroyed"):
        inner.count()


@pytest.mark.parametrize("place, tables", [(2, 0), (3, 2)])
def test_each_stage_tidies(spark, tmp_path, monkeypatch, place, tables):
    """Mixing writes two tables; the driver is tidied before the stage and after each."""
    calls, batches = [], spark.conf.get(BATCH_SETTING)
    monkeypatch.setattr(corpus_pipeline, "tidy_driver", lambda _: calls.append("driver"))
    monkeypatch.setattr(corpus_pipeline, "tidy_executors", lambda _: calls.append("executors"))
    texts = [(i, f"s{i % 3}", f"one two three {i}") for i in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, source string, text string")
    items = spark.createDataFrame([(1, "a question that no text holds at all")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    _, function = corpus_pipeline.STAGES[place]
    assert function(spark, docs, str(tmp_path)).count() >= 30
    assert sorted(calls) == ["driver"] * (1 + tables) + ["executors"]
    assert spark.conf.get(BATCH_SETTING) == batches
