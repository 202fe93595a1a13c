"""The registered queries and the pipeline on the smallest sample."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))

import corpus_pipeline  # noqa: E402
from tillroll.llm import queries as llm  # noqa: E402

SF_DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no sample data")


def ids(spark, name, column):
    return {r[0] for r in spark.read.parquet(f"{SF_DIR}/{name}.parquet").select(column).collect()}


def test_one_query_for_each_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in llm.queries())
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows(spark, name):
    duck = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        duck.execute(f"create view {path.stem} as select * from '{path}'")
    result = duck.execute(llm.oracle_sql()[name])
    names = [c[0] for c in result.description]
    found = llm.queries()[name](spark, str(SF_DIR)).select(*names).collect()
    assert sorted(map(tuple, found)) == sorted(result.fetchall())


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_whole_tables(spark, name):
    rows = llm.queries()[name](spark, str(SF_DIR)).collect()
    if name.startswith("op1_"):
        assert {r.page_id for r in rows} == ids(spark, "pages", "page_id")
    elif name.startswith("op11_"):
        assert {r.conv_id for r in rows} == ids(spark, "conversations", "conv_id")
    elif name.startswith("op12_"):
        assert {r.query_id for r in rows} == {i for i in ids(spark, "embeddings", "vec_id") if i % 50 == 0}
    elif name.startswith("op13_"):
        assert max(r.rank for r in rows) <= 2000
    elif name.startswith("op2_"):
        assert {r.item_id for r in rows} <= ids(spark, "benchmark", "item_id")
    else:
        assert {r.doc_id for r in rows} == ids(spark, "documents", "doc_id")


def test_pipeline(spark):
    from tillroll.llm import decontamination, mixing, perplexity, simhash

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    benchmark = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    found = [r.doc_id for r in corpus_pipeline.run(spark, str(SF_DIR)).collect()]

    # Each stage by hand, from its operator's full result.
    keep = {r.doc_id for r in perplexity.classify(docs, labels).where("keep").collect()}
    left = docs.where(docs.doc_id.isin(sorted(keep)))
    prints = {r.doc_id: r.fp for r in simhash.fingerprints(left).collect()}
    unique = set()
    groups: dict[int, list[int]] = {}
    for doc in sorted(prints):
        near = {g for g, fps in groups.items() if any((fp ^ prints[doc]) & (2**64 - 1) == 0 or ((fp ^ prints[doc]) & (2**64 - 1)).bit_count() <= 2 for fp in fps)}
        first = min(near, default=doc)
        groups[first] = [prints[doc], *(fp for g in near for fp in groups.pop(g))]
    unique = set(groups)
    texts = {r.doc_id: " ".join(r.text.lower().split()) for r in left.collect()}
    items = [" ".join(r.text.lower().split()) for r in benchmark.collect()]
    clean = {d for d in unique if not any(i in texts[d] for i in items)}
    removed = {r.doc_id for r in decontamination.contaminated(left, benchmark).collect()}
    assert clean == unique - removed
    mixed = mixing.measured(docs.where(docs.doc_id.isin(sorted(clean))))
    rounds = mixing.with_rounds(mixed, mixing.source_plan(mixed)).collect()
    assert sorted(found) == sorted(r.doc_id for r in rounds for _ in range(r.rounds))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
