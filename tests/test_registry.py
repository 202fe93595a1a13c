"""Every registered query against its SQL, on the smallest sample."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402
import oracles  # noqa: E402
import registry  # noqa: E402

SF_DIR = Path(contract.SMOKE_DIR)
QUERIES, ORACLES = registry.queries(), oracles.oracle_sql()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}
pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="no sample data")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF_DIR.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, str(SF_DIR))
    result = duck.execute(ORACLES[name])
    types = {column[0]: str(column[1]) for column in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == types
    names = sorted(types)
    places = [list(types).index(n) for n in names]
    expected = sorted((tuple(row[p] for p in places) for row in result.fetchall()), key=repr)
    found = sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr)
    assert found == expected


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


def test_entry(spark):
    assert contract.entry(spark).count() > 50
