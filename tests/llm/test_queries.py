"""The registered queries against SQL, and over tables with odd rows."""

import duckdb
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from gridtally.llm import queries
from tests.conftest import TESTDATA
from tests.test_oracle import TABLES, _sorted_rows

FOLDER = f"{TESTDATA}/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    result = queries.QUERIES[name](spark, FOLDER)
    mine = _sorted_rows(result.columns, [tuple(r) for r in result.collect()])
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(names)
    assert mine == _sorted_rows(names, cursor.fetchall())


def test_all_are_registered():
    registered = entry_point.queries()
    numbers = {n.removeprefix("op").split("_")[0] for n in registered if n.startswith("op")}
    assert numbers == {str(n) for n in range(1, 14)}
    assert registered["pipeline"] is corpus_pipeline.run
