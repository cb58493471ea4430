"""All queries of the operators: against SQL where SQL can express them,
over test tables, odd tables and empty ones."""

import duckdb
import pytest

from ledgermart.llm.catalog import QUERIES
from ledgermart.llm.sql import ORACLE_SQL
from tests.helpers import oracle_rows, rows_of

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels pages conversations embeddings".split()


def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


@pytest.fixture(params=["sf", "odd", "empty"])
def folder(request, odd, empty):
    return {"sf": SF, "odd": odd, "empty": empty}[request.param]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, folder, name):
    cols, got = rows_of(QUERIES[name](spark, folder))
    want_cols, want = oracle_rows(duck(folder), ORACLE_SQL[name])
    assert cols == want_cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_on_odd_and_empty_tables(spark, odd, empty, name):
    source = "pages" if name.startswith("op2") else "documents"
    assert QUERIES[name](spark, empty).count() == 0
    n = QUERIES[name](spark, odd).count()
    if name.startswith("op11"):
        assert n == 4 * 3  # four usable vectors of three dimensions
    elif not name.startswith("op10"):
        assert n == spark.read.parquet(f"{odd}/{source}.parquet").count()


def test_no_python_on_native_paths(spark):
    for name in ("op3_license_scan", "op7_chat_format", "op9_line_quality"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian")), name
