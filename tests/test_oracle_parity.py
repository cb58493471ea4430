"""Every registered query equals its SQL oracle (DuckDB) on the small test
tables: same column names, same rows (order-insensitive)."""

import pytest

import __spark_entry__ as E
from ledgermart.plans.catalog import QUERIES
from tests.helpers import duck, oracle_rows, rows_of

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    """Of the library's own queries; optional subpackages test what SQL cannot express themselves."""
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols, got = rows_of(df)
    ocols, want = oracle_rows(con, E.oracle_sql()[name])
    assert cols == ocols
    assert len(got) == len(want)
    assert got == want


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "npl_ratio_pct" in df.columns
