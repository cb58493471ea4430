"""Shuffles whose number of partitions follows the input (``session.spread``)."""
import re

import pytest

from tests.conftest import SF_ORACLE, SF_SMALL
from tests.helpers import rows_of
from ledgermart import session
from ledgermart.operators import quality
from ledgermart.plans.catalog import QUERIES


def shuffles(df):
    """(keys, partitions) of every exchange by key in the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [(re.sub(r"#\d+L?", "", k), int(n)) for k, n in re.findall(r"hashpartitioning\((.*?), (\d+)\)", text)]


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(session, "SPREAD_FROM", 0)
    monkeypatch.setattr(session, "SPREAD_BYTES", 4096)


def test_input_bytes_are_those_of_the_files(spark):
    import os
    path = f"{SF_SMALL}/lineitem.parquet"
    df = spark.read.parquet(path)
    assert session.input_bytes(df) == os.path.getsize(path)
    assert session.input_bytes(df.join(spark.read.parquet(path), "l_orderkey")) == os.path.getsize(path)
    assert session.input_bytes(spark.range(5)) == 0
    assert session.spread(df, "l_orderkey") is df    # small: left to Spark


def test_balance_snapshots_partitions_follow_the_input(spark, small_parts):
    """one exchange by account, with more partitions for more lines."""
    small, large = (dict(shuffles(QUERIES["balance_snapshots"](spark, d))) for d in (SF_SMALL, SF_ORACLE))
    assert set(small) == set(large) == {"l_orderkey"}    # the orders are broadcast at these sizes
    assert large["l_orderkey"] > 5 * small["l_orderkey"] > 5 * 4


def test_month_end_balances_partitions_follow_the_input(spark, small_parts):
    """the windows over an account keep the partitions of the lines; the other exchange is the calendar's."""
    small, large = (shuffles(QUERIES["month_end_balances"](spark, d)) for d in (SF_SMALL, SF_ORACLE))
    by_order = [dict(found)["l_orderkey"] for found in (small, large)]
    assert by_order[1] > 5 * by_order[0] > 5 * 4
    assert not any("account_sk" in keys for keys, _ in large)


def test_financial_performance_partitions_follow_the_input(spark, small_parts):
    """the ledger's aggregate and its join with the branches."""
    small, large = (dict(shuffles(QUERIES["financial_performance"](spark, d))) for d in (SF_SMALL, SF_ORACLE))
    for keys in ("period_end_date_sk, gl_account_sk, branch_sk", "branch_sk"):
        assert large[keys] > 5 * small[keys] > 5 * 4


@pytest.mark.parametrize("name", ["balance_snapshots", "month_end_balances", "financial_performance"])
def test_spread_queries_give_the_same_rows(spark, monkeypatch, name):
    plain = rows_of(QUERIES[name](spark, SF_SMALL))
    monkeypatch.setattr(session, "SPREAD_FROM", 0)
    monkeypatch.setattr(session, "SPREAD_BYTES", 4096)
    assert rows_of(QUERIES[name](spark, SF_SMALL)) == plain and plain[1]


@pytest.mark.parametrize("name", ["soft_key_suite", "soft_key_coverage"])
def test_soft_keys_of_facts_are_not_shuffled(spark, small_parts, name):
    """facts look their keys up where they are; nothing is grouped by key value."""
    found = [keys for keys, _ in shuffles(QUERIES[name](spark, SF_SMALL))]
    assert not [k for k in found if k.startswith(("tag", "d_tag"))]
    assert "collateral_sk" not in found    # the share of a loan is not asked for


def test_soft_key_suite_without_bitmaps_gives_the_same_rows(spark, frames, monkeypatch):
    """Keys whose dimension no bitmap fits are counted per value: none, some and all of them."""
    plain = rows_of(quality.soft_key_suite(frames))
    for limit in (0, quality.BITMAP_BYTES, 3 * quality.BITMAP_BYTES):
        monkeypatch.setattr(quality, "BITMAP_BROADCAST", limit)
        assert rows_of(quality.soft_key_suite(frames)) == plain


def test_soft_key_suite_takes_scattered_empty_and_repeated_keys(spark):
    facts = spark.createDataFrame([(1, 10 ** 12), (-5, 7), (None, 10 ** 12 + 1), (32768, None), (32767, 7), (2, 8)], "a_sk long, b_sk long")
    frames = {"f": facts, "a": spark.createDataFrame([(1,), (1,), (-5,), (32768,), (None,)], "a_sk long"),
              "b": spark.createDataFrame([], "b_sk long"), "c": spark.createDataFrame([(10 ** 12, )], "b_sk long")}
    keys = [("f", "a_sk", "a", "a_sk"), ("f", "b_sk", "b", "b_sk"), ("f", "b_sk", "c", "b_sk")]
    got = {(r["fk_column"], r["dim_table"]): (r["orphan_rows"], r["null_fk_rows"]) for r in quality.soft_key_suite(frames, keys).collect()}
    assert got == {("a_sk", "a"): (2, 1), ("b_sk", "b"): (5, 1), ("b_sk", "c"): (4, 1)}


def test_quality_suite_reads_each_table_once_for_rules_and_keys(spark, frames):
    """the lines of the two facts that need their orders are joined once each, not once more for the keys."""
    text = quality.run_suite(frames)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Join LeftOuter, \(o_orderkey#\d+L = l_orderkey", text)) == 2


def test_quality_suite_without_bitmaps_or_with_few_tables(spark, frames, monkeypatch):
    plain = rows_of(quality.run_suite(frames))
    some = rows_of(quality.run_suite(frames, ["fact_payment_order"]))[1]
    keys = [r for r in plain[1] if "foreign_key" in r]
    assert len(keys) > 30 and [r for r in some if "foreign_key" in r] == keys    # every key, whatever is profiled
    monkeypatch.setattr(quality, "BITMAP_BROADCAST", 0)
    assert rows_of(quality.run_suite(frames)) == plain
