"""Plan checks: no Python in any plan, no unpartitioned windows over data,
pruned scans, predicates below aggregates, bounded broadcasts."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")
# the only unpartitioned window: running offsets over one row per range
# partition in key assignment (L7), used by the history operators too
SMALL_WINDOWS_OK = {"append_new_accounts", "scd1_customer_upsert", "scd2_customer_apply", "scd2_history_splice"}   # all by L7


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_python_and_no_global_window(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    plan = physical(df)
    for node in PYTHON_NODES:
        assert node not in plan, f"{name}: {node}"
    allowed = 1 if name in SMALL_WINDOWS_OK else 0
    assert len(unpartitioned_windows(plan)) <= allowed, f"{name}: unpartitioned window"


def unpartitioned_windows(plan: str) -> list[str]:
    """Window nodes print ``Window [exprs], [partition], [order]``; without a
    partition spec only two lists follow."""
    return [line for line in plan.splitlines() if "Window [" in line and line.count("], [") < 2]


def test_window_check_sees_the_bounded_offset_window(spark):
    # negative control: L7's window over one row per range partition is found
    plan = physical(E.queries()["append_new_accounts"](spark, SF_SMALL))
    assert len(unpartitioned_windows(plan)) == 1


def test_scans_are_pruned(spark):
    plan = physical(E.queries()["credit_risk_portfolio"](spark, SF_SMALL))
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*)", plan)
    orders = [s for s in schemas if s.startswith("struct<o_orderkey")]
    assert orders and all(s == "struct<o_orderkey:bigint,o_custkey:bigint>" for s in orders)
    assert all("l_comment" not in s and "l_quantity" not in s for s in schemas)


def _below(plan: str, upper: str, lower_pattern: str) -> bool:
    lines = plan.splitlines()
    up = next(i for i, line in enumerate(lines) if upper in line)
    return any(re.search(lower_pattern, line) for line in lines[up + 1:])


def test_severity_filter_reaches_the_fact_below_the_aggregate(spark):
    plan = optimized(E.queries()["aml_high_severity"](spark, SF_SMALL))
    assert _below(plan, "Aggregate", r"Filter .*% 4\) = 2\)")


def test_one_day_credit_risk_filters_the_date_dimension(spark):
    plan = optimized(E.queries()["credit_risk_latest_date"](spark, SF_SMALL))
    assert _below(plan, "Aggregate", r"Filter .*scalar-subquery")


def test_bounded_dimensions_are_broadcast_even_without_statistics(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(E.queries()["payments_analytics"](spark, SF_SMALL))
        # date and currency are hinted; branch and geography are not
        assert plan.count("BroadcastHashJoin") == 2
        assert "SortMergeJoin" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))


def test_customer_mart_distinct_counts_need_no_expand(spark):
    plan = physical(E.queries()["customer_360"](spark, SF_SMALL))
    assert "Expand" not in plan


def test_marts_run_on_tables_with_every_declared_column(spark, frames):
    """Stored tables carry all declared columns (the loan fact has its own
    ``loan_type``, for instance); the marts must not trip over them and must
    give the same rows as on the narrow test frames."""
    from ledgermart.plans.governance import GOVERNANCE
    from ledgermart.plans.marts import MARTS
    from ledgermart.sources import load
    from ledgermart.sources import schemas as S
    def rows(df):      # declared types may differ (a natural key is text there): compare as text
        cols = sorted(df.columns)
        return cols, sorted("|".join(str(r[c]) for c in cols) for r in df.select(*cols).collect())

    wide = {t: (load.conform(frames[t], t) if t in S.TABLES else frames[t]) for t in frames}
    for name, fn in {**MARTS, **GOVERNANCE}.items():
        assert rows(fn(wide)) == rows(fn(frames)), name


def test_one_scan_of_the_fact_over_stored_tables(spark, frames, tmp_path):
    """Over stored tables the credit-risk mart reads the loan fact once, with
    only the columns it needs, and the payments mart reads its fact once."""
    from ledgermart.plans import marts
    stored = {}
    for t in ("dim_date", "dim_customer", "dim_product", "fact_loan_daily_snapshot", "fact_payment_order",
              "dim_geography", "dim_branch", "dim_currency"):
        frames[t].write.parquet(str(tmp_path / t))
        stored[t] = spark.read.parquet(str(tmp_path / t))
    # a fact scan is recognised by a column only that fact has (long node strings are truncated)
    for mart, marker in (("credit_risk_portfolio", "ifrs9_stage#"), ("payments_analytics", "payment_type#")):
        plan = physical(marts.MARTS[mart](stored))
        scans = [line for line in plan.splitlines() if "FileScan parquet" in line and marker in line]
        assert len(scans) == 1, (mart, scans)
    plan = physical(marts.credit_risk_portfolio(stored))
    line = next(x for x in plan.splitlines() if "FileScan parquet" in x and "ifrs9_stage#" in x)
    read_columns = line.split("FileScan parquet [", 1)[1].split("]", 1)[0]
    assert "account_sk" not in read_columns                      # pruned: the mart does not read it
