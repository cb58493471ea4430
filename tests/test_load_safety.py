"""The load and the alert snapshot lose no data without a word."""

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgermart import jobs
from ledgermart.operators import derive, history, quality
from ledgermart.plans import warehouse
from ledgermart.sources import load, pointer
from ledgermart.sources import schemas as S
from ledgermart.streaming import alerts


def _raw_branches(spark):
    columns = {c.name: None for c in S.columns("dim_branch")}
    assert "branch_sk" in columns
    flag = next(c.name for c in S.columns("dim_branch") if c.dtype == "boolean")
    flags = {c.name: "true" for c in S.columns("dim_branch") if c.dtype == "boolean"}
    good = {k: v for k, v in {"branch_sk": "1", "branch_code": "B1", "branch_name": "One"}.items() if k in columns} | flags
    rows = [good, dict(good, branch_sk="abc"), dict(good, branch_sk="3", **{flag: "maybe"})]
    names = list({k: None for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names)), flag


def test_misfits_are_rejected_with_their_reason_and_kept(spark, tmp_path):
    raw, flag = _raw_branches(spark)
    good, rejected = warehouse.prepare({"dim_branch": raw}, "2024-01-01", "2024-01-01 00:00:00")
    reasons = sorted(r for row in rejected["dim_branch"].collect() for r in row["reject_reasons"] if r.startswith("type:"))
    assert reasons == sorted(["type:branch_sk", f"type:{flag}"])
    out = warehouse.load_warehouse({"dim_branch": raw}, str(tmp_path), 2024, 2024, minimums={"dim_branch": 0})
    assert out["rejected_rows"]["dim_branch"] == out["rejected"]["dim_branch"].count() >= 2
    assert out["rows"]["dim_branch"] + out["rejected_rows"]["dim_branch"] == 3
    assert sorted(r["branch_sk"] for r in good["dim_branch"].collect()) == [1]
    one = raw.filter("branch_sk = 'abc'")   # one misfit, so there is one error to raise
    with pytest.raises(Exception, match="type:branch_sk"):
        warehouse.prepare({"dim_branch": one}, "2024-01-01", "2024-01-01 00:00:00", strict=True)[0]["dim_branch"].count()


def test_short_or_missing_tables_do_not_become_current(spark, tmp_path):
    raw, _ = _raw_branches(spark)
    root = str(tmp_path)
    first = warehouse.load_warehouse({"dim_branch": raw}, root, 2024, 2024, minimums={"dim_branch": 0})["run_id"]
    with pytest.raises(warehouse.LoadVerificationError, match="dim_branch LOW"):
        warehouse.load_warehouse({"dim_branch": raw}, root, 2024, 2024, minimums={"dim_branch": 5})
    with pytest.raises(warehouse.LoadVerificationError, match="dim_customer ERROR"):
        warehouse.load_warehouse({"dim_branch": raw}, root, 2024, 2024)
    assert pointer.current(spark, root) == first


def test_a_corrupt_table_stops_the_command(spark, tmp_path):
    os.makedirs(tmp_path / "src" / "dim_branch")
    (tmp_path / "src" / "dim_branch" / "part-0.parquet").write_bytes(b"garbage")
    with pytest.raises(Exception):
        jobs.main(["--master", "local[4]", "load", "--source", str(tmp_path / "src"), "--root", str(tmp_path / "dw"), "--partial"])
    assert pointer.current(spark, str(tmp_path / "dw")) is None


def test_counts_do_not_stop_at_an_unreadable_table(spark, tmp_path):
    bad = spark.range(3).select(F.raise_error(F.lit("unreadable")).alias("x"))
    got = quality.verified_counts({"a": bad, "b": spark.range(4)}, {"a": 0, "b": 5, "c": 1})
    assert got == [("a", 3, 0, "OK"), ("b", 4, 5, "LOW"), ("c", None, 1, "ERROR")] or got[0] == ("a", None, 0, "ERROR")
    assert {r.table_name: r.status for r in quality.row_count_check({}, {"a": 1}).collect()} == {"a": "ERROR"}


def test_pointer_is_never_missing_and_old_versions_go(spark, tmp_path):
    root = str(tmp_path)
    for n in range(5):
        spark.range(n + 1).write.parquet(f"{root}/run{n}")
        pointer.publish(spark, root, f"run{n}")
        assert pointer.current(spark, root) == f"run{n}"
        pointer.drop_older(spark, root)
    assert [x for x in pointer.folders(spark, root) if x.startswith("run")] == ["run3", "run4"]
    os.makedirs(tmp_path / "_current" / "000000000009")  # a publication that crashed
    assert pointer.current(spark, root) == "run4"


def _events(spark, *rows):
    return spark.createDataFrame([(a, m, dt.datetime(2024, 1, d)) for a, m, d in rows],
                                 "alert_id bigint, milestone string, milestone_ts timestamp_ntz")


def test_a_lost_pointer_does_not_replace_history(spark, tmp_path):
    root = str(tmp_path / "snap")
    alerts.merge_batch(_events(spark, (1, "generated", 1)), 0, root)
    alerts.merge_batch(_events(spark, (2, "generated", 2)), 1, root)
    alerts.merge_batch(_events(spark, (2, "generated", 2)), 1, root)  # replayed
    assert sorted(r.alert_id for r in alerts.current_snapshot(spark, root).collect()) == [1, 2]
    for name in pointer.folders(spark, f"{root}/_current"):
        pointer.delete(spark, f"{root}/_current/{name}")
    with pytest.raises(RuntimeError, match="no complete pointer"):
        alerts.merge_batch(_events(spark, (3, "generated", 3)), 2, root)


def test_calendar_and_holidays_have_no_cap(spark):
    a, b = F.lit(dt.date(1800, 1, 1)), F.lit(dt.date(2250, 12, 31))
    days = derive.build_dim_date(spark, a, b, holidays=derive.holidays_by_rule(spark, F.year(a), F.year(b)))
    got = days.agg(F.count(F.lit(1)), F.min("full_date"), F.max("full_date"),
                   F.sum(F.col("is_public_holiday").cast("int"))).first()
    assert tuple(got) == ((dt.date(2250, 12, 31) - dt.date(1800, 1, 1)).days + 1, dt.date(1800, 1, 1), dt.date(2250, 12, 31), 902)
    assert derive.build_dim_date(spark, b, a).count() == 0


def test_exact_ratio_rounds_away_from_zero(spark):
    d = spark.createDataFrame([(D("-66.68"), D("200.00")), (D("66.68"), D("-200.00")), (D("-66.68"), D("-200.00")), (D("1.00"), D("0.00"))],
                              "n decimal(18,2), d decimal(18,2)")
    got = [r.r for r in d.select(derive.exact_ratio(F.col("n"), F.col("d"), 4).alias("r")).collect()]
    assert got == [D("-0.3334"), D("-0.3334"), D("0.3334"), None]


def test_changes_without_time_and_ties(spark):
    ts = dt.datetime(2024, 1, 1)
    c = spark.createDataFrame([(1, "B", None), (2, "C", ts), (2, "D", ts), (2, "Z", None)], "nk long, seg string, ts timestamp_ntz")
    got = {r.nk: r.seg for r in history.latest_change(c, "nk", ["seg"], "ts").collect()}
    assert got == {1: "B", 2: "D"}
    assert {r.nk: r.seg for r in history.latest_change(c, "nk", ["seg"], None).collect()} == {1: "B", 2: "Z"}


def test_back_dated_changes_write_no_reversed_interval(spark):
    dim = spark.createDataFrame([(10, 1, "A", dt.date(2024, 6, 1), None, True), (11, 2, "A", dt.date(2023, 1, 1), None, True)],
                                "sk long, nk long, seg string, effective_from_date date, effective_to_date date, is_current_record boolean")
    c = spark.createDataFrame([(1, "B"), (2, "B")], "nk long, seg string")
    out = history.scd2_apply(dim, c, "nk", "sk", ["seg"], "2024-01-01")
    assert history.scd2_check(out, "nk").count() == 0
    assert sorted((r.nk, r.seg) for r in out.filter("is_current_record").collect()) == [(1, "A"), (2, "B")]
    assert [r.nk for r in history.back_dated(dim, c, "nk", "2024-01-01").collect()] == [1]


def test_ytd_of_carried_balances_sums_movements(spark):
    rows = [(1, 1, k, "MONTHLY", D("100.00"), None, D("100.00") if k == 20240131 else D("0.00")) for k in (20240131, 20240229, 20240331)]
    gl = spark.createDataFrame(rows, "gl_account_sk long, branch_sk long, period_end_date_sk int, period_type string, "
                                     "closing_balance_rcy decimal(22,2), budget_amount decimal(22,2), net decimal(22,2)")
    got = derive.gl_roll_forward(gl, movement="net").orderBy("period_end_date_sk").collect()
    assert [r.ytd_balance for r in got] == [D("100.00")] * 3


def test_a_far_future_fact_uses_the_last_rate(spark):
    rates = spark.createDataFrame([("EUR", "USD", "MID_RATE", dt.date(2024, 1, 1), D("1.10000000"))],
                                  "from_currency_code string, to_currency_code string, rate_type string, rate_date date, rate_value decimal(15,8)")
    facts = spark.createDataFrame([("EUR", dt.date(9999, 12, 31), D("10.00")), ("EUR", dt.date(2023, 1, 1), D("10.00"))],
                                  "ccy string, day date, amount decimal(20,2)")
    got = derive.to_reporting_ccy(facts, rates, "amount", "ccy", "day").orderBy("day").collect()
    assert [r.amount_reporting_ccy for r in got] == [None, D("11.00")]
