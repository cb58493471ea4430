"""Streaming snapshot maintenance, full refresh and SQL access by name."""

import datetime as dt

from pyspark.sql import functions as F

from ledgermart.operators import history
from ledgermart.plans import marts, views
from ledgermart.sources import load
from ledgermart.sources import pointer
from ledgermart.sources.testviews import alert_milestone_events
from ledgermart.streaming import alerts
from tests.conftest import SF_SMALL


def test_stream_equals_batch_snapshot(spark, tmp_path):
    events = alert_milestone_events(spark, SF_SMALL)
    src = tmp_path / "events"
    # three arrivals; the last repeats the first (a replay)
    parts = events.randomSplit([0.5, 0.5], seed=3)
    for i, p in enumerate([parts[0], parts[1], parts[0]]):
        p.write.mode("overwrite").parquet(str(src / f"batch={i}"))
    stream = spark.readStream.schema(alerts.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    q = alerts.maintain_snapshot(stream, str(tmp_path / "snapshot"), str(tmp_path / "ckpt"), available_now=True)
    q.awaitTermination(300)
    got = alerts.current_snapshot(spark, str(tmp_path / "snapshot"))
    want = history.accumulate_alerts(None, events)
    assert got.count() == want.count() == events.select("alert_id").distinct().count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_streaming_state_form(spark, tmp_path):
    events = alert_milestone_events(spark, SF_SMALL)
    src = tmp_path / "ev"
    events.write.parquet(str(src))
    stream = spark.readStream.schema(alerts.EVENT_SCHEMA).parquet(str(src))
    q = (alerts.milestone_state(stream).writeStream.outputMode("update").format("memory")
         .queryName("alert_state").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True)
         .start())
    q.awaitTermination(300)
    got = spark.table("alert_state")
    want = history.accumulate_alerts(None, events)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_full_refresh_switches_only_after_success(spark, tmp_path):
    root = str(tmp_path / "dw")
    a = spark.createDataFrame([(1, "USD")], "currency_sk int, currency_code string")
    b = spark.createDataFrame([(20240101, 5)], "booking_date_sk int, v int")
    run1 = load.full_refresh({"dim_currency": a, "fact_transaction": b}, root,
                             partitioned={"fact_transaction": ("booking_date_sk", load.year_ranges(2022, 2025))})
    assert load.read_current(spark, root, "dim_currency").count() == 1
    assert str(load.read_current(spark, root, "fact_transaction").first().booking_year) == "2024"
    bad = spark.createDataFrame([(1,)], "x int").select(F.raise_error(F.lit("boom")).alias("x"))
    try:
        load.full_refresh({"dim_currency": a, "fact_transaction": bad}, root)
    except Exception:
        pass
    run = pointer.current(spark, root)
    assert run == run1                                   # the failed run never became current


def test_views_by_name_answer_reference_access_patterns(spark, frames):
    names = views.register_marts(spark, frames)
    assert "vw_credit_risk_portfolio" in names and "fact_loan_daily_snapshot" in names
    day = spark.sql("select max(snapshot_date) d from vw_credit_risk_portfolio").first().d
    via_sql = spark.sql(f"select * from vw_credit_risk_portfolio where snapshot_date = date'{day}'")
    via_df = marts.credit_risk_portfolio(frames).filter(F.col("snapshot_date") == F.lit(day))
    assert via_sql.exceptAll(via_df).count() == 0 and via_sql.count() == via_df.count() > 0
    assert spark.sql("select * from vw_customer_360 limit 20").count() == 20
    high = spark.sql("select * from vw_aml_compliance_dashboard where alert_severity = 'HIGH'")
    assert high.count() == marts.aml_compliance(frames).filter("alert_severity = 'HIGH'").count()


def test_statistics_and_analyze(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1)), (2, None, None), (2, "b", None)],
                              "k int, s string, d date")
    st = {r.column_name: r for r in load.collect_statistics(t, "t", exact_distinct=True).collect()}
    assert st["k"].row_count == 3 and st["k"].distinct_count == 2 and st["k"].max_value == "2"
    assert st["s"].null_count == 1 and st["d"].min_value == "2024-01-01"
    path = str(tmp_path / "stats_t")
    t.write.parquet(path)
    spark.sql(f"create table if not exists stats_t using parquet location '{path}'")
    load.analyze_table(spark, "stats_t")
    desc = spark.sql("describe table extended stats_t").filter("col_name = 'Statistics'").first()
    assert desc is not None and "3 rows" in desc.data_type


def test_bucketed_fact_and_dimension_join_without_exchange(spark, tmp_path):
    from ledgermart.sources.testviews import dim_customer, fact_loan_daily_snapshot
    loans = fact_loan_daily_snapshot(spark, "/root/testdata/sf0.001")
    cust = dim_customer(spark, "/root/testdata/sf0.001").filter("is_current_record")
    load.write_bucketed(loans, "b_loans", ["customer_sk"], 8, str(tmp_path / "b_loans"))
    load.write_bucketed(cust, "b_customers", ["customer_sk"], 8, str(tmp_path / "b_customers"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        j = spark.table("b_loans").join(spark.table("b_customers").select("customer_sk", "customer_segment"),
                                        "customer_sk")
        plan = j._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = loans.join(cust.select("customer_sk", "customer_segment"), "customer_sk")
        assert j.count() == want.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", old)


def test_load_job_end_to_end(spark, frames, tmp_path):
    from ledgermart.plans import warehouse
    from ledgermart.sources import schemas as S
    out = warehouse.load_warehouse(frames, str(tmp_path / "dw"), 1996, 1999, load_date="2024-01-01",
                                   minimums=warehouse.present_minimums(frames))
    rows = out["rows"]
    assert rows["fact_transaction"] == frames["fact_transaction"].count()
    assert all(df.count() == 0 for df in out["rejected"].values()) and not any(out["rejected_rows"].values())
    t = load.read_current(spark, str(tmp_path / "dw"), "fact_transaction")
    assert set(t.columns) >= {c.name for c in S.columns("fact_transaction")} | {"booking_year"}
    r = t.agg(F.min("transaction_sk"), F.max("transaction_sk"), F.countDistinct("transaction_sk")).first()
    assert tuple(r) == (1, rows["fact_transaction"], rows["fact_transaction"])       # dense generated keys
    assert t.filter("fraud_flag is null or fraud_flag").count() == 0          # declared default FALSE
    assert t.filter("fx_rate_applied = 1").count() == t.count()              # declared default 1.000000
    c = load.read_current(spark, str(tmp_path / "dw"), "dim_customer").first()
    assert c.dw_source_system == "CBS" and c.effective_from_date == dt.date(2024, 1, 1)
    nk = {r.table_name: r.next_key for r in out["next_keys"].collect()}
    assert nk["fact_transaction"] == rows["fact_transaction"] + 1
    status = {r.table_name: r.status for r in out["verification"].collect()}
    assert set(status) == set(rows) and set(status.values()) == {"OK"}
    assert ("dim_branch", "manager_employee_sk", "dim_employee") in out["soft_keys_skipped"] or out["soft_keys_skipped"]


def test_command_line_load_and_mart(spark, frames, tmp_path, capsys):
    from ledgermart import jobs
    src = tmp_path / "src"
    for t in ("dim_date", "dim_customer", "dim_product", "fact_loan_daily_snapshot", "dim_currency"):
        frames[t].write.parquet(str(src / t))
    frames["dim_geography"].write.option("header", True).csv(str(tmp_path / "csvsrc" / "dim_geography"))
    root = str(tmp_path / "dw")
    assert jobs.main(["--master", "local[4]", "load", "--source", str(src), "--root", root,
                      "--first-year", "1996", "--last-year", "1999", "--partial"]) == 0
    assert "fact_loan_daily_snapshot" in capsys.readouterr().out
    out = str(tmp_path / "mart")
    assert jobs.main(["--master", "local[4]", "mart", "credit_risk_portfolio", "--root", root, "--out", out]) == 0
    got = spark.read.parquet(out)
    assert got.count() == marts.credit_risk_portfolio(frames).count() > 0
    assert jobs.main(["--master", "local[4]", "load", "--source", str(tmp_path / "csvsrc"), "--format", "csv",
                      "--root", str(tmp_path / "dw2"), "--partial"]) == 0
    assert load.read_current(spark, str(tmp_path / "dw2"), "dim_geography").count() == frames["dim_geography"].count()


def test_load_layout_prunes_history_folders(spark, frames, tmp_path):
    from ledgermart.plans import warehouse
    sub = {t: frames[t] for t in ("dim_customer", "fact_loan_daily_snapshot", "dim_date")}
    out = warehouse.load_warehouse(sub, str(tmp_path / "dw"), 1996, 1999, minimums=dict.fromkeys(sub, 0))
    cust = load.read_current(spark, str(tmp_path / "dw"), "dim_customer")
    cur = cust.filter("is_current_record")
    plan = cur._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "is_current_record" in plan.split("PartitionFilters: [", 1)[1][:200]
    assert cur.count() == frames["dim_customer"].filter("is_current_record").count()
    assert out["rows"]["fact_loan_daily_snapshot"] == frames["fact_loan_daily_snapshot"].count()


def test_one_day_mart_prunes_snapshot_partitions_dynamically(spark, frames, tmp_path):
    from ledgermart.plans import governance, warehouse
    sub = {t: frames[t] for t in ("dim_customer", "fact_loan_daily_snapshot", "dim_date", "dim_product")}
    warehouse.load_warehouse(sub, str(tmp_path / "dw"), 1996, 1999, minimums=dict.fromkeys(sub, 0))
    stored = {t: load.read_current(spark, str(tmp_path / "dw"), t) for t in sub}
    one_day = governance.credit_risk_on_date(stored, "1998-12-31")
    plan = one_day._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert one_day.count() == governance.credit_risk_on_date(frames, "1998-12-31").count() > 0


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    events = alert_milestone_events(spark, SF_SMALL)
    first, second = events.randomSplit([0.6, 0.4], seed=11)
    src, snap, ckpt = tmp_path / "ev", str(tmp_path / "snap"), str(tmp_path / "ck")
    first.write.parquet(str(src / "part=1"))
    stream = lambda: spark.readStream.schema(alerts.EVENT_SCHEMA).parquet(str(src / "*"))
    alerts.maintain_snapshot(stream(), snap, ckpt, available_now=True).awaitTermination(300)
    # the job stops (or its driver is lost); more events arrive; it restarts from the checkpoint
    second.write.parquet(str(src / "part=2"))
    alerts.maintain_snapshot(stream(), snap, ckpt, available_now=True).awaitTermination(300)
    got = alerts.current_snapshot(spark, snap)
    want = history.accumulate_alerts(None, events)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_bucketed_stream_rewrites_only_touched_buckets(spark, tmp_path):
    events = alert_milestone_events(spark, SF_SMALL)
    first, second = events.randomSplit([0.7, 0.3], seed=5)
    src, snap, ckpt = tmp_path / "ev", str(tmp_path / "snap"), str(tmp_path / "ck")
    first.write.parquet(str(src / "part=1"))
    stream = lambda: spark.readStream.schema(alerts.EVENT_SCHEMA).parquet(str(src / "*"))
    alerts.maintain_snapshot(stream(), snap, ckpt, available_now=True, buckets=8).awaitTermination(300)
    import os
    before = {d: os.listdir(os.path.join(snap, d)) for d in os.listdir(snap) if d.startswith("alert_bucket=")}
    # a second batch touching one alert only rewrites that alert's bucket
    one = second.limit(1)
    one.write.parquet(str(src / "part=2"))
    alerts.maintain_snapshot(stream(), snap, ckpt, available_now=True, buckets=8).awaitTermination(300)
    after = {d: os.listdir(os.path.join(snap, d)) for d in os.listdir(snap) if d.startswith("alert_bucket=")}
    changed = [d for d in after if after[d] != before.get(d)]
    assert len(changed) == 1
    got = alerts.read_bucketed_snapshot(spark, snap)
    want = history.accumulate_alerts(None, first.unionByName(one))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
