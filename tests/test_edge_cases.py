"""Hand-made edge rows (FIXTURES.md section 2, X1-X25)."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgermart.functions import metrics
from ledgermart.operators import derive, history, joins, quality
from ledgermart.plans import governance, marts
from ledgermart.sources import load


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------ frames

def base_frames(spark):
    """A minimal bank: two currencies with open rates, three customers."""
    return {
        "dim_customer": df(spark, [
            (1, 1, "C1", "A", "INDIVIDUAL", "RETAIL", "18-24", "LOW", "VERIFIED", False, "BRANCH",
             dt.date(2020, 1, 1), D("1.0"), 0, 1, True),
            (2, 2, "C2", "B", "INDIVIDUAL", "RETAIL", "18-24", "LOW", "VERIFIED", False, "BRANCH",
             dt.date(2020, 1, 1), D("1.0"), 0, 1, True),
            (3, 3, "C3", "C", "INDIVIDUAL", "SME", "18-24", "LOW", "VERIFIED", False, "BRANCH",
             dt.date(2020, 1, 1), D("1.0"), 0, 1, True),
            (103, 3, "C3", "C", "INDIVIDUAL", "OLD", "18-24", "LOW", "VERIFIED", False, "BRANCH",
             dt.date(2020, 1, 1), D("1.0"), 0, 1, False),
        ], "customer_sk long, customer_nk long, customer_number string, full_name string, customer_type string, "
           "customer_segment string, age_band string, risk_rating string, kyc_status string, pep_flag boolean, "
           "acquisition_channel string, acquisition_date date, relationship_tenure_yrs decimal(5,1), "
           "nationality_country_sk int, residency_country_sk int, is_current_record boolean"),
        "dim_geography": df(spark, [(0, "A-land", "R", "LOW", True), (1, "B-land", "R", "HIGH", True)],
                            "geography_sk int, country_name string, region string, aml_risk_rating string, "
                            "is_current_record boolean"),
        "dim_currency": df(spark, [(0, "USD"), (1, "EUR"), (2, "JPY")], "currency_sk int, currency_code string"),
        "exchange_rate": df(spark, [("USD", "USD", "MID_RATE", D("1"), None),
                                    ("EUR", "USD", "MID_RATE", D("1.5"), None),
                                    ("EUR", "USD", "MID_RATE", D("9"), dt.datetime(2000, 1, 1))],
                            "from_currency_code string, to_currency_code string, rate_type string, "
                            "rate_value decimal(15,8), valid_to_datetime timestamp_ntz"),
        "dim_account": df(spark, [(10, 1, 0, "CURRENT", True), (11, 1, 1, "SAVINGS", True),
                                  (20, 2, 2, "LOAN", True), (21, 2, 0, "CURRENT", True)],
                          "account_sk long, customer_sk long, currency_sk long, account_type string, "
                          "is_current_record boolean"),
        "fact_account_balance_daily": df(spark, [(10, 20241231, D("100.00")), (11, 20241231, D("10.00")),
                                                 (20, 20241231, D("5.00")), (21, 20241130, D("7.00"))],
                                         "account_sk long, snapshot_date_sk int, current_balance decimal(20,2)"),
    }


# ------------------------------------------------------------------ X1

def test_x1_partition_bounds(spark):
    ranges = load.year_ranges(2022, 2025)
    keys = [20211231, 20220101, 20221231, 20230101, 20251231, 20260101]
    t = df(spark, [(k,) for k in keys], "booking_date_sk int")
    got = [r.booking_year for r in load.with_partition_label(t, "booking_date_sk", ranges).collect()]
    assert got == ["default", "2022", "2022", "2023", "2025", "default"]


def test_l5_l6_write_and_prune(spark, tmp_path):
    ranges = load.year_ranges(2022, 2025)
    keys = [20211231, 20220101, 20221231, 20230101, 20251231, 20260101, 20230615]
    t = df(spark, [(k, i) for i, k in enumerate(keys)], "booking_date_sk int, v int")
    path = str(tmp_path / "fact_transaction")
    load.write_range_partitioned(t, path, "booking_date_sk", ranges)
    back = spark.read.parquet(path)
    assert sorted(r.booking_year for r in back.select("booking_year").distinct().collect()) == \
        ["2022", "2023", "2025", "default"]
    inside = load.prune_by_date_key(back, "booking_date_sk", 20230101, 20230630, ranges)
    assert sorted(r.booking_date_sk for r in inside.collect()) == [20230101, 20230615]
    plan = inside._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "booking_year" in plan
    # an interval reaching outside the named years keeps the default folder
    outside = load.prune_by_date_key(back, "booking_date_sk", 20211201, 20220101, ranges)
    assert sorted(r.booking_date_sk for r in outside.collect()) == [20211231, 20220101]


# ------------------------------------------------------------------ X2, X10

def test_x2_closed_version_drops_from_credit_risk_but_stays_in_alerts(spark):
    f = base_frames(spark)
    f["dim_date"] = df(spark, [(20241231, dt.date(2024, 12, 31))], "date_sk int, full_date date")
    f["dim_product"] = df(spark, [(1, "MORTGAGE")], "product_sk long, product_sub_category string")
    f["fact_loan_daily_snapshot"] = df(spark, [
        (20241231, 1, 1, D("100.00"), D("1.00"), D("0.01"), D("0.45"), None, "A", 1, "0", False),
        (20241231, 103, 1, D("50.00"), D("1.00"), D("0.01"), D("0.45"), None, "A", 1, "0", False),
    ], "snapshot_date_sk int, customer_sk long, product_sk long, total_outstanding_rcy decimal(20,2), "
       "ecl_provision_amount decimal(20,2), ecl_pd decimal(8,6), ecl_lgd decimal(8,6), "
       "loan_to_value_ratio decimal(6,4), credit_grade string, ifrs9_stage int, dpd_bucket string, is_npl_flag boolean")
    cr = marts.credit_risk_portfolio(f).collect()
    assert len(cr) == 1 and cr[0].loan_count == 1 and cr[0].total_exposure_usd == D("100.00")
    assert cr[0].avg_ltv is None
    f["dim_aml_rule"] = df(spark, [(0, "R0", "CAT")], "aml_rule_sk long, rule_name string, rule_category string")
    f["dim_branch"] = df(spark, [(0, "B0", "EU", True)], "branch_sk long, branch_name string, region_name string, "
                                                          "is_current_record boolean")
    f["fact_aml_alert"] = df(spark, [
        (20241231, 103, 0, 0, "T", "HIGH", "OPEN", "RULE", D("1"), D("5.00"), 1, None, True, False),
        (20241231, 999, 77, 77, "T", "HIGH", "OPEN", "RULE", D("3"), D("5.00"), 3, 2, None, None),
    ], "generated_date_sk int, subject_customer_sk long, branch_sk long, aml_rule_sk long, alert_type string, "
       "alert_severity string, alert_status string, generated_by string, ml_risk_score decimal(5,2), "
       "alert_amount_rcy decimal(20,2), days_to_assign int, days_to_close int, is_false_positive boolean, "
       "is_sar_filed boolean")
    aml = {(r.rule_name, r.customer_segment, r.region_name): r for r in marts.aml_compliance(f).collect()}
    closed = aml[("R0", None, "EU")]             # closed customer version: NULL segment, kept
    assert closed.alert_count == 1 and closed.false_positive_count == 1
    unknown = aml[(None, None, None)]            # X10: no rule, customer or branch: one NULL group
    assert unknown.alert_count == 1 and unknown.false_positive_count == 0
    assert unknown.false_positive_rate_pct == D("0.00") and unknown.avg_days_to_close == 2.0


# ------------------------------------------------------------------ X3-X6

def test_x3_to_x6_customer_360(spark):
    f = base_frames(spark)
    rows = {r.customer_sk: r for r in marts.customer_360(f).collect()}
    assert set(rows) == {1, 2, 3}                           # current versions only
    c1 = rows[1]                                            # 100*1 + 10*1.5
    assert c1.total_accounts == 2 and c1.current_accounts == 1 and c1.savings_accounts == 1
    assert c1.total_balance_usd == D("115.0000000000") and c1.latest_snapshot_date_sk == 20241231
    c2 = rows[2]   # X3: JPY has no open rate -> term skipped; X5: account 21 has no row on the latest date
    assert c2.total_accounts == 2 and c2.loan_accounts == 1
    assert c2.total_balance_usd is None and c2.latest_snapshot_date_sk == 20241231
    c3 = rows[3]                                            # X6: no account
    assert (c3.total_accounts, c3.current_accounts, c3.credit_cards) == (0, 0, 0)
    assert c3.total_balance_usd is None and c3.latest_snapshot_date_sk is None
    assert c3.nationality == "A-land" and c3.residency_country == "B-land"


def test_x4_two_open_rates_double_and_are_reported(spark):
    f = base_frames(spark)
    f["exchange_rate"] = f["exchange_rate"].unionByName(
        df(spark, [("USD", "USD", "MID_RATE", D("1"), None)], f["exchange_rate"].schema))
    c1 = [r for r in marts.customer_360(f).collect() if r.customer_sk == 1][0]
    assert c1.total_balance_usd == D("215.0000000000")      # 100 counted twice, as in the reference
    fan = quality.rate_fanout_check(f["exchange_rate"]).collect()
    assert [(r.from_currency_code, r.cnt) for r in fan] == [("USD", 2)]


# ------------------------------------------------------------------ X7, X8

def test_x7_x8_financial_performance_growth_and_budget(spark):
    rows = [(1, 50, None, None), (2, 50, 0, 1000), (3, 50, -100, 1000), (4, 50, 100, None)]
    f = {
        "dim_date": df(spark, [(20241231, 2024, 12, "December", 2024, 4)],
                       "date_sk int, calendar_year int, month_num int, month_name string, fiscal_year int, "
                       "fiscal_quarter int"),
        "dim_gl_account": df(spark, [(k, f"L{k}", "x", "ASSET", "ON") for k, *_ in rows],
                             "gl_account_sk long, level1_name string, level2_name string, account_class string, "
                             "account_type string"),
        "dim_branch": df(spark, [(1, "B", "EU", True)], "branch_sk long, branch_name string, region_name string, "
                                                         "is_current_record boolean"),
        "fact_gl_balance": df(spark, [(20241231, k, 1, "MONTHLY", D(c), D(c), None if b is None else D(b),
                                       None if p is None else D(p)) for k, c, p, b in rows]
                              + [(20241231, 1, 1, "QUARTERLY", D(999), D(999), None, None)],
                              "period_end_date_sk int, gl_account_sk long, branch_sk long, period_type string, "
                              "closing_balance_rcy decimal(22,2), ytd_balance decimal(22,2), "
                              "budget_amount decimal(22,2), prior_year_balance decimal(22,2)"),
    }
    got = {r.p_and_l_category: r for r in marts.financial_performance(f).collect()}
    assert got["L1"].yoy_growth_pct is None and got["L1"].closing_balance_usd == D("50.00")   # NULL base, quarter dropped
    assert got["L2"].yoy_growth_pct is None                  # zero base
    assert got["L3"].yoy_growth_pct == D("150.00")           # (50 - -100) / |-100|
    assert got["L4"].yoy_growth_pct == D("-50.00")
    assert got["L1"].budget_usd is None and got["L1"].variance_vs_budget == D("50.00")   # X8


# ------------------------------------------------------------------ X9, X18

def test_x9_null_flag_counts_as_no(spark):
    t = df(spark, [(None,), (True,), (False,)], "is_stp boolean")
    r = t.agg(metrics.count_pct(metrics.cond_count(F.col("is_stp")), F.count(F.lit(1))).alias("p")).first()
    assert r.p == D("33.33")


def test_x18_single_rounding(spark):
    t = df(spark, [(D("1249996"), D("1000000000"))], "n decimal(20,0), d decimal(20,0)")
    r = t.select(metrics.safe_pct(F.col("n"), F.col("d")).alias("p"),
                 metrics.count_pct(F.col("n"), F.col("d")).alias("q")).first()
    assert r.p == D("0.12") and r.q == D("0.12")


# ------------------------------------------------------------------ X11, X12

def test_x11_null_and_unknown_keys_are_orphans(spark):
    facts = df(spark, [(None,), (999,), (10,)], "account_sk long")
    dim = df(spark, [(10,)], "account_sk long")
    assert quality.orphan_check(facts, dim, "account_sk", "account_sk").first().orphan_rows == 2
    f = {"fact_transaction": facts, "dim_account": dim}
    assert governance.orphan_transactions(f).first().orphan_transactions == 2
    suite = quality.soft_key_suite(f, [("fact_transaction", "account_sk", "dim_account", "account_sk")]).first()
    assert (suite.orphan_rows, suite.null_fk_rows) == (1, 1)


def test_x12_duplicate_current_rows(spark):
    f = base_frames(spark)
    extra = f["dim_customer"].filter("customer_sk = 1").withColumn("customer_sk", F.lit(500).cast("long"))
    f["dim_customer"] = f["dim_customer"].unionByName(extra)
    got = [(r.customer_nk, r.cnt) for r in governance.duplicate_current_customers(f).collect()]
    assert got == [(1, 2)]


# ------------------------------------------------------------------ X13, X14, Q10

def test_x13_x14_rejections_with_reasons(spark):
    raw = df(spark, [
        ("USA", "United States", "LOW"),
        (None, "Nowhere", "LOW"),                # NOT NULL
        ("GBR", "x" * 101, None),                # too long; NULL domain value passes
        ("FRA", "France", "PURPLE"),             # outside the allowed values
    ], "country_code string, country_name string, aml_risk_rating string")
    good, bad = quality.split_valid(raw, "country")
    assert good.count() == 1 and good.count() + bad.count() == raw.count()
    reasons = {r.country_name[:7]: r.reject_reasons for r in bad.collect()}
    assert reasons["Nowhere"] == ["not_null:country_code"]
    assert reasons["xxxxxxx"] == ["fit:country_name"]
    assert reasons["France"] == ["domain:aml_risk_rating"]
    prof = {(r.column_name, r.rule): r.failing_rows for r in quality.column_profile(raw, "country").collect()}
    assert prof[("country_code", "not_null")] == 1 and prof[("aml_risk_rating", "domain")] == 1
    with pytest.raises(Exception):
        quality.split_valid(raw, "country", strict=True)[0].count()


# ------------------------------------------------------------------ X15, L2, L3

def test_x15_defaults_only_for_missing_columns(spark):
    present = df(spark, [(1, 2, None)], "account_sk long, customer_sk long, ownership_weight decimal(5,2)")
    absent = df(spark, [(1, 2)], "account_sk long, customer_sk long")
    a = load.fill_defaults(present, "bridge_account_customer", load_date="2024-01-01").first()
    b = load.fill_defaults(absent, "bridge_account_customer", load_date="2024-01-01").first()
    assert a.ownership_weight is None
    assert b.ownership_weight == D("100.00") and b.is_current is True
    c = load.fill_defaults(df(spark, [(1,)], "customer_sk long"), "dim_customer", load_date="2024-01-01").first()
    assert c.effective_from_date == dt.date(2024, 1, 1) and c.is_current_record is True
    assert c.dw_source_system == "CBS" and c.pep_flag is False


def test_l2_read_conforms_types_and_reports_misfits(spark, tmp_path):
    path = str(tmp_path / "ccy.csv")
    spark.createDataFrame([("EUR ", "Euro", "2"), ("XXX", "Bad", "many")],
                          "currency_code string, currency_name string, minor_unit_decimals string") \
        .write.option("header", True).csv(path)
    got = load.read_table(spark, path, "currency", fmt="csv", options={"header": "true"})
    assert [(f.name, f.dataType.simpleString()) for f in got.schema.fields] == [
        ("currency_code", "string"), ("currency_name", "string"), ("minor_unit_decimals", "smallint")]
    assert load.fill_defaults(got, "currency").first().is_active is True      # absent, so defaulted
    rows = {r.currency_name: r for r in got.collect()}
    assert rows["Euro"].currency_code == "EUR" and rows["Euro"].minor_unit_decimals == 2
    assert rows["Bad"].minor_unit_decimals is None
    raw = spark.read.option("header", True).csv(path)
    bad = load.misfits(raw, "currency").collect()
    assert [(r.column_name, r.raw_value) for r in bad] == [("minor_unit_decimals", "many")]


# ------------------------------------------------------------------ X16, X17, L7, L8

def test_x16_x17_key_continuation(spark):
    empty = df(spark, [], "k long")
    assert load.key_high_water({"dim_currency": df(spark, [], "currency_sk int")}).first().next_key == 1
    existing = df(spark, [(3,), (7,)], "k long")
    new = df(spark, [("c",), ("a",), ("b",)], "name string")
    got = sorted((r.name, r.k) for r in load.append_with_keys(new, existing, "k", ["name"], 2).collect())
    assert got == [("a", 8), ("b", 9), ("c", 10)]
    got0 = sorted(r.k for r in load.append_with_keys(new, empty, "k", ["name"]).collect())
    assert got0 == [1, 2, 3]


def test_l7_dense_over_many_partitions(spark):
    new = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("v"))
    keyed = load.append_with_keys(new, None, "k", ["v"], num_partitions=9)
    r = keyed.agg(F.min("k"), F.max("k"), F.countDistinct("k"),
                  F.sum(F.when(F.col("k") == F.col("v") + 1, 0).otherwise(1))).first()
    assert tuple(r) == (1, 5000, 5000, 0)


# ------------------------------------------------------------------ X19, X20, H1-H3

def scd_dim(spark):
    return df(spark, [(1, 100, "A", None, dt.date(2020, 1, 1), None, True),
                      (2, 200, None, "x", dt.date(2020, 1, 1), None, True)],
              "sk long, nk long, seg string, other string, effective_from_date date, effective_to_date date, "
              "is_current_record boolean")


def test_x19_x20_scd2_replay_and_nulls(spark):
    dim = scd_dim(spark)
    changes = df(spark, [(100, "B", None), (200, None, "x"), (300, "C", None)], "nk long, seg string, other string")
    once = history.scd2_apply(dim, changes, "nk", "sk", ["seg"], "2024-01-01")
    rows = sorted((r.nk, r.sk, r.seg, r.is_current_record, r.effective_to_date) for r in once.collect())
    assert rows == [(100, 1, "A", False, dt.date(2024, 1, 1)), (100, 3, "B", True, None),
                    (200, 2, None, True, None),                       # NULL -> NULL: no new version
                    (300, 4, "C", True, None)]
    twice = history.scd2_apply(once.cache(), changes, "nk", "sk", ["seg"], "2024-02-01")
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))   # X19
    to_value = df(spark, [(200, "Z", "x")], "nk long, seg string, other string")
    third = history.scd2_apply(once, to_value, "nk", "sk", ["seg"], "2024-03-01")
    assert third.filter("nk = 200 and is_current_record").first().seg == "Z"          # X20
    assert history.scd2_check(third, "nk").count() == 0


def test_h3_finds_planted_faults(spark):
    dim = df(spark, [(1, dt.date(2020, 1, 1), dt.date(2021, 1, 1), False),
                     (1, dt.date(2020, 6, 1), None, True),           # overlaps the first
                     (2, dt.date(2020, 1, 1), None, True),
                     (2, dt.date(2021, 1, 1), None, True),           # two open current rows
                     (3, dt.date(2021, 1, 1), dt.date(2020, 1, 1), False)],   # reversed, no current
             "nk long, effective_from_date date, effective_to_date date, is_current_record boolean")
    got = sorted((r.nk, r.issue) for r in history.scd2_check(dim, "nk").collect())
    assert got == [(1, "overlap"), (2, "multiple_current"), (2, "overlap"), (3, "no_current"), (3, "reversed")]


def test_h1_scd1_upsert(spark):
    dim = df(spark, [(5, 100, "A"), (9, 200, "B")], "sk long, nk long, seg string")
    ch = df(spark, [(100, "X", dt.datetime(2024, 1, 1)), (100, "Y", dt.datetime(2024, 2, 1)),
                    (300, "N", dt.datetime(2024, 1, 1))], "nk long, seg string, ts timestamp_ntz")
    got = sorted(map(tuple, history.scd1_upsert(dim, ch, "nk", "sk", ["seg"], "ts").collect()))
    assert got == [(5, 100, "Y"), (9, 200, "B"), (10, 300, "N")]


# ------------------------------------------------------------------ X21, J10, J11

def test_x21_as_of_boundaries(spark):
    versions = df(spark, [(1, "v1", dt.date(2020, 1, 1), dt.date(2021, 1, 1)), (1, "v2", dt.date(2021, 1, 1), None)],
                  "nk long, ver string, effective_from_date date, effective_to_date date")
    facts = df(spark, [(1, dt.date(2020, 1, 1)), (1, dt.date(2021, 1, 1)), (1, dt.date(2019, 12, 31))],
               "nk long, d date")
    got = sorted((r.d, r.ver) for r in joins.as_of_join(facts, versions, "nk", "nk", "d", {"ver": "ver"}).collect())
    assert got == [(dt.date(2019, 12, 31), None), (dt.date(2020, 1, 1), "v1"), (dt.date(2021, 1, 1), "v2")]


def test_j11_latest_rate_on_or_before(spark):
    rates = df(spark, [("EUR", dt.date(2024, 1, 1), D("1.1")), ("EUR", dt.date(2024, 3, 1), D("1.3"))],
               "ccy string, rate_date date, rate_value decimal(15,8)")
    facts = df(spark, [("EUR", dt.date(2023, 12, 31)), ("EUR", dt.date(2024, 2, 29)), ("EUR", dt.date(2024, 3, 1)),
                       ("EUR", dt.date(2024, 9, 1)), ("GBP", dt.date(2024, 3, 1))], "ccy string, d date")
    got = sorted((r.ccy, r.d, r.rate_value) for r in joins.latest_rate_on_or_before(facts, rates, ["ccy"], "d").collect())
    assert got == [("EUR", dt.date(2023, 12, 31), None), ("EUR", dt.date(2024, 2, 29), D("1.1")),
                   ("EUR", dt.date(2024, 3, 1), D("1.3")), ("EUR", dt.date(2024, 9, 1), D("1.3")),
                   ("GBP", dt.date(2024, 3, 1), None)]


# ------------------------------------------------------------------ X22, X23

def test_x22_buckets(spark):
    vals = [0, 1, 30, 31, 60, 61, 90, 91, 180, 181, None]
    t = df(spark, [(v,) for v in vals], "d int")
    got = [r.b for r in t.select(derive.past_due_bucket("d").alias("b")).collect()]
    assert got == ["0", "1-30", "1-30", "31-60", "31-60", "61-90", "61-90", "91-180", "91-180", "180+", None]


def test_x23_null_order(spark):
    t = df(spark, [(1,), (None,), (3,)], "x int")
    assert [r.x for r in t.orderBy(F.asc_nulls_last("x")).collect()] == [1, 3, None]
    assert [r.x for r in t.orderBy(F.desc_nulls_first("x")).collect()] == [None, 3, 1]


# ------------------------------------------------------------------ X24, H5

def test_x24_milestones_order_and_replay(spark):
    ev = df(spark, [(1, "generated", dt.datetime(2024, 1, 1)), (1, "closed", dt.datetime(2024, 1, 3)),
                    (1, "assigned", dt.datetime(2024, 1, 5)), (1, "assigned", dt.datetime(2024, 1, 2))],
            "alert_id long, milestone string, milestone_ts timestamp_ntz")
    one = history.accumulate_alerts(None, ev).first()
    assert one.assigned_date == dt.date(2024, 1, 2) and one.days_to_assign == 1 and one.days_to_close == 2
    assert one.alert_status == "CLOSED"
    first, second = ev.limit(2), ev.subtract(ev.limit(2))
    snap = history.accumulate_alerts(None, first)
    snap = history.accumulate_alerts(snap, second)
    snap = history.accumulate_alerts(snap, ev)                  # replay everything
    assert tuple(snap.first()) == tuple(one)


# ------------------------------------------------------------------ X25, D7, D8

def test_x25_allocation_and_weights(spark):
    bridge = df(spark, [(1, 10, "PRIMARY", D("60"), True), (1, 11, "JOINT", D("40"), True),
                        (2, 10, "PRIMARY", D("70"), True), (2, 12, "JOINT", D("40"), True)],
                "account_sk long, customer_sk long, role_type string, ownership_weight decimal(5,2), "
                "is_current boolean")
    bal = df(spark, [(1, D("100.00")), (2, D("10.00"))], "account_sk long, current_balance decimal(20,2)")
    got = {r.customer_sk: r.weighted_balance for r in derive.weighted_customer_balance(bal, bridge).collect()}
    assert got[10] + got[11] == D("107.0000") and got[10] == D("67.0000")
    assert [r.account_sk for r in derive.ownership_weight_check(bridge).collect()] == [2]
    coll = df(spark, [(7, D("1000.00"), D("10.00"))], "collateral_sk long, market_value decimal(20,2), "
                                                        "haircut_percentage decimal(5,2)")
    lb = df(spark, [(1, 7, D("60.00")), (2, 7, D("40.00"))], "account_sk long, collateral_sk long, "
                                                              "allocation_percentage decimal(5,2)")
    alloc = {r.account_sk: r.allocated_collateral_value for r in derive.collateral_per_loan(lb, coll).collect()}
    assert alloc == {1: D("540.00"), 2: D("360.00")}            # total kept: 900 eligible
    assert derive.over_allocated_collateral(lb).count() == 0
    over = lb.unionByName(df(spark, [(3, 7, D("1.00"))], lb.schema))
    assert [r.collateral_sk for r in derive.over_allocated_collateral(over).collect()] == [7]


# ------------------------------------------------------------------ D1, D10, L11

def test_d1_calendar_rules(spark):
    dd = derive.build_dim_date(spark, F.lit("2024-02-28").cast("date"), F.lit("2024-03-02").cast("date"),
                               fiscal_start_month=4,
                               holidays=df(spark, [(dt.date(2024, 3, 1),)], "holiday date"))
    rows = {r.full_date: r for r in dd.collect()}
    assert len(rows) == 4
    leap = rows[dt.date(2024, 2, 29)]
    assert leap.prior_year_date_sk == 20230228 and leap.is_month_end and leap.days_in_month == 29
    assert leap.day_of_week_num == 4 and leap.day_of_week_name == "Thursday" and leap.fiscal_month == 11
    assert leap.fiscal_year == 2024 and leap.fiscal_quarter == 4
    fri = rows[dt.date(2024, 3, 1)]
    assert fri.is_public_holiday and not fri.is_bank_working_day
    sat = rows[dt.date(2024, 3, 2)]
    assert sat.is_weekend and not sat.is_bank_working_day and sat.week_of_year == 9


def test_d10_masking(spark):
    t = df(spark, [("Ann", "GB00BANK12345678", dt.date(1990, 5, 17)), (None, None, None)],
           "full_name string, account_number string, date_of_birth date")
    got = derive.mask_pii(t, "s", ["full_name"], ["date_of_birth"], ["account_number"]).collect()
    import hashlib
    assert got[0].full_name == hashlib.sha256(b"sAnn").hexdigest()
    assert got[0].account_number == "5678" and got[0].date_of_birth == dt.date(1990, 1, 1)
    assert tuple(got[1]) == (None, None, None)


def test_l11_dictionary(spark):
    from ledgermart.sources import schemas as S
    d = load.data_dictionary(spark)
    assert d.count() == 399
    pii = sorted(r.column_name for r in d.filter("is_pii and table_name = 'dim_customer'").collect())
    assert pii == ["date_of_birth", "first_name", "full_name", "last_name"]
    assert len(S.TABLES) == 22
    assert S.table_schema("fact_transaction")["booking_date_sk"].metadata["not_null"] is True


# ------------------------------------------------------------------ J6, H4, broadcast check

def test_latest_only_uses_the_global_maximum(spark):
    b = df(spark, [(1, 20240131), (1, 20240229), (2, 20240131)], "account_sk long, snapshot_date_sk int")
    got = sorted(tuple(r) for r in joins.latest_only(b, "snapshot_date_sk").collect())
    assert got == [(1, 20240229)]                 # account 2 has no row on the global latest day


def test_current_and_as_of_views(spark):
    dim = df(spark, [(1, "a", dt.date(2020, 1, 1), dt.date(2021, 1, 1), False),
                     (1, "b", dt.date(2021, 1, 1), None, True), (2, "c", dt.date(2020, 1, 1), None, None)],
             "nk long, v string, effective_from_date date, effective_to_date date, is_current_record boolean")
    assert sorted(r.v for r in history.current_view(dim).collect()) == ["b"]     # NULL flag is not current
    assert sorted(r.v for r in history.as_of_view(dim, "2020-12-31").collect()) == ["a", "c"]
    assert sorted(r.v for r in history.as_of_view(dim, "2021-01-01").collect()) == ["b", "c"]


def test_anti_semi_project_and_single_rule_checks(spark):
    facts = df(spark, [(1,), (2,), (None,)], "k long")
    dim = df(spark, [(1, "x")], "k long, name string")
    assert sorted((r.k is None, r.k) for r in joins.anti_join(facts, dim, "k", "k").collect()) == \
        [(False, 2), (True, None)]
    assert [r.k for r in joins.semi_join(facts, dim, "k", "k").collect()] == [1]
    assert joins.project(dim, {"k": "nationality_sk", "name": "nationality"}).columns == ["nationality_sk", "nationality"]
    raw = df(spark, [("USA", "x" * 101, "PURPLE")], "country_code string, country_name string, aml_risk_rating string")
    assert [r.failing_rows for r in quality.domain_check(raw, "country").collect()] == [1]
    fit = {r.column_name: r.failing_rows for r in quality.fit_check(raw, "country").collect()}
    assert fit["country_name"] == 1 and fit["country_code"] == 0


def test_date_key_helpers(spark):
    from ledgermart.functions.keys import key_to_date, key_year
    t = df(spark, [(20240229,), (20230229,)], "k int")
    got = [(r.d, r.y) for r in t.select(key_to_date(F.col("k")).alias("d"), key_year(F.col("k")).alias("y")).collect()]
    assert got == [(dt.date(2024, 2, 29), 2024), (None, 2023)]


def test_bands(spark):
    t = df(spark, [(dt.date(2006, 1, 2),), (dt.date(2006, 1, 1),), (dt.date(1950, 6, 1),), (None,)], "dob date")
    got = [r.b for r in t.select(derive.age_band("dob", F.lit("2024-01-01").cast("date")).alias("b")).collect()]
    assert got == [None, "18-24", "65+", None]          # 17 the day before the 18th birthday: below all bands
    inc = df(spark, [(0.0,), (25000.0,), (1e6,)], "x double")
    edges = [(0, "LOW"), (25000, "MID"), (100000, "HIGH")]
    assert [r.b for r in inc.select(derive.band("x", edges).alias("b")).collect()] == ["LOW", "MID", "HIGH"]


def test_scd2_new_version_copies_attributes_the_change_lacks(spark):
    dim = scd_dim(spark)
    changes = df(spark, [(100, "B")], "nk long, seg string")        # no 'other' column in the batch
    dim2 = df(spark, [(1, 100, "A", "keep-me", dt.date(2020, 1, 1), None, True)], dim.schema)
    out = history.scd2_apply(dim2, changes, "nk", "sk", ["seg"], "2024-01-01")
    new = out.filter("is_current_record").first()
    assert (new.seg, new.other, new.effective_from_date) == ("B", "keep-me", dt.date(2024, 1, 1))
    fresh = history.scd2_apply(dim2, df(spark, [(7, "N")], "nk long, seg string"), "nk", "sk", ["seg"], "2024-01-01")
    assert fresh.filter("nk = 7").first().other is None


def test_l2_json_source(spark, tmp_path):
    path = tmp_path / "rates.json"
    path.write_text('{"from_currency_code": "EUR ", "to_currency_code": "USD", "rate_type": "MID_RATE", '
                    '"rate_value": 1.10000001, "extra": 1}\n'
                    '{"from_currency_code": "GBP", "to_currency_code": "USD", "rate_type": "MID_RATE", '
                    '"rate_value": "n/a"}\n')
    got = load.read_table(spark, str(path), "exchange_rate", fmt="json")
    rows = {r.from_currency_code: r for r in got.collect()}
    assert rows["EUR"].rate_value == D("1.10000001") and rows["GBP"].rate_value is None   # misfit -> NULL
    assert "extra" not in got.columns and got.schema["rate_value"].dataType.simpleString() == "decimal(15,8)"


def test_d9_ytd_restarts_at_the_fiscal_year(spark):
    rows = [(20240229, D("10")), (20240331, D("20")), (20240430, D("30")), (20240531, D("40")), (20250430, D("5"))]
    gl = df(spark, [(7, 1, k, "MONTHLY", v, None) for k, v in rows],
            "gl_account_sk long, branch_sk long, period_end_date_sk int, period_type string, "
            "closing_balance_rcy decimal(22,2), budget_amount decimal(22,2)")
    got = {r.period_end_date_sk: r for r in derive.gl_roll_forward(gl, fiscal_start_month=4).collect()}
    assert got[20240331].ytd_balance == D("30.00") and got[20240331].fiscal_year == 2024
    assert got[20240430].ytd_balance == D("30.00") and got[20240430].fiscal_year == 2025    # new fiscal year
    assert got[20240531].ytd_balance == D("70.00")
    assert got[20250430].prior_year_closing == D("30") and got[20240430].prior_year_closing is None
    assert got[20240229].variance_vs_budget == D("10.00")
