"""Bank-shaped frames over the driver's test tables.

The reference ships schemas without data, so the test tables (TPC-H-like
``region nation customer supplier part orders lineitem events``) are
re-shaped into the bank's dimensions and facts.  Every rule is key
arithmetic, so the planted cases (closed versions, duplicate current
rows, a currency without an open rate, NULL flags and amounts, missing
dimension keys) exist at every scale factor.  The same shapes are written
as portable SQL for the DuckDB oracle in ``oracle/fixture_sql.py``.

Each builder reads only the columns it needs, so the Parquet scan is
pruned; nothing here triggers an action.
"""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermart.functions.keys import date_key
from ledgermart.session import spread

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read_test_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _dec(c: Column | str, p: int, s: int) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal({p},{s})")


def _case(key: Column, labels: list[str]) -> Column:
    """``CASE key WHEN 0 THEN labels[0] ... ELSE labels[-1] END``."""
    expr = None
    for i, label in enumerate(labels[:-1]):
        expr = F.when(key == i, label) if expr is None else expr.when(key == i, label)
    return expr.otherwise(labels[-1])


# fixed values of the test shapes (the fixture's labels, in natural order)
MONTH_NAMES = ["January", "February", "March", "April", "May", "June", "July",
               "August", "September", "October", "November", "December"]
GEO_RISK = ["LOW", "MEDIUM", "HIGH", "BLACKLIST"]
CURRENCY_CODES = ["USD", "EUR", "GBP", "JPY", "AED"]
CUSTOMER_TYPES = ["INDIVIDUAL", "ORGANIZATION", "TRUST"]
AGE_BANDS = ["18-24", "25-34", "35-49", "50-64", "65+"]
CUSTOMER_RISK = ["LOW", "MEDIUM", "HIGH", "VERY_HIGH"]
KYC_STATUS = ["VERIFIED", "PENDING", "EXPIRED", "REJECTED"]
GL_CLASSES = ["ASSET", "LIABILITY", "EQUITY", "INCOME", "EXPENSE"]
ACCOUNT_TYPES = ["CURRENT", "SAVINGS", "LOAN", "CREDIT_CARD"]
ALERT_SEVERITY = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
ALERT_STATUS = ["OPEN", "ASSIGNED", "CLOSED"]

CLOSED_KEY_OFFSET = 1_000_000_000      # closed customer versions
DUPLICATE_KEY_OFFSET = 2_000_000_000   # second current row for some customers


def month_name(d: Column) -> Column:
    return _case(F.month(d) - 1, MONTH_NAMES)


def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per calendar day touched by orders, line items (ship day and
    its month end) and events.  Bounded by the calendar, not by the data
    volume: each scan is partially de-duplicated map-side before the
    shuffle, so only distinct days cross the network."""
    li = read_test_table(spark, sf_dir, "lineitem").select(
        F.explode(F.array(F.to_date("l_shipdate"), F.last_day(F.to_date("l_shipdate")))).alias("d"))
    od = read_test_table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"))
    ev = read_test_table(spark, sf_dir, "events").select(F.to_date("ts").alias("d"))
    days = li.unionByName(od).unionByName(ev).distinct()   # one shuffle, partial distinct per task
    d = F.col("d")
    return days.select(
        date_key(d).alias("date_sk"),
        d.alias("full_date"),
        F.year(d).alias("calendar_year"),
        F.month(d).alias("month_num"),
        month_name(d).alias("month_name"),
        F.year(d).alias("fiscal_year"),
        F.quarter(d).alias("fiscal_quarter"),
    )


def dim_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read_test_table(spark, sf_dir, "nation")
    region = read_test_table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    return nation.join(region, F.col("r_regionkey") == F.col("n_regionkey")).select(
        k.alias("geography_sk"),
        F.col("n_name").alias("country_name"),
        F.col("r_name").alias("region"),
        _case(k % 4, GEO_RISK).alias("aml_risk_rating"),
        (k % 7 != 6).alias("is_current_record"),   # key % 7 = 6: closed version only
    )


def dim_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("r_regionkey")
    return read_test_table(spark, sf_dir, "region").select(
        k.alias("currency_sk"), _case(k, CURRENCY_CODES).alias("currency_code"))


def exchange_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per currency: an open MID_RATE (none for JPY), a closed MID_RATE and
    an open SPOT rate; only the first may ever be picked."""
    cur = dim_currency(spark, sf_dir)
    null_ts = F.lit(None).cast("timestamp_ntz")
    open_mid = cur.filter(F.col("currency_sk") != 3).select(
        F.col("currency_code").alias("from_currency_code"),
        F.lit("USD").alias("to_currency_code"),
        F.lit("MID_RATE").alias("rate_type"),
        _dec(1 + _dec("currency_sk", 3, 0) * F.lit(0.12345678).cast("decimal(9,8)"), 15, 8).alias("rate_value"),
        null_ts.alias("valid_to_datetime"))
    closed_mid = cur.select(
        F.col("currency_code").alias("from_currency_code"), F.lit("USD").alias("to_currency_code"),
        F.lit("MID_RATE").alias("rate_type"), F.lit(9).cast("decimal(15,8)").alias("rate_value"),
        F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("valid_to_datetime"))
    spot = cur.select(
        F.col("currency_code").alias("from_currency_code"), F.lit("USD").alias("to_currency_code"),
        F.lit("SPOT").alias("rate_type"), F.lit(8).cast("decimal(15,8)").alias("rate_value"),
        null_ts.alias("valid_to_datetime"))
    return open_mid.unionByName(closed_mid).unionByName(spot)


def dim_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current row per customer; every tenth customer also has a closed
    earlier version under its own key; keys ending 03 or 53 have a second
    current row.  One scan: the versions are generated per input row."""
    cust = read_test_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    versions = F.array_compact(F.array(
        F.lit(0), F.when(k % 10 == 0, F.lit(1)), F.when(k % 50 == 3, F.lit(2))))
    v = F.col("_version")
    closed = v == 1
    return cust.withColumn("_version", F.explode(versions)).select(
        (k + v.cast("bigint") * CLOSED_KEY_OFFSET).alias("customer_sk"),
        k.alias("customer_nk"),
        F.concat(F.lit("C"), F.lpad(k.cast("string"), 9, "0")).alias("customer_number"),
        F.col("c_name").alias("full_name"),
        _case(k % 3, CUSTOMER_TYPES).alias("customer_type"),
        F.when(closed, F.lit("OLD_SEGMENT")).otherwise(F.col("c_mktsegment")).alias("customer_segment"),
        _case(k % 5, AGE_BANDS).alias("age_band"),
        F.when(closed, F.lit("LOW")).otherwise(_case(k % 4, CUSTOMER_RISK)).alias("risk_rating"),
        _case(k % 4, KYC_STATUS).alias("kyc_status"),
        (k % 40 == 1).alias("pep_flag"),
        F.when(k % 2 == 0, F.lit("BRANCH")).otherwise(F.lit("MOBILE")).alias("acquisition_channel"),
        F.date_add(F.lit("2010-01-01").cast("date"), (k % 1000).cast("int")).alias("acquisition_date"),
        _dec(_dec(k % 300, 5, 0) * F.lit(0.1).cast("decimal(2,1)"), 5, 1).alias("relationship_tenure_yrs"),
        F.col("c_nationkey").alias("nationality_country_sk"),
        F.when(v == 0, (F.col("c_nationkey") + 3) % 25).otherwise(F.col("c_nationkey")).alias("residency_country_sk"),
        (~closed).alias("is_current_record"),
    )


def dim_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read_test_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = read_test_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_test_table(spark, sf_dir, "region")
    k = F.col("s_suppkey")
    return (sup.join(nation, F.col("n_nationkey") == F.col("s_nationkey"))
            .join(region, F.col("r_regionkey") == F.col("n_regionkey"))
            .select(k.alias("branch_sk"), F.col("s_name").alias("branch_name"),
                    F.col("r_name").alias("region_name"), (k % 9 != 8).alias("is_current_record")))


def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_test_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_sk"), F.col("p_type").alias("product_sub_category"))


def dim_gl_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart of accounts: the first 33 parts (the ledger facts map every
    line item onto one of these 33 accounts)."""
    k = F.col("p_partkey")
    return read_test_table(spark, sf_dir, "part").filter(k < 33).select(
        k.alias("gl_account_sk"),
        F.col("p_type").alias("level1_name"),
        F.col("p_brand").alias("level2_name"),
        _case(k % 5, GL_CLASSES).alias("account_class"),
        F.when(F.col("p_size") > 25, F.lit("ON_BALANCE")).otherwise(F.lit("OFF_BALANCE")).alias("account_type"),
        (k % 5 == 3).alias("is_interest_income"),
        (k % 5 == 4).alias("is_interest_expense"),
    )


def dim_aml_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules 0..10; alerts also point at rule 11, which is missing on purpose."""
    k = F.col("p_partkey")
    return read_test_table(spark, sf_dir, "part").filter(k < 11).select(
        k.alias("aml_rule_sk"), F.col("p_name").alias("rule_name"), F.col("p_type").alias("rule_category"))


def dim_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account per order; customers with key % 20 = 7 have none;
    currency key 5 has no currency row."""
    o = read_test_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    return o.filter(F.col("o_custkey") % 20 != 7).select(
        k.alias("account_sk"),
        F.col("o_custkey").alias("customer_sk"),
        (k % 6).alias("currency_sk"),
        _case(k % 4, ACCOUNT_TYPES).alias("account_type"),
        (k % 11 != 0).alias("is_current_record"),
    )


def fact_account_balance_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["account_sk", "snapshot_date_sk"]
    li = read_test_table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("account_sk"), (F.year("l_shipdate") * 10000 + 1231).cast("int").alias("snapshot_date_sk"),
        "l_extendedprice")
    return (spread(li, *keys).groupBy(*keys)
            .agg(_dec(F.sum(_dec("l_extendedprice", 20, 2)), 20, 2).alias("current_balance")))


def _lineitem_orders(spark: SparkSession, sf_dir: str, li_cols: list[str]) -> DataFrame:
    # dealt by the order here, so that the join and what is grouped by the
    # order after it has as many tasks as the lines ask for
    li = spread(read_test_table(spark, sf_dir, "lineitem").select(*li_cols), "l_orderkey")
    o = read_test_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # every line has its order, so this equals an inner join
    return li.join(o, F.col("o_orderkey") == F.col("l_orderkey"), "left")


def _fact_customer_sk() -> Column:
    """Facts of every tenth customer's even orders are bound to the closed
    version's key."""
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return F.when((c % 10 == 0) & (o % 2 == 0), c + CLOSED_KEY_OFFSET).otherwise(c)


def fact_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _lineitem_orders(spark, sf_dir, ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate",
                                         "l_extendedprice", "l_returnflag", "l_linestatus"])
    return j.select(
        F.col("l_orderkey").alias("account_sk"),
        _fact_customer_sk().alias("customer_sk"),
        F.col("l_partkey").alias("product_sk"),
        F.col("l_suppkey").alias("branch_sk"),
        date_key(F.col("l_shipdate")).alias("booking_date_sk"),
        F.col("l_shipdate").alias("transaction_datetime"),
        _dec("l_extendedprice", 20, 2).alias("amount_txn_ccy"),
        (F.col("l_returnflag") == "R").alias("is_reversal"),
        (F.col("l_linestatus") == "F").alias("is_credit"),
    )


def dpd_days_from_part(partkey: Column) -> Column:
    return partkey % 200


def fact_loan_daily_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _lineitem_orders(spark, sf_dir, ["l_orderkey", "l_partkey", "l_linenumber", "l_shipdate",
                                         "l_extendedprice", "l_discount", "l_tax", "l_returnflag"])
    dpd = dpd_days_from_part(F.col("l_partkey"))
    return j.select(
        date_key(F.last_day(F.to_date("l_shipdate"))).alias("snapshot_date_sk"),
        F.col("l_orderkey").alias("account_sk"),
        _fact_customer_sk().alias("customer_sk"),
        F.col("l_partkey").alias("product_sk"),
        _dec("l_extendedprice", 20, 2).alias("total_outstanding_rcy"),
        _dec(_dec("l_extendedprice", 14, 2) * _dec("l_discount", 4, 2), 20, 2).alias("ecl_provision_amount"),
        _dec("l_discount", 8, 6).alias("ecl_pd"),
        F.lit(0.45).cast("decimal(8,6)").alias("ecl_lgd"),
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(_dec("l_tax", 6, 4)).alias("loan_to_value_ratio"),
        F.col("l_returnflag").alias("credit_grade"),
        F.when(dpd > 90, 3).when(dpd > 30, 2).otherwise(1).cast("int").alias("ifrs9_stage"),
        F.when(dpd == 0, "0").when(dpd <= 30, "1-30").when(dpd <= 60, "31-60").when(dpd <= 90, "61-90")
         .when(dpd <= 180, "91-180").otherwise("180+").alias("dpd_bucket"),
        (dpd > 90).alias("is_npl_flag"),
    )


def fact_gl_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["period_end_date_sk", "gl_account_sk", "branch_sk"]
    li = read_test_table(spark, sf_dir, "lineitem").select(
        date_key(F.last_day(F.to_date("l_shipdate"))).alias("period_end_date_sk"),
        (F.col("l_partkey") % 33).alias("gl_account_sk"), F.col("l_suppkey").alias("branch_sk"), "l_extendedprice")
    g = spread(li, *keys).groupBy(*keys).agg(_dec(F.sum(_dec("l_extendedprice", 20, 2)), 22, 2).alias("bal"))
    k = F.col("gl_account_sk")
    return g.select(
        "period_end_date_sk", "gl_account_sk", "branch_sk",
        F.when(k % 10 == 9, F.lit("QUARTERLY")).otherwise(F.lit("MONTHLY")).alias("period_type"),
        F.col("bal").alias("closing_balance_rcy"),
        F.col("bal").alias("ytd_balance"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.lit(1000).cast("decimal(22,2)")).alias("budget_amount"),
        F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, F.lit(-2500.5).cast("decimal(22,2)"))
         .otherwise(F.lit(0).cast("decimal(22,2)")).alias("prior_year_balance"),
    )


def fact_payment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_test_table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("payment_nk"),
        date_key(F.col("o_orderdate")).alias("instruction_date_sk"),
        c.alias("debtor_customer_sk"),
        (k % 100).alias("debtor_branch_sk"),
        (k % 6).alias("currency_sk"),
        (c % 26).alias("creditor_country_sk"),
        F.col("o_orderpriority").alias("payment_type"),
        F.col("o_orderstatus").alias("payment_status"),
        F.when(k % 50 == 0, F.lit("HIT")).otherwise(F.lit("CLEAR")).alias("sanctions_screening_status"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(_dec("o_totalprice", 20, 2)).alias("payment_amount_rcy"),
        _dec(_dec("o_totalprice", 14, 2) * F.lit(0.001).cast("decimal(4,3)"), 12, 2).alias("charge_amount"),
        F.when(k % 9 == 0, F.lit(None)).otherwise(k % 3600).cast("int").alias("processing_time_seconds"),
        (k % 3 == 0).alias("is_cross_border"),
        F.when(k % 17 == 0, F.lit(None)).otherwise(k % 5 != 0).alias("is_stp"),
        (F.col("o_orderstatus") == "P").alias("is_rejected"),
    )


def fact_aml_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_test_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    k, u = F.col("event_id"), F.col("user_id")
    return e.select(
        k.alias("aml_alert_sk"),
        date_key(F.col("ts")).alias("generated_date_sk"),
        F.when(u % 10 == 0, u + CLOSED_KEY_OFFSET).otherwise(u).alias("subject_customer_sk"),
        (k % 100).alias("branch_sk"),
        (k % 12).alias("aml_rule_sk"),
        F.col("event_type").alias("alert_type"),
        _case(k % 4, ALERT_SEVERITY).alias("alert_severity"),
        _case(k % 3, ALERT_STATUS).alias("alert_status"),
        F.when(k % 2 == 0, F.lit("RULE")).otherwise(F.lit("MODEL")).alias("generated_by"),
        _dec(k % 100, 5, 2).alias("ml_risk_score"),
        _dec("value", 20, 2).alias("alert_amount_rcy"),
        (k % 5).cast("int").alias("days_to_assign"),
        F.when(k % 3 == 2, (k % 40).cast("int")).alias("days_to_close"),
        (k % 5 == 1).alias("is_false_positive"),
        (k % 7 == 1).alias("is_sar_filed"),
    )


BUILDERS = {
    "dim_date": dim_date,
    "dim_geography": dim_geography,
    "dim_currency": dim_currency,
    "exchange_rate": exchange_rate,
    "dim_customer": dim_customer,
    "dim_branch": dim_branch,
    "dim_product": dim_product,
    "dim_gl_account": dim_gl_account,
    "dim_aml_rule": dim_aml_rule,
    "dim_account": dim_account,
    "fact_account_balance_daily": fact_account_balance_daily,
    "fact_transaction": fact_transaction,
    "fact_loan_daily_snapshot": fact_loan_daily_snapshot,
    "fact_gl_balance": fact_gl_balance,
    "fact_payment_order": fact_payment_order,
    "fact_aml_alert": fact_aml_alert,
}


# ---------------------------------------------------------------------------
# Inputs for the history, derivation and bridge operators (FIXTURES.md,
# "Inputs for operators that need more than these views").  Same rule: key
# arithmetic over the test tables, so the planted cases scale with them.

VERSION_SPLIT = "1998-01-01"      # every tenth customer changes segment here
LATE_START = "1997-01-01"         # customers with key % 20 = 5 start late
OVERLAP_START = "1999-01-01"      # keys % 50 = 3 get an overlapping version
NEW_KEY_OFFSET = 10_000_000       # natural keys of customers new in a batch
SCD_AS_OF = "2002-01-01"


def customer_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type 2 customer history: one open version per customer from
    1990-01-01 (1997-01-01 for key % 20 = 5); key % 10 = 0 changes
    segment on 1998-01-01 (closed version under key + 10^9); key % 50 = 3
    has a second, overlapping open version from 1999-01-01 (a planted
    fault for the history check)."""
    c = read_test_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    k = F.col("c_custkey")
    split = F.lit(VERSION_SPLIT).cast("date")
    versions = F.array_compact(F.array(F.lit(0), F.when(k % 10 == 0, F.lit(1)), F.when(k % 50 == 3, F.lit(2))))
    v = F.col("_v")
    start = F.when(k % 20 == 5, F.lit(LATE_START).cast("date")).otherwise(F.lit("1990-01-01").cast("date"))
    return c.withColumn("_v", F.explode(versions)).select(
        F.when(v == 0, k).otherwise(k + v.cast("bigint") * CLOSED_KEY_OFFSET).alias("customer_sk"),
        k.alias("customer_nk"),
        F.col("c_name").alias("full_name"),
        F.when(v == 1, F.lit("OLD_SEGMENT")).otherwise(F.col("c_mktsegment")).alias("customer_segment"),
        F.col("c_nationkey").alias("nationality_country_sk"),
        F.when(v == 1, start).when(v == 2, F.lit(OVERLAP_START).cast("date"))
         .when(k % 10 == 0, split).otherwise(start).alias("effective_from_date"),
        F.when(v == 1, split).otherwise(F.lit(None).cast("date")).alias("effective_to_date"),
        (v != 1).alias("is_current_record"),
    )


def customer_type1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type 1 customer dimension: surrogate key = natural key = customer key."""
    c = read_test_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return c.select(F.col("c_custkey").alias("customer_sk"), F.col("c_custkey").alias("customer_nk"),
                    F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("customer_segment"),
                    F.col("c_nationkey").alias("nationality_country_sk"))


def customer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change batch: key % 7 = 0 moves to segment PRIVATE; key % 11 = 0
    (and not % 7) arrives unchanged; key % 13 = 0 also yields a brand-new
    customer with natural key + 10^7."""
    c = read_test_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    k = F.col("c_custkey")
    kinds = F.array_compact(F.array(F.when(k % 7 == 0, F.lit(1)), F.when((k % 11 == 0) & (k % 7 != 0), F.lit(2)),
                                    F.when(k % 13 == 0, F.lit(3))))
    kind = F.col("_kind")
    return c.withColumn("_kind", F.explode(kinds)).select(
        F.when(kind == 3, k + NEW_KEY_OFFSET).otherwise(k).alias("customer_nk"),
        F.when(kind == 3, F.concat(F.col("c_name"), F.lit("/new"))).otherwise(F.col("c_name")).alias("full_name"),
        F.when(kind == 1, F.lit("PRIVATE")).otherwise(F.col("c_mktsegment")).alias("customer_segment"),
        F.col("c_nationkey").alias("nationality_country_sk"),
        F.lit("2001-12-31 00:00:00").cast("timestamp_ntz").alias("change_ts"),
    )


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as an employee of the one with a quarter of the key
    (keys below four have no manager).  Planted: key % 41 = 7 has a manager
    who is not there; keys % 100 = 50 and 51 manage each other."""
    k = F.col("c_custkey")
    own = F.call_function("div", k, F.lit(4))
    manager = (F.when(k % 41 == 7, k + 5_000_000).when(k % 100 == 50, k + 1).when(k % 100 == 51, k - 1).when(own > 0, own))
    return read_test_table(spark, sf_dir, "customer").select(k.alias("employee_sk"), manager.alias("manager_employee_sk"))


LEDGER_LEVELS = ["account_class", "level1_name", "level2_name", "level3_name", "level4_name", "level5_name"]


def gl_account_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger accounts with one to five levels (1 + key % 5): the part's
    type, brand, size, name and key; the second level of keys % 7 = 3 has no
    name."""
    p = read_test_table(spark, sf_dir, "part").filter("p_partkey < 33").select("p_partkey", "p_type", "p_brand", "p_size", "p_name")
    k = F.col("p_partkey")
    names = [F.col("p_type"), F.when(k % 7 != 3, F.col("p_brand")), F.col("p_size").cast("string"), F.col("p_name"), k.cast("string")]
    levels = [F.when(1 + k % 5 > i, n).alias(f"level{i + 1}_name") for i, n in enumerate(names)]
    return p.select(k.alias("gl_account_sk"), _case(k % 5, GL_CLASSES).alias("account_class"), *levels)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def customer_order_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as a change of its customer's segment, dated to the first
    of the order's month (so most changes are back-dated and several fall on
    one day): segment by key % 5, hour by key % 24; customers with key % 97
    = 5 appear under a new natural key; orders with key % 101 = 0 have no
    time and no place in the history."""
    o = read_test_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    month = F.trunc(F.to_date("o_orderdate"), "month").cast("timestamp_ntz")
    return o.select(
        F.when(c % 97 == 5, c + NEW_KEY_OFFSET).otherwise(c).alias("customer_nk"),
        _case(k % 5, SEGMENTS).alias("customer_segment"),
        F.when(k % 101 != 0, month + F.make_dt_interval(hours=(k % 24).cast("int"))).alias("change_ts"))


def interval_exchange_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates to USD with validity intervals, one per currency and month of
    the orders.  USD is valid until the 20th (gaps); EUR has none in months
    3, 6, 9, 12; GBP rates of months 1, 5, 9 last three months (overlaps);
    JPY rates are all open (the latest start holds); AED rates start at six
    in the morning, and those of February end before they begin."""
    r = dated_exchange_rate(spark, sf_dir)
    code, month, m = F.col("from_currency_code"), F.month("rate_date"), F.col("rate_date").cast("timestamp_ntz")
    next_month = F.add_months("rate_date", 1).cast("timestamp_ntz")
    six = m + F.make_dt_interval(hours=F.lit(6))
    until = (F.when(code == "USD", m + F.make_dt_interval(days=F.lit(20)))
             .when((code == "GBP") & (month % 4 == 1), F.add_months("rate_date", 3).cast("timestamp_ntz"))
             .when((code == "AED") & (month == 2), m).when(code != "JPY", next_month))
    return r.filter((code != "EUR") | (month % 3 != 0)).select(
        "from_currency_code", "to_currency_code", "rate_type", "rate_value",
        F.when(code == "AED", six).otherwise(m).alias("valid_from_datetime"), until.alias("valid_to_datetime"))


def dated_exchange_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One MID_RATE to USD per currency and month start of the order dates:
    ``1 + sk/10 + month/1000 + (year - 1990)/10000`` to 8 places.  Each
    month row is expanded over the fixture's five currencies (no join)."""
    months = read_test_table(spark, sf_dir, "orders").select(
        F.trunc(F.to_date("o_orderdate"), "month").alias("rate_date")).distinct()
    currencies = F.array(*[F.struct(F.lit(i).alias("sk"), F.lit(code).alias("code"))
                           for i, code in enumerate(CURRENCY_CODES)])
    r = months.select("rate_date", F.explode(currencies).alias("c"))
    units = (F.lit(100_000_000) + F.col("c.sk").cast("bigint") * 10_000_000
             + F.month("rate_date") * 100_000 + (F.year("rate_date") - 1990) * 10_000)
    return r.select(
        F.col("c.code").alias("from_currency_code"), F.lit("USD").alias("to_currency_code"),
        F.lit("MID_RATE").alias("rate_type"), "rate_date",
        (units.cast("decimal(18,0)") * F.lit(Decimal("0.00000001"))).cast("decimal(15,8)").alias("rate_value"))


def transactions_with_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions in their account's currency (NULL when the account or
    the currency row is missing)."""
    t = fact_transaction(spark, sf_dir).select("account_sk", "booking_date_sk", "transaction_datetime",
                                               "amount_txn_ccy")
    a = dim_account(spark, sf_dir).select(F.col("account_sk").alias("a_sk"), "currency_sk")
    cur = F.broadcast(dim_currency(spark, sf_dir))
    return (t.join(a, t["account_sk"] == a["a_sk"], "left").join(cur, "currency_sk", "left")
            .select("account_sk", "booking_date_sk", F.to_date("transaction_datetime").alias("booking_date"),
                    "amount_txn_ccy", "currency_code"))


def dim_collateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collateral per part: market value = retail price x 100, haircut =
    size % 40 percent."""
    p = read_test_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return p.select(F.col("p_partkey").alias("collateral_sk"),
                    (_dec("p_retailprice", 20, 2) * 100).cast("decimal(20,2)").alias("market_value"),
                    (F.col("p_size") % 40).cast("decimal(5,2)").alias("haircut_percentage"))


def bridge_loan_collateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (loan = order, collateral = part) pairs; each collateral is
    allocated evenly over its loans (100 / loans, rounded down to the cent
    so the shares never exceed 100), with 10 points too much for parts
    with key % 50 = 0."""
    li = read_test_table(spark, sf_dir, "lineitem").filter(F.col("l_partkey").isNotNull())
    pairs = spread(li.select(F.col("l_orderkey").alias("account_sk"), F.col("l_partkey").alias("collateral_sk")),
                   "account_sk", "collateral_sk").distinct()
    n = pairs.groupBy("collateral_sk").agg(F.count(F.lit(1)).alias("_n"))
    bp = F.call_function("div", F.lit(10000), F.col("_n"))   # basis points, rounded down
    pct = bp.cast("decimal(18,0)") * F.lit(Decimal("0.01")) + F.when(
        F.col("collateral_sk") % 50 == 0, F.lit(10)).otherwise(F.lit(0))
    # every pair has its number, so this equals an inner join; as a left join
    # Spark drops it where the percentage is not asked for
    return pairs.join(n, "collateral_sk", "left").select("account_sk", "collateral_sk",
                                                 pct.cast("decimal(5,2)").alias("allocation_percentage"))


def bridge_account_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner of each account = order's customer (weight 100); orders with
    key % 5 = 0 are joint (60 / 40 with customer key + 1), key % 35 = 0
    planted as 70 / 40; key % 9 = 0 also has a closed former co-owner."""
    o = read_test_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    roles = F.array_compact(F.array(F.lit(0), F.when(k % 5 == 0, F.lit(1)), F.when(k % 9 == 0, F.lit(2))))
    r = F.col("_r")
    joint = k % 5 == 0
    weight = (F.when(r == 0, F.when(k % 35 == 0, 70).when(joint, 60).otherwise(100))
              .when(r == 1, 40).otherwise(50))
    return o.withColumn("_r", F.explode(roles)).select(
        k.alias("account_sk"),
        F.when(r == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + r.cast("bigint")).alias("customer_sk"),
        F.when(r == 0, F.lit("PRIMARY")).when(r == 1, F.lit("JOINT")).otherwise(F.lit("FORMER")).alias("role_type"),
        weight.cast("decimal(5,2)").alias("ownership_weight"),
        (r != 2).alias("is_current"),
    )


# Event types of the test stream mapped onto alert milestones.
MILESTONE_OF_EVENT = {"signup": "generated", "view": "assigned", "click": "reviewed",
                      "error": "escalated", "purchase": "closed"}


def alert_milestone_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milestone events: alert = user, milestone from the event type."""
    e = read_test_table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    m = None
    for ev, ms in MILESTONE_OF_EVENT.items():
        m = F.when(F.col("event_type") == ev, F.lit(ms)) if m is None else m.when(F.col("event_type") == ev, F.lit(ms))
    return e.select(F.col("user_id").alias("alert_id"), m.alias("milestone"), F.col("ts").alias("milestone_ts"))


BUILDERS.update({
    "customer_versions": customer_versions,
    "customer_type1": customer_type1,
    "customer_changes": customer_changes,
    "customer_order_changes": customer_order_changes,
    "employees": employees,
    "gl_account_levels": gl_account_levels,
    "dated_exchange_rate": dated_exchange_rate,
    "interval_exchange_rate": interval_exchange_rate,
    "transactions_with_currency": transactions_with_currency,
    "dim_collateral": dim_collateral,
    "bridge_loan_collateral": bridge_loan_collateral,
    "bridge_account_customer": bridge_account_customer,
    "alert_milestone_events": alert_milestone_events,
})


# Columns of each bank-shaped frame (checked against the builders in tests);
# the SQL oracle uses it to generate rule queries without a session.
VIEW_COLUMNS = {
    'dim_date': ['date_sk', 'full_date', 'calendar_year', 'month_num', 'month_name', 'fiscal_year', 'fiscal_quarter'],
    'dim_geography': ['geography_sk', 'country_name', 'region', 'aml_risk_rating', 'is_current_record'],
    'dim_currency': ['currency_sk', 'currency_code'],
    'exchange_rate': ['from_currency_code', 'to_currency_code', 'rate_type', 'rate_value', 'valid_to_datetime'],
    'dim_customer': ['customer_sk', 'customer_nk', 'customer_number', 'full_name', 'customer_type', 'customer_segment', 'age_band', 'risk_rating', 'kyc_status', 'pep_flag', 'acquisition_channel', 'acquisition_date', 'relationship_tenure_yrs', 'nationality_country_sk', 'residency_country_sk', 'is_current_record'],
    'dim_branch': ['branch_sk', 'branch_name', 'region_name', 'is_current_record'],
    'dim_product': ['product_sk', 'product_sub_category'],
    'dim_gl_account': ['gl_account_sk', 'level1_name', 'level2_name', 'account_class', 'account_type', 'is_interest_income', 'is_interest_expense'],
    'dim_aml_rule': ['aml_rule_sk', 'rule_name', 'rule_category'],
    'dim_account': ['account_sk', 'customer_sk', 'currency_sk', 'account_type', 'is_current_record'],
    'fact_account_balance_daily': ['account_sk', 'snapshot_date_sk', 'current_balance'],
    'fact_transaction': ['account_sk', 'customer_sk', 'product_sk', 'branch_sk', 'booking_date_sk', 'transaction_datetime', 'amount_txn_ccy', 'is_reversal', 'is_credit'],
    'fact_loan_daily_snapshot': ['snapshot_date_sk', 'account_sk', 'customer_sk', 'product_sk', 'total_outstanding_rcy', 'ecl_provision_amount', 'ecl_pd', 'ecl_lgd', 'loan_to_value_ratio', 'credit_grade', 'ifrs9_stage', 'dpd_bucket', 'is_npl_flag'],
    'fact_gl_balance': ['period_end_date_sk', 'gl_account_sk', 'branch_sk', 'period_type', 'closing_balance_rcy', 'ytd_balance', 'budget_amount', 'prior_year_balance'],
    'fact_payment_order': ['payment_nk', 'instruction_date_sk', 'debtor_customer_sk', 'debtor_branch_sk', 'currency_sk', 'creditor_country_sk', 'payment_type', 'payment_status', 'sanctions_screening_status', 'payment_amount_rcy', 'charge_amount', 'processing_time_seconds', 'is_cross_border', 'is_stp', 'is_rejected'],
    'fact_aml_alert': ['aml_alert_sk', 'generated_date_sk', 'subject_customer_sk', 'branch_sk', 'aml_rule_sk', 'alert_type', 'alert_severity', 'alert_status', 'generated_by', 'ml_risk_score', 'alert_amount_rcy', 'days_to_assign', 'days_to_close', 'is_false_positive', 'is_sar_filed'],
    'customer_versions': ['customer_sk', 'customer_nk', 'full_name', 'customer_segment', 'nationality_country_sk', 'effective_from_date', 'effective_to_date', 'is_current_record'],
    'customer_type1': ['customer_sk', 'customer_nk', 'full_name', 'customer_segment', 'nationality_country_sk'],
    'customer_changes': ['customer_nk', 'full_name', 'customer_segment', 'nationality_country_sk', 'change_ts'],
    'employees': ['employee_sk', 'manager_employee_sk'],
    'gl_account_levels': ['gl_account_sk', 'account_class', 'level1_name', 'level2_name', 'level3_name', 'level4_name', 'level5_name'],
    'customer_order_changes': ['customer_nk', 'customer_segment', 'change_ts'],
    'interval_exchange_rate': ['from_currency_code', 'to_currency_code', 'rate_type', 'rate_value', 'valid_from_datetime', 'valid_to_datetime'],
    'dated_exchange_rate': ['from_currency_code', 'to_currency_code', 'rate_type', 'rate_date', 'rate_value'],
    'transactions_with_currency': ['account_sk', 'booking_date_sk', 'booking_date', 'amount_txn_ccy', 'currency_code'],
    'dim_collateral': ['collateral_sk', 'market_value', 'haircut_percentage'],
    'bridge_loan_collateral': ['account_sk', 'collateral_sk', 'allocation_percentage'],
    'bridge_account_customer': ['account_sk', 'customer_sk', 'role_type', 'ownership_weight', 'is_current'],
    'alert_milestone_events': ['alert_id', 'milestone', 'milestone_ts'],
}


class BankFrames(Mapping):
    """Lazily built, memoised mapping name -> DataFrame over one test dir."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._cache = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in BUILDERS:
                self._cache[name] = BUILDERS[name](self.spark, self.sf_dir)
            elif name in TEST_TABLES:
                self._cache[name] = read_test_table(self.spark, self.sf_dir, name)
            else:
                raise KeyError(name)
        return self._cache[name]

    def __iter__(self):
        return iter(BUILDERS)

    def __len__(self) -> int:
        return len(BUILDERS)


def bank_frames(spark: SparkSession, sf_dir: str) -> BankFrames:
    return BankFrames(spark, sf_dir)
