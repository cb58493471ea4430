"""Query catalogue: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver's test tables through the bank-shaped frames
(``sources.testviews``) and runs over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermart.functions.keys import date_key
from ledgermart.operators import derive, hierarchy, history, joins, quality
from ledgermart.operators.joins import join_dim, latest_only
from ledgermart.plans import governance, marts, views
from ledgermart.session import materialize, scratch_folder
from ledgermart.sources import load, stored
from ledgermart.sources import schemas as S
from ledgermart.sources import testviews as TV
from ledgermart.sources.testviews import bank_frames

Query = Callable[[SparkSession, str], DataFrame]


def _on_frames(fn) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(bank_frames(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


QUERIES: dict[str, Query] = {
    "customer_360": _on_frames(marts.customer_360),
    "credit_risk_portfolio": _on_frames(marts.credit_risk_portfolio),
    "financial_performance": _on_frames(marts.financial_performance),
    "aml_compliance": _on_frames(marts.aml_compliance),
    "payments_analytics": _on_frames(marts.payments_analytics),
}

QUERIES.update({name: _on_frames(fn) for name, fn in governance.GOVERNANCE.items()})

QUERIES.update({
    "row_count_check": _on_frames(quality.row_count_check),
    "quality_profile": _on_frames(quality.quality_profile),
    "soft_key_suite": _on_frames(quality.soft_key_suite),
    "quality_suite": _on_frames(quality.run_suite),
    "split_valid_counts": _on_frames(quality.validation_summary),
    "unique_currency_code": _on_frames(lambda f: quality.unique_key_check(f["dim_currency"], "currency_code")),
    "rate_fanout_check": _on_frames(lambda f: quality.rate_fanout_check(f["exchange_rate"])),
})


# --------------------------------------------------------------------------
# Load, key generation, statistics (L5-L9), derivations (D1-D11, G19),
# history (H1-H6) and the declared joins (J10-J12), each over the test
# tables through the bank-shaped frames.

# L5/L6 on the test data: its years are 1995-2001, so the yearly ranges are
# 1996-1999 and everything else goes to the default partition.
TEST_RANGES = load.year_ranges(1996, 1999)
PRUNE_FROM, PRUNE_TO = 19970601, 19980315


def partition_layout(f):
    t = load.with_partition_label(f["fact_transaction"], "booking_date_sk", TEST_RANGES)
    return t.groupBy("booking_year").agg(F.count(F.lit(1)).alias("rows"),
                                         F.min("booking_date_sk").alias("min_key"),
                                         F.max("booking_date_sk").alias("max_key"))


def pruned_transactions(f):
    t = load.with_partition_label(f["fact_transaction"], "booking_date_sk", TEST_RANGES)
    p = load.prune_by_date_key(t, "booking_date_sk", PRUNE_FROM, PRUNE_TO, TEST_RANGES)
    return p.groupBy("booking_year").agg(F.count(F.lit(1)).alias("rows"),
                                         F.sum("amount_txn_ccy").cast("decimal(38,2)").alias("amount"))


CHOSEN_CUSTOMERS = (1, 2, 4, 5, 7, 8, 10, 11, 13, 14)


def pruned_stored_transactions(f):
    """L5/L6 over a written layout: the transactions are written by booking
    year with a manifest and Bloom filters; the query opens only the files
    that the manifest leaves for its dates, and looks up some customers."""
    t = f["fact_transaction"].select("account_sk", "customer_sk", "booking_date_sk", "amount_txn_ccy")
    folder = scratch_folder(t.sparkSession, "layout")
    load.write_range_partitioned(t, f"{folder}/fact_transaction", "booking_date_sk", TEST_RANGES, bloom=["customer_sk"])
    stored.write_manifest(t.sparkSession, folder, "fact_transaction", ["booking_date_sk"])
    p = stored.read_pruned(t.sparkSession, folder, "fact_transaction", {"booking_date_sk": (PRUNE_FROM, PRUNE_TO)},
                           {"customer_sk": CHOSEN_CUSTOMERS})
    return p.groupBy(F.col("booking_year").cast("string").alias("booking_year"), "customer_sk").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount_txn_ccy").cast("decimal(38,2)").alias("amount"))


def payment_sketches(f):
    """L9 in parts: one row of counts, ends and sketches per column and day,
    merged; distinct counts are estimates, so the query reports whether they
    are within five percent of the exact count (and the median of the
    numbers within 2 % of the ranks)."""
    p = f["fact_payment_order"].select("payment_nk", "instruction_date_sk", "debtor_customer_sk", "payment_type", "payment_amount_rcy",
                                       "processing_time_seconds")
    parts = materialize(stored.sketch_statistics(p, F.col("instruction_date_sk")), "sketches")
    merged = stored.merge_statistics(parts, [0.49, 0.5, 0.51])
    exact = p.agg(*[F.count_distinct(c).alias(c) for c in p.columns]).unpivot([], p.columns, "exact_column", "exact")
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)
    return merged.join(F.broadcast(exact), F.col("column_name") == F.col("exact_column")).select(
        "column_name", "row_count", "null_count", "min_value", "max_value", near.alias("distinct_is_near"),
        (F.size("quantiles") == 3).alias("has_quantiles"))


def append_new_accounts(f):
    """Orders without an account row become accounts with keys after
    the highest existing account key, in order-key order."""
    o = f["orders"].select("o_orderkey", "o_custkey")
    acct = f["dim_account"]
    missing = o.join(acct.select("account_sk"), o["o_orderkey"] == acct["account_sk"], "left_anti")
    keyed = load.append_with_keys(missing, acct, "new_account_sk", ["o_orderkey"], existing_key="account_sk")
    return keyed.select("o_orderkey", "o_custkey", "new_account_sk")


def payment_statistics(f):
    return load.collect_statistics(f["fact_payment_order"], "fact_payment_order", exact_distinct=True)


def dim_date_generated(f):
    """D1 over the span of the order and ship dates, fiscal year from April,
    New Year's Day and Christmas as holidays."""
    o = f["orders"].select(F.to_date("o_orderdate").alias("d"))
    li = f["lineitem"].select(F.to_date("l_shipdate").alias("d"))
    start = o.select(F.min("d")).scalar()
    end = li.select(F.max("d")).scalar()
    spark = f["orders"].sparkSession
    hol = derive.holidays_by_rule(spark, F.year(start), F.year(end))
    return derive.build_dim_date(spark, start, end, fiscal_start_month=4, holidays=hol)


def reporting_currency_amounts(f):
    t = f["transactions_with_currency"]
    return derive.to_reporting_ccy(t, f["dated_exchange_rate"], "amount_txn_ccy", "currency_code", "booking_date")


def balance_snapshots(f):
    return derive.balance_activity(f["fact_transaction"])


def month_end_balances(f):
    d = f["dim_date"]
    month_ends = d.filter(F.col("full_date") == F.last_day("full_date"))
    return derive.balance_snapshot(f["fact_transaction"], month_ends)


def past_due_buckets(f):
    days = TV.dpd_days_from_part(F.col("l_partkey"))
    return (f["lineitem"].select(derive.past_due_bucket(days).alias("dpd_bucket"), derive.is_npl(days).alias("npl"))
            .groupBy("dpd_bucket").agg(F.count(F.lit(1)).alias("loans"),
                                       F.sum(F.when(F.col("npl"), 1).otherwise(0)).cast("bigint").alias("npl_loans")))


def expected_loss_check(f):
    loans = f["fact_loan_daily_snapshot"].withColumn(
        "el", derive.expected_loss("ecl_pd", "ecl_lgd", "total_outstanding_rcy"))
    return loans.groupBy("ifrs9_stage", "credit_grade").agg(
        F.count(F.lit(1)).alias("loans"),
        F.sum("el").cast("decimal(38,2)").alias("expected_loss"),
        F.sum("ecl_provision_amount").cast("decimal(38,2)").alias("stored_provision"),
        F.sum(F.when(F.abs(F.col("el") - F.col("ecl_provision_amount")) > F.lit(0.01).cast("decimal(3,2)"), 1)
              .otherwise(0)).cast("bigint").alias("mismatches"))


def loan_to_value_ratios(f):
    return derive.loan_to_value(f["fact_loan_daily_snapshot"], f["bridge_loan_collateral"], f["dim_collateral"])


def collateral_allocation(f):
    return derive.collateral_per_loan(f["bridge_loan_collateral"], f["dim_collateral"])


def over_allocated(f):
    return derive.over_allocated_collateral(f["bridge_loan_collateral"])


def weighted_balances(f):
    bal = latest_only(f["fact_account_balance_daily"], "snapshot_date_sk").select("account_sk", "current_balance")
    return derive.weighted_customer_balance(bal, f["bridge_account_customer"])


def weight_check(f):
    return derive.ownership_weight_check(f["bridge_account_customer"])


def roll_forward(f):
    return derive.gl_roll_forward(f["fact_gl_balance"])


MASK_SALT = "ledgermart-test-salt"


def masked_customers(f):
    c = f["dim_customer"].filter(F.col("is_current_record")).select(
        "customer_sk", "full_name", "customer_number", "acquisition_date")
    return derive.mask_pii(c, MASK_SALT, hash_cols=["full_name"], year_only_cols=["acquisition_date"],
                           last4_cols=["customer_number"])


def account_dormancy(f):
    t = f["fact_transaction"]
    as_of = t.select(F.max(F.to_date("transaction_datetime"))).scalar()
    return derive.dormancy(f["dim_account"], t, as_of, limit_days=365)


def ledger_rollup(f):
    return derive.ledger_rollup(f["fact_gl_balance"], f["dim_gl_account"],
                                ["account_class", "level1_name", "level2_name"])


def scd1_customers(f):
    return history.scd1_upsert(f["customer_type1"], f["customer_changes"], "customer_nk", "customer_sk",
                               ["full_name", "customer_segment", "nationality_country_sk"], "change_ts")


def scd2_customers(f):
    return history.scd2_apply(f["customer_versions"], f["customer_changes"], "customer_nk", "customer_sk",
                              ["customer_segment", "nationality_country_sk"], TV.SCD_AS_OF, "change_ts")


def unique_key_duplicates(f):
    """Q3 on all three declared unique codes, with planted duplicates and
    NULLs (which are no duplicates): parts by brand as product codes, by key
    % 20 as ledger codes, regions by key % 3 as currency codes."""
    p = F.col("p_partkey")
    frames = {
        "dim_product": f["part"].select(F.when(p % 10 != 0, F.col("p_brand")).alias("product_code")),
        "dim_gl_account": f["part"].select(F.when(p % 7 != 0, F.concat(F.lit("GL"), (p % 20).cast("string"))).alias("gl_account_code")),
        "dim_currency": f["region"].select(F.concat(F.lit("C"), (F.col("r_regionkey") % 3).cast("string")).alias("currency_code"))}
    out = None
    for t, key in S.UNIQUE_KEYS.items():
        found = quality.unique_key_check(frames[t], key).select(F.lit(t).alias("table_name"), F.col(key).alias("code"), "cnt")
        out = found if out is None else out.unionByName(found)
    return out


def long_text_rejects(f):
    """Q7 on texts: customers with planted over-long names (300 characters)
    and band labels (30), counted by the reason of their rejection."""
    k = F.col("c_custkey")
    raw = f["customer"].select(k.alias("customer_sk"), k.cast("string").alias("customer_nk"),
                               F.when(k % 61 == 9, F.repeat(F.lit("n"), F.lit(300))).otherwise(F.col("c_name")).alias("full_name"),
                               F.when(k % 53 == 4, F.repeat(F.lit("b"), F.lit(30))).otherwise(F.lit("25-34")).alias("age_band"))
    _, rejected = quality.split_valid(raw, "dim_customer")
    return rejected.select(F.explode("reject_reasons").alias("reason")).filter(F.col("reason").startswith("fit:")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("rejected_rows"))


def gl_ytd_movement(f):
    """D9 with balances that carry forward: the year to date adds up net movements."""
    return derive.gl_roll_forward(derive.net_movement(f["fact_gl_balance"]), movement="net_movement")


def alert_facts_merged(f):
    """H5 with the fact's other columns: the events of odd days are stored
    first, those of even days merged in."""
    ms = None
    for said, name in TV.MILESTONE_OF_EVENT.items():
        here = F.col("event_type") == said
        ms = F.when(here, F.lit(name)) if ms is None else ms.when(here, F.lit(name))
    e = f["events"].select(F.col("user_id").alias("alert_id"), ms.alias("milestone"), F.col("ts").alias("milestone_ts"),
                           F.col("event_id").alias("triggering_event_sk"), F.col("value").cast("decimal(20,2)").alias("alert_amount_rcy"))
    carry, odd = ["triggering_event_sk", "alert_amount_rcy"], F.dayofmonth("milestone_ts") % 2 == 1
    stored_snapshot = history.accumulate_alert_facts(None, e.filter(odd), carry)
    return history.accumulate_alert_facts(stored_snapshot, e.filter(~odd), carry)


def ledger_rollup_ragged(f):
    """G19 over all five levels, of accounts that end at different ones."""
    g = f["fact_gl_balance"].filter("period_type = 'MONTHLY'").select("gl_account_sk", "closing_balance_rcy")
    return hierarchy.ragged_rollup(g, f["gl_account_levels"], "gl_account_sk", TV.LEDGER_LEVELS, "closing_balance_rcy")


def orphan_transaction_rows(f):
    """Q4: the orphans themselves, looked up in bitmaps of the account keys."""
    t = f["fact_transaction"].select("account_sk", "booking_date_sk", "amount_txn_ccy")
    return quality.orphan_rows(t, f["dim_account"], "account_sk", "account_sk")


def ifrs9_portfolio_function(f):
    """V3 as a table function called by SQL text, for two days."""
    spark = f["fact_loan_daily_snapshot"].sparkSession
    views.register_functions(spark, f, ["ifrs9_portfolio"])
    return spark.sql("SELECT * FROM ifrs9_portfolio(DATE'1996-06-30') UNION ALL SELECT * FROM ifrs9_portfolio(DATE'1997-01-31')")


def scd2_history_splice(f):
    """H2: changes of any age and number fitted into the customers' history."""
    return history.scd2_splice(f["customer_versions"], f["customer_order_changes"], "customer_nk", "customer_sk", "change_ts")


def interval_rate_amounts(f):
    """J11 by validity interval, with the amount in reporting currency."""
    t = f["transactions_with_currency"].select("account_sk", "booking_date", "amount_txn_ccy", "currency_code")
    rates = f["interval_exchange_rate"].withColumnRenamed("from_currency_code", "currency_code")
    out = joins.interval_rate(t, rates, ["currency_code"], "booking_date", out="fx_rate_applied")
    return out.withColumn("amount_reporting_ccy", F.round(F.col("amount_txn_ccy") * F.col("fx_rate_applied"), 2).cast("decimal(20,2)"))


def scd2_customer_check(f):
    return history.scd2_check(f["customer_versions"], "customer_nk")


def customers_as_of(f):
    return history.as_of_view(f["customer_versions"], "1997-06-30").select(
        "customer_sk", "customer_nk", "customer_segment")


def alert_milestones(f):
    return history.accumulate_alerts(None, f["alert_milestone_events"])


def alert_milestones_merged(f):
    """H5 with a stored snapshot: the events of the first half of each month
    are accumulated, the others merged in; the result equals one pass over
    all events."""
    e = f["alert_milestone_events"]
    early = F.dayofmonth("milestone_ts") <= 15
    stored = history.accumulate_alerts(None, e.filter(early))
    return history.accumulate_alerts(stored, e.filter(~early))


def load_rejects(f):
    """Q7/Q10 before the cast: accounts as text with planted misfits, counted
    by the reason of their rejection."""
    a, k = f["dim_account"], F.col("account_sk")
    raw = a.select(*[F.col(c).cast("string").alias(c) for c in ("account_sk", "account_type")],
                   F.when(k % 97 == 5, F.lit("abc")).otherwise(F.col("customer_sk").cast("string")).alias("customer_sk"),
                   F.when(k % 83 == 11, F.lit("99999999999")).otherwise(F.col("currency_sk").cast("string")).alias("currency_sk"),
                   F.when(k % 89 == 7, F.lit("maybe")).otherwise(F.col("is_current_record").cast("string")).alias("is_current_record"),
                   F.when(k % 79 == 3, F.lit("OPENED")).otherwise(F.lit("ACTIVE")).alias("account_status"),
                   F.when(k % 71 == 2, F.lit("2024-02-30")).otherwise(F.lit("2024-02-29")).alias("open_date"),
                   F.when(k % 73 != 1, k.cast("string")).alias("account_nk"))
    typed = load.conform(load.with_misfits(raw, "dim_account"), "dim_account", add_missing=False)
    _, rejected = quality.split_valid(typed, "dim_account")
    return (rejected.select(F.explode("reject_reasons").alias("reason")).groupBy("reason")
            .agg(F.count(F.lit(1)).alias("rejected_rows")))


def gl_closing_balance(f):
    """D9 closing rule over the transactions: accounts with an odd key are
    credit-normal, the others debit-normal."""
    t = f["fact_transaction"]
    amount, credit = F.col("amount_txn_ccy"), F.col("is_credit")
    side = F.when(F.col("account_sk") % 2 == 1, F.lit("CREDIT")).otherwise(F.lit("DEBIT"))
    g = t.groupBy("account_sk").agg(F.sum(F.when(~credit, amount)).alias("debits"), F.sum(F.when(credit, amount)).alias("credits"))
    return g.select("account_sk", derive.gl_closing(F.lit(100).cast("decimal(20,2)"), "debits", "credits", side)
                    .cast("decimal(38,2)").alias("closing_balance"))


def alert_milestone_calendar(f):
    """J5 with one alias per milestone: the accumulating alert snapshot
    joined to the date dimension once per milestone role."""
    snap = history.accumulate_alerts(None, f["alert_milestone_events"])
    out = snap.select("alert_id", *[date_key(F.col(f"{m}_date")).alias(f"{m}_date_sk") for m in history.MILESTONES])
    for m in history.MILESTONES:
        out = join_dim(out, f["dim_date"], f"{m}_date_sk", "date_sk",
                       {"month_name": f"{m}_month_name", "fiscal_quarter": f"{m}_fiscal_quarter"},
                       how="left", name="dim_date")
    return out


def orders_customer_version(f):
    o = f["orders"].select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("order_date"))
    return history.late_facts(o, f["customer_versions"], "o_custkey", "customer_nk", "order_date",
                              "customer_sk", "customer_version_sk")


QUERIES.update({name: _on_frames(fn) for name, fn in {
    "key_high_water": load.key_high_water,
    "partition_layout": partition_layout,
    "pruned_transactions": pruned_transactions,
    "pruned_stored_transactions": pruned_stored_transactions,
    "payment_sketches": payment_sketches,
    "append_new_accounts": append_new_accounts,
    "payment_statistics": payment_statistics,
    "dim_date_generated": dim_date_generated,
    "reporting_currency_amounts": reporting_currency_amounts,
    "balance_snapshots": balance_snapshots,
    "month_end_balances": month_end_balances,
    "past_due_buckets": past_due_buckets,
    "expected_loss_check": expected_loss_check,
    "loan_to_value": loan_to_value_ratios,
    "collateral_allocation": collateral_allocation,
    "over_allocated_collateral": over_allocated,
    "weighted_customer_balance": weighted_balances,
    "ownership_weight_check": weight_check,
    "gl_roll_forward": roll_forward,
    "masked_customers": masked_customers,
    "account_dormancy": account_dormancy,
    "ledger_rollup": ledger_rollup,
    "scd1_customer_upsert": scd1_customers,
    "scd2_customer_apply": scd2_customers,
    "scd2_history_check": scd2_customer_check,
    "customers_as_of": customers_as_of,
    "alert_milestones": alert_milestones,
    "orders_customer_version": orders_customer_version,
    "alert_milestone_calendar": alert_milestone_calendar,
    "alert_milestones_merged": alert_milestones_merged,
    "load_rejects": load_rejects,
    "scd2_history_splice": scd2_history_splice,
    "manager_chain": lambda f: hierarchy.parent_chain(f["employees"], "employee_sk", "manager_employee_sk"),
    "ledger_rollup_ragged": ledger_rollup_ragged,
    "alert_facts_merged": alert_facts_merged,
    "soft_key_coverage": quality.soft_key_coverage,
    "key_high_water_all": load.key_high_water_all,
    "unique_key_duplicates": unique_key_duplicates,
    "long_text_rejects": long_text_rejects,
    "gl_ytd_movement": gl_ytd_movement,
    "masked_customers_declared": lambda f: derive.mask_declared(f["dim_customer"], "dim_customer", MASK_SALT),
    "orphan_transaction_rows": orphan_transaction_rows,
    "ifrs9_portfolio_function": ifrs9_portfolio_function,
    "interval_rate_amounts": interval_rate_amounts,
    "rate_interval_check": lambda f: joins.rate_interval_check(f["interval_exchange_rate"], ["from_currency_code"]),
    "gl_closing_balance": gl_closing_balance,
}.items()})
