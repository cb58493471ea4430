"""Governance and access queries (V1-V10) over the marts and facts.

PostgreSQL orders NULL last ascending and first descending; Spark's
defaults are the other way round, so every sort states its NULL order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermart.functions.metrics import avg_round, cond_count, cond_sum, count_pct, dec_sum
from ledgermart.operators.joins import join_dim
from ledgermart.operators.quality import orphan_check
from ledgermart.plans import marts

Frames = Mapping[str, DataFrame]


def orphan_transactions(frames: Frames) -> DataFrame:
    """V1: transactions whose account has no dimension row (expected 0).
    One row, also on empty input; a NULL account key counts as an orphan."""
    return orphan_check(frames["fact_transaction"], frames["dim_account"], "account_sk", "account_sk") \
        .withColumnRenamed("orphan_rows", "orphan_transactions")


def duplicate_current_customers(frames: Frames) -> DataFrame:
    """V2: natural keys with more than one current version (expected none)."""
    return (frames["dim_customer"].filter(F.col("is_current_record") == True)  # noqa: E712  (= TRUE)
            .groupBy("customer_nk").agg(F.count(F.lit(1)).alias("cnt"))
            .filter(F.col("cnt") > 1))


def latest_loan_snapshot_date(frames: Frames):
    """The most recent loan snapshot day (a scalar subquery, run once)."""
    loans = frames["fact_loan_daily_snapshot"]
    return F.to_date(loans.select(F.max("snapshot_date_sk")).scalar().cast("string"), "yyyyMMdd")


def ifrs9_portfolio(frames: Frames, snapshot_date=None) -> DataFrame:
    """V3: loans, exposure and average PD (4 places, exact) by IFRS 9 stage
    and past-due bucket on one snapshot date (default: the latest)."""
    when = latest_loan_snapshot_date(frames) if snapshot_date is None else F.lit(snapshot_date).cast("date")
    dates = frames["dim_date"].filter(F.col("full_date") == when)
    loans = frames["fact_loan_daily_snapshot"].select(
        "snapshot_date_sk", "ifrs9_stage", "dpd_bucket", "total_outstanding_rcy", "ecl_pd")
    x = join_dim(loans, dates, "snapshot_date_sk", "date_sk", {}, name="dim_date")
    return (x.groupBy("ifrs9_stage", "dpd_bucket")
            .agg(F.count(F.lit(1)).alias("loans"),
                 dec_sum("total_outstanding_rcy").alias("exposure_usd"),
                 avg_round("ecl_pd", 4).alias("avg_pd"))
            .orderBy(F.asc_nulls_last("ifrs9_stage"), F.asc_nulls_last("dpd_bucket")))


def false_positive_rate_by_rule(frames: Frames) -> DataFrame:
    """V4: alerts and false-positive percent (1 place) per rule, highest first.
    Inner join: alerts of an unknown rule are not counted."""
    x = join_dim(frames["fact_aml_alert"].select("aml_rule_sk", "is_false_positive"), frames["dim_aml_rule"],
                 "aml_rule_sk", "aml_rule_sk",
                 {"rule_name": "rule_name"}, name="dim_aml_rule")
    n = F.count(F.lit(1))
    return (x.groupBy("rule_name")
            .agg(n.alias("alerts"), count_pct(cond_count(F.col("is_false_positive")), n, 1).alias("fp_pct"))
            .orderBy(F.desc_nulls_first("fp_pct")))


def net_interest_margin(frames: Frames) -> DataFrame:
    """V5: monthly interest income, expense and their difference (net
    interest income; the reference does not divide by assets)."""
    g = frames["fact_gl_balance"].filter(F.col("period_type") == "MONTHLY").select(
        "period_end_date_sk", "gl_account_sk", "closing_balance_rcy")
    x = join_dim(g, frames["dim_gl_account"], "gl_account_sk", "gl_account_sk",
                 {"is_interest_income": "is_interest_income", "is_interest_expense": "is_interest_expense"},
                 name="dim_gl_account")
    x = join_dim(x, frames["dim_date"], "period_end_date_sk", "date_sk",
                 {"calendar_year": "calendar_year", "month_num": "month_num"}, name="dim_date")
    inc = cond_sum(F.col("is_interest_income"), "closing_balance_rcy")
    exp = cond_sum(F.col("is_interest_expense"), "closing_balance_rcy")
    return (x.groupBy("calendar_year", "month_num")
            .agg(inc.alias("interest_income"), exp.alias("interest_expense"),
                 (inc - exp).cast("decimal(38,2)").alias("nii"))
            .orderBy(F.asc_nulls_last("calendar_year"), F.asc_nulls_last("month_num")))


def customer_360_first(frames: Frames, n: int = 20) -> DataFrame:
    """V6: the first ``n`` rows of the customer mart; the limit is the
    feature.  Ordered by key so the result is repeatable (the reference's
    unordered LIMIT is not)."""
    return marts.customer_360(frames).orderBy("customer_sk").limit(n)


def credit_risk_on_date(frames: Frames, snapshot_date=None) -> DataFrame:
    """V7: the credit-risk mart on one snapshot date (default: the latest);
    the date predicate lands on the date dimension below the aggregate."""
    when = latest_loan_snapshot_date(frames) if snapshot_date is None else F.lit(snapshot_date).cast("date")
    f = dict(frames)
    f["dim_date"] = frames["dim_date"].filter(F.col("full_date") == when)
    return marts.credit_risk_portfolio(f)


def financial_performance_year(frames: Frames, calendar_year: int | None = None) -> DataFrame:
    """V8: the financial-performance mart for one year (default: the year of
    the latest monthly period)."""
    if calendar_year is None:
        g = frames["fact_gl_balance"].filter(F.col("period_type") == "MONTHLY")
        year = F.floor(g.select(F.max("period_end_date_sk")).scalar() / F.lit(10000)).cast("int")
    else:
        year = F.lit(calendar_year)
    f = dict(frames)
    f["dim_date"] = frames["dim_date"].filter(F.col("calendar_year") == year)
    return marts.financial_performance(f)


def aml_high_severity(frames: Frames, severity: str = "HIGH") -> DataFrame:
    """V9: the AML mart for one severity; the filter reaches the fact scan."""
    return marts.aml_compliance(frames).filter(F.col("alert_severity") == severity)


def payments_by_volume(frames: Frames) -> DataFrame:
    """The payments mart by total volume, largest first (NULL first)."""
    return marts.payments_analytics(frames).orderBy(F.desc_nulls_first("total_volume_usd"))


GOVERNANCE = {
    "orphan_transactions": orphan_transactions,
    "duplicate_current_customers": duplicate_current_customers,
    "ifrs9_portfolio": ifrs9_portfolio,
    "false_positive_rate_by_rule": false_positive_rate_by_rule,
    "net_interest_margin": net_interest_margin,
    "customer_360_first20": customer_360_first,
    "credit_risk_latest_date": credit_risk_on_date,
    "financial_performance_latest_year": financial_performance_year,
    "aml_high_severity": aml_high_severity,
    "payments_by_volume": payments_by_volume,
}
