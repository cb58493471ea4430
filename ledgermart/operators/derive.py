"""Derivations for columns whose formulas the model declares but does not
give (D1-D11) and the ledger-hierarchy roll-up (G19).

These rules are ours (the model has only column names and comments); each
docstring states the rule.  All are DataFrame compositions: windows are
partitioned by an entity **after** pre-aggregating to one row per entity
and day or period, so a hot account never brings its raw rows to one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermart.functions.keys import date_key
from ledgermart.operators.joins import bridge_allocate, latest_rate_on_or_before
from ledgermart.sources import schemas as S

CENT = Decimal("0.01")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exact_ratio(num: Column, den: Column, places: int) -> Column:
    """``ROUND(num / NULLIF(den, 0), places)`` for decimals with at most 2
    decimals, exactly and half away from zero: the absolute values are
    scaled to integers and divided with integer half-up rounding, and the
    sign is put back.  ``decimal(18, places)``."""
    n = F.abs(num * 100).cast("decimal(38,0)")
    d = F.abs(den * 100).cast("decimal(38,0)")
    q = F.call_function("div", n * F.lit(2 * 10 ** places) + d, F.nullif(d * 2, F.lit(0))).cast("decimal(38,0)")
    q = F.when((num < 0) != (den < 0), -q).otherwise(q)
    return (q * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal(18,{places})")


# ------------------------------------------------------------------ D1

def holidays_by_rule(spark: SparkSession, first_year: Column, last_year: Column,
                     month_days: Sequence[tuple[int, int]] = ((1, 1), (12, 25))) -> DataFrame:
    """Fixed-date public holidays (month, day) for every year in range."""
    years = (spark.range(1).select(first_year.cast("int").alias("a"), last_year.cast("int").alias("b"))
             .filter("a <= b").select(F.explode(F.sequence("a", "b")).alias("y")))
    md = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d")) for m, d in month_days])
    return years.select(F.explode(md).alias("md"), "y").select(
        F.make_date("y", "md.m", "md.d").alias("holiday"))


def build_dim_date(spark: SparkSession, start: Column, end: Column, fiscal_start_month: int = 1,
                   holidays: DataFrame | None = None) -> DataFrame:
    """One row per calendar day in ``[start, end]`` with the 24 declared
    columns.  Rules: ISO week and ISO weekday (Monday = 1); weekend =
    Saturday or Sunday; working day = neither weekend nor holiday; fiscal
    months count from ``fiscal_start_month`` and the fiscal year is named
    after the year it ends in; prior-year key = same day 12 months back
    (29 February -> 28 February).

    One row per day between the two scalar dates, however far apart; an
    empty span gives no rows.  Holidays join by broadcast (one row per
    holiday, bounded by the calendar)."""
    days = (spark.range(1).select(start.cast("date").alias("a"), end.cast("date").alias("b")).filter("a <= b")
            .select(F.explode(F.sequence("a", "b")).alias("d")))
    d = F.col("d")
    m = F.month(d)
    fm = ((m - fiscal_start_month + 12) % 12) + 1
    fy = F.year(d) + (F.lit(1) if fiscal_start_month > 1 else F.lit(0)) * (m >= fiscal_start_month).cast("int")
    iso_dow = ((F.dayofweek(d) + 5) % 7) + 1
    is_weekend = iso_dow >= 6
    month_end = d == F.last_day(d)
    out = days.select(
        date_key(d).alias("date_sk"),
        d.alias("full_date"),
        iso_dow.cast("smallint").alias("day_of_week_num"),
        F.date_format(d, "EEEE").alias("day_of_week_name"),
        F.dayofmonth(d).cast("smallint").alias("day_of_month"),
        F.weekofyear(d).cast("smallint").alias("week_of_year"),
        m.cast("smallint").alias("month_num"),
        F.date_format(d, "MMMM").alias("month_name"),
        F.quarter(d).cast("smallint").alias("quarter_num"),
        F.concat(F.lit("Q"), F.quarter(d).cast("string")).alias("quarter_name"),
        F.year(d).cast("smallint").alias("calendar_year"),
        fy.cast("smallint").alias("fiscal_year"),
        (F.floor((fm - 1) / 3) + 1).cast("smallint").alias("fiscal_quarter"),
        fm.cast("smallint").alias("fiscal_month"),
        is_weekend.alias("is_weekend"),
        month_end.alias("is_month_end"),
        (month_end & (m % 3 == 0)).alias("is_quarter_end"),
        ((m == 12) & (F.dayofmonth(d) == 31)).alias("is_year_end"),
        month_end.alias("is_fiscal_month_end"),
        F.dayofmonth(F.last_day(d)).cast("smallint").alias("days_in_month"),
        (F.dayofmonth(F.last_day(d)) - F.dayofmonth(d)).cast("smallint").alias("days_remaining_month"),
        date_key(F.add_months(d, -12)).alias("prior_year_date_sk"),
    )
    if holidays is None:
        out = out.withColumn("is_public_holiday", F.lit(False))
    else:
        h = F.broadcast(holidays.select(F.col("holiday").alias("__h")).distinct())
        out = out.join(h, out["full_date"] == h["__h"], "left") \
            .withColumn("is_public_holiday", F.col("__h").isNotNull()).drop("__h")
    out = out.withColumn("is_bank_working_day", ~F.col("is_weekend") & ~F.col("is_public_holiday"))
    order = ["date_sk", "full_date", "day_of_week_num", "day_of_week_name", "day_of_month", "week_of_year",
             "month_num", "month_name", "quarter_num", "quarter_name", "calendar_year", "fiscal_year",
             "fiscal_quarter", "fiscal_month", "is_weekend", "is_public_holiday", "is_bank_working_day",
             "is_month_end", "is_quarter_end", "is_year_end", "is_fiscal_month_end", "days_in_month",
             "days_remaining_month", "prior_year_date_sk"]
    return out.select(*order)


# ------------------------------------------------------------------ D2

def to_reporting_ccy(facts: DataFrame, rates: DataFrame, amount: str, ccy: str, fact_date: str,
                     reporting: str = "USD", rate_type: str = "MID_RATE") -> DataFrame:
    """``amount_reporting_ccy = round(amount * rate, 2)`` with the rate
    to ``reporting`` of ``rate_type`` in force on the fact's date (J11: the
    latest ``rate_date`` on or before it).  The reporting currency itself
    converts at 1; a missing rate gives NULL."""
    r = rates.filter((F.col("to_currency_code") == reporting) & (F.col("rate_type") == rate_type)) \
        .select(F.col("from_currency_code").alias(ccy), "rate_date", "rate_value")
    out = latest_rate_on_or_before(facts, r, [ccy], fact_date)
    rate = F.when(F.col(ccy) == reporting, F.lit(1).cast("decimal(15,8)")).otherwise(F.col("rate_value"))
    return out.withColumn("fx_rate_applied", rate).drop("rate_value").withColumn(
        "amount_reporting_ccy", F.round(F.col(amount).cast("decimal(20,2)") * F.col("fx_rate_applied"), 2)
        .cast("decimal(20,2)"))


# ------------------------------------------------------------------ D3

def balance_activity(transactions: DataFrame, account: str = "account_sk", ts: str = "transaction_datetime",
                     amount: str = "amount_txn_ccy", is_credit: str = "is_credit") -> DataFrame:
    """D3, activity form: one row per account and activity day: the day's
    credits, debits and count, closing balance (running sum of credits
    minus debits; reversals keep their sign), days since the previous
    activity day, and ``is_overdrawn`` (balance below zero).

    Transactions are first summed per (account, day) with partial
    aggregation; the running window then sees at most one row per day per
    account, so even an account with a third of all transactions is
    bounded by the calendar."""
    day = F.to_date(F.col(ts))
    credit = F.col(is_credit)
    daily = transactions.groupBy(F.col(account).alias("account_sk"), day.alias("snapshot_date")).agg(
        F.sum(F.when(credit, F.col(amount)).otherwise(F.lit(0))).cast("decimal(20,2)").alias("credit_amount_day"),
        F.sum(F.when(credit, F.lit(0)).otherwise(F.col(amount))).cast("decimal(20,2)").alias("debit_amount_day"),
        F.count(F.lit(1)).cast("int").alias("transaction_count_day"))
    w = Window.partitionBy("account_sk").orderBy("snapshot_date")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bal = F.sum(F.col("credit_amount_day") - F.col("debit_amount_day")).over(running).cast("decimal(20,2)")
    return daily.select(
        "account_sk", date_key(F.col("snapshot_date")).alias("snapshot_date_sk"), "snapshot_date",
        "credit_amount_day", "debit_amount_day", "transaction_count_day",
        bal.alias("current_balance"),
        F.datediff("snapshot_date", F.lag("snapshot_date").over(w)).alias("days_since_previous_txn"),
    ).withColumn("is_overdrawn", F.col("current_balance") < 0)


def balance_snapshot(transactions: DataFrame, dates: DataFrame, date_col: str = "full_date",
                     **columns) -> DataFrame:
    """D3, periodic form: for every account and every date of ``dates`` from
    the account's first activity on, the last balance at or before that
    date, that day's credits, debits and count (0 without activity), days
    since the last activity and ``is_overdrawn``.

    Each activity row covers the days up to the next activity.  Those
    intervals are expanded to the calendar months they touch and joined
    with the snapshot dates on the month (the dates are bounded by the
    calendar and broadcast), then filtered to the interval: every output
    row is produced once, with no range join and no all-pairs step."""
    act = balance_activity(transactions, **columns)
    w = Window.partitionBy("account_sk").orderBy("snapshot_date")
    d = dates.select(F.col(date_col).cast("date").alias("__d")).distinct()
    last = d.select(F.max("__d")).scalar()
    iv = act.withColumn("__end", F.coalesce(F.date_sub(F.lead("snapshot_date").over(w), 1), last)) \
        .filter(F.col("snapshot_date") <= F.col("__end"))
    iv = iv.withColumn("__m", F.explode(F.sequence(F.trunc("snapshot_date", "month"), F.trunc("__end", "month"),
                                                   F.expr("INTERVAL 1 MONTH"))))
    dm = F.broadcast(d.withColumn("__dm", F.trunc("__d", "month")))
    j = iv.join(dm, iv["__m"] == dm["__dm"]).filter(
        (F.col("__d") >= F.col("snapshot_date")) & (F.col("__d") <= F.col("__end")))
    same = F.col("__d") == F.col("snapshot_date")
    zero = F.lit(0).cast("decimal(20,2)")
    return j.select(
        "account_sk", date_key(F.col("__d")).alias("snapshot_date_sk"), F.col("__d").alias("snapshot_date"),
        F.when(same, F.col("credit_amount_day")).otherwise(zero).alias("credit_amount_day"),
        F.when(same, F.col("debit_amount_day")).otherwise(zero).alias("debit_amount_day"),
        F.when(same, F.col("transaction_count_day")).otherwise(F.lit(0)).alias("transaction_count_day"),
        "current_balance",
        F.datediff(F.col("__d"), F.col("snapshot_date")).alias("days_since_last_txn"),
        "is_overdrawn")


# ------------------------------------------------------------------ bands

# Band edges are parameters: the model names age and income bands but gives
# no limits.  The default age labels are the ones the test data uses.
AGE_BANDS = ((18, "18-24"), (25, "25-34"), (35, "35-49"), (50, "50-64"), (65, "65+"))


def band(value: Column | str, edges: Sequence[tuple[float, str]], below: str | None = None) -> Column:
    """Label of the highest edge not above ``value`` (edges ascending);
    ``below`` for values under the first edge; NULL stays NULL."""
    v = _c(value)
    expr = F.when(v.isNull(), F.lit(None).cast("string"))
    for lower, label in reversed(list(edges)):
        expr = expr.when(v >= lower, F.lit(label))
    return expr.otherwise(F.lit(below))


def age_band(date_of_birth: Column | str, as_of: Column, edges: Sequence[tuple[int, str]] = AGE_BANDS) -> Column:
    """Age band in whole years at ``as_of`` (birthday counted on the day)."""
    years = F.floor(F.months_between(as_of, _c(date_of_birth)) / 12)
    return band(years, edges)


# ------------------------------------------------------------------ D4

def past_due_bucket(days: Column | str) -> Column:
    """0, 1-30, 31-60, 61-90, 91-180, 180+ (NULL stays NULL).  ``NPL``
    is an accepted stored value but never produced."""
    x = _c(days)
    return (F.when(x.isNull(), F.lit(None)).when(x <= 0, "0").when(x <= 30, "1-30").when(x <= 60, "31-60")
            .when(x <= 90, "61-90").when(x <= 180, "91-180").otherwise("180+"))


def is_npl(days: Column | str) -> Column:
    """Non-performing: more than 90 days past due."""
    return _c(days) > 90


# ------------------------------------------------------------------ D5, D6

def expected_loss(pd_: Column | str, lgd: Column | str, ead: Column | str) -> Column:
    """``round(PD * LGD * EAD, 2)`` in exact decimal arithmetic."""
    return F.round(_c(pd_).cast("decimal(8,6)") * _c(lgd).cast("decimal(8,6)") * _c(ead).cast("decimal(20,2)"),
                   2).cast("decimal(20,2)")


def ltv(outstanding: Column | str, collateral: Column | str) -> Column:
    """Loan-to-value to 4 places; NULL when the collateral is 0 or NULL."""
    return exact_ratio(_c(outstanding), _c(collateral), 4)


# ------------------------------------------------------------------ D7

def eligible_value(market: Column | str, haircut_pct: Column | str) -> Column:
    """Market value after the haircut, to the cent: ``market * (1 - h/100)``."""
    return F.round(_c(market).cast("decimal(20,2)") * (F.lit(100) - _c(haircut_pct).cast("decimal(5,2)"))
                   * F.lit(CENT), 2).cast("decimal(20,2)")


def allocate_collateral(bridge: DataFrame, collateral: DataFrame) -> DataFrame:
    """D7 + J12: per (loan, collateral) the allocated eligible value
    ``eligible * allocation_percentage / 100`` to the cent."""
    c = collateral.select("collateral_sk", eligible_value("market_value", "haircut_percentage").alias("eligible_value"))
    j = bridge.select("account_sk", "collateral_sk", "allocation_percentage").join(c, "collateral_sk")
    return j.withColumn("allocated_collateral_value", F.round(
        F.col("eligible_value") * F.col("allocation_percentage") * F.lit(CENT), 2).cast("decimal(20,2)"))


def collateral_per_loan(bridge: DataFrame, collateral: DataFrame) -> DataFrame:
    return allocate_collateral(bridge, collateral).groupBy("account_sk").agg(
        F.count(F.lit(1)).alias("collateral_count"),
        F.sum("allocated_collateral_value").cast("decimal(20,2)").alias("allocated_collateral_value"))


def over_allocated_collateral(bridge: DataFrame) -> DataFrame:
    """Collateral pledged above 100 % in total across loans."""
    return (bridge.groupBy("collateral_sk")
            .agg(F.sum("allocation_percentage").cast("decimal(12,2)").alias("total_allocation_pct"),
                 F.count(F.lit(1)).alias("loan_count"))
            .filter(F.col("total_allocation_pct") > 100))


def loan_to_value(loans: DataFrame, bridge: DataFrame, collateral: DataFrame) -> DataFrame:
    """D6 over D7: exposure per loan account against its allocated collateral."""
    exposure = loans.groupBy("account_sk").agg(
        F.sum("total_outstanding_rcy").cast("decimal(20,2)").alias("exposure"))
    coll = collateral_per_loan(bridge, collateral)
    j = exposure.join(coll, "account_sk", "left")
    return j.select("account_sk", "exposure", "allocated_collateral_value",
                    ltv("exposure", "allocated_collateral_value").alias("loan_to_value_ratio"))


# ------------------------------------------------------------------ D8

def weighted_customer_balance(balances: DataFrame, bridge: DataFrame, balance_col: str = "current_balance") -> DataFrame:
    """D8 + J12: each current bridge row takes ``balance * weight / 100``
    of its account's balance; summed per customer."""
    b = bridge.filter(F.col("is_current"))
    shares = bridge_allocate(balances.select("account_sk", balance_col), b, "account_sk", "account_sk",
                             "customer_sk", "ownership_weight", balance_col, "weighted_balance")
    return shares.groupBy("customer_sk").agg(
        F.count(F.lit(1)).alias("account_count"),
        F.sum("weighted_balance").cast("decimal(24,4)").alias("weighted_balance"))


def ownership_weight_check(bridge: DataFrame) -> DataFrame:
    """Accounts whose current ownership weights do not add up to 100."""
    return (bridge.filter(F.col("is_current")).groupBy("account_sk")
            .agg(F.sum("ownership_weight").cast("decimal(12,2)").alias("total_weight"),
                 F.count(F.lit(1)).alias("owner_count"))
            .filter(F.col("total_weight") != 100))


# ------------------------------------------------------------------ D9

def gl_closing(opening: Column | str, debits: Column | str, credits: Column | str,
               normal_side: Column | str) -> Column:
    """Closing balance by the account's normal side: a DEBIT-normal
    account (assets, expenses) grows with debits, a CREDIT-normal one
    (liabilities, equity, income) with credits.  NULL movements count 0."""
    o, d, c = (F.coalesce(_c(x), F.lit(0)) for x in (opening, debits, credits))
    side = _c(normal_side)
    return F.when(side == "DEBIT", o + d - c).when(side == "CREDIT", o + c - d)


def net_movement(gl: DataFrame) -> DataFrame:
    """``gl`` with ``net_movement``: how much a monthly closing balance changed
    against the account's and branch's previous period (from nothing, for
    the first).  The window over an account and branch has a row a month."""
    w = Window.partitionBy("gl_account_sk", "branch_sk", "period_type").orderBy("period_end_date_sk")
    before = F.coalesce(F.lag("closing_balance_rcy").over(w), F.lit(0))
    return gl.withColumn("net_movement", (F.coalesce("closing_balance_rcy", F.lit(0)) - before).cast("decimal(23,2)"))


def gl_roll_forward(gl: DataFrame, fiscal_start_month: int = 1,
                    movement: Column | str = "closing_balance_rcy") -> DataFrame:
    """Per ledger account, branch and monthly period: the month's
    closing balance, the year-to-date running sum of ``movement`` within the
    fiscal year (the chosen rule: by default the period's own figure, which
    fits accounts that restart every period; pass net movement, e.g. debits
    minus credits, for balances that carry forward, where summing closing
    balances would count them again), the prior-year closing (same account and branch, 12 months back, by a
    self-join on the date key) and the variance to budget.

    The running window is partitioned by (account, branch, fiscal year):
    at most 12 rows each."""
    g = gl.filter(F.col("period_type") == "MONTHLY").select(
        "gl_account_sk", "branch_sk", "period_end_date_sk", "closing_balance_rcy", "budget_amount",
        _c(movement).alias("__movement"))
    pdate = F.to_date(F.col("period_end_date_sk").cast("string"), "yyyyMMdd")
    m = F.month(pdate)
    fy = F.year(pdate) + (F.lit(1) if fiscal_start_month > 1 else F.lit(0)) * (m >= fiscal_start_month).cast("int")
    g = g.withColumn("fiscal_year", fy.cast("int")) \
         .withColumn("prior_key", date_key(F.last_day(F.add_months(pdate, -12))))
    w = (Window.partitionBy("gl_account_sk", "branch_sk", "fiscal_year").orderBy("period_end_date_sk")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    g = g.withColumn("ytd_balance", F.sum("__movement").over(w).cast("decimal(22,2)"))
    prior = gl.filter(F.col("period_type") == "MONTHLY").select(
        F.col("gl_account_sk").alias("p_acct"), F.col("branch_sk").alias("p_branch"),
        F.col("period_end_date_sk").alias("p_key"), F.col("closing_balance_rcy").alias("prior_year_closing"))
    j = g.join(prior, (g["gl_account_sk"] == prior["p_acct"]) & (g["branch_sk"] == prior["p_branch"])
               & (g["prior_key"] == prior["p_key"]), "left")
    return j.select("gl_account_sk", "branch_sk", "period_end_date_sk", "fiscal_year", "closing_balance_rcy",
                    "ytd_balance", "prior_year_closing",
                    (F.col("closing_balance_rcy") - F.coalesce(F.col("budget_amount"), F.lit(0)))
                    .cast("decimal(23,2)").alias("variance_vs_budget"))


# ------------------------------------------------------------------ D10, D11

def mask_pii(df: DataFrame, salt: str, hash_cols: Iterable[str] = (), year_only_cols: Iterable[str] = (),
             last4_cols: Iterable[str] = ()) -> DataFrame:
    """Names -> SHA-256 hex of salt + value; dates -> year only (1 Jan);
    account numbers -> last four characters.  NULL stays NULL."""
    out = df
    for c in hash_cols:
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.sha2(F.concat(F.lit(salt), F.col(c)), 256)))
    for c in year_only_cols:
        out = out.withColumn(c, F.trunc(F.col(c), "year"))
    for c in last4_cols:
        out = out.withColumn(c, F.right(F.col(c), F.lit(4)))
    return out


def mask_rule(c) -> str | None:
    """How a declared column is masked: ``None`` unless it is tagged as
    personal data; a date keeps its year, a number of an account or document
    its last four characters, other text is hashed, anything else is removed."""
    if not c.pii:
        return None
    if c.dtype in ("date", "timestamp"):
        return "year"
    if c.dtype in ("string", "char", "varchar") or c.dtype.startswith(("char", "varchar")):
        return "last4" if c.name.endswith("_number") else "hash"
    return "remove"


def mask_declared(df: DataFrame, name: str, salt: str) -> DataFrame:
    """D10 from the declared tags: every column of ``df`` that the model of
    table ``name`` tags as personal data is masked by :func:`mask_rule`;
    nobody has to list them.  One projection, NULL stays NULL."""
    rules = {c.name: mask_rule(c) for c in S.columns(name)}
    text = df.select([F.col(c).cast("string") if rules.get(c) in ("hash", "last4") else F.col(c) for c in df.columns])
    hashed = [c for c in df.columns if rules.get(c) == "hash"]
    out = mask_pii(text, salt, hash_cols=hashed, year_only_cols=[c for c in df.columns if rules.get(c) == "year"],
                   last4_cols=[c for c in df.columns if rules.get(c) == "last4"])
    removed = {c: F.lit(None).cast(df.schema[c].dataType) for c in df.columns if rules.get(c) == "remove"}
    return out.withColumns(removed) if removed else out


def dormancy(accounts: DataFrame, transactions: DataFrame, as_of: Column, limit_days: int = 365,
             account: str = "account_sk", ts: str = "transaction_datetime") -> DataFrame:
    """Per account the last transaction day and days without activity
    up to ``as_of``; dormant when that reaches ``limit_days`` (the model
    gives no limit, so it is a parameter).  An account without any
    transaction is dormant with NULL days."""
    last = transactions.groupBy(F.col(account).alias("__a")).agg(F.max(F.to_date(F.col(ts))).alias("last_txn_date"))
    a = accounts.select(account).distinct()
    j = a.join(last, a[account] == last["__a"], "left").drop("__a")
    days = F.datediff(as_of, F.col("last_txn_date"))
    return j.select(account, "last_txn_date", days.alias("days_inactive"),
                    F.coalesce(days >= limit_days, F.lit(True)).alias("is_dormant_flag"))


# ------------------------------------------------------------------ G19

def ledger_rollup(gl: DataFrame, gl_accounts: DataFrame, levels: Sequence[str], measure: str = "closing_balance_rcy",
                  period_type: str = "MONTHLY") -> DataFrame:
    """Totals at every prefix of the ledger hierarchy (``ROLLUP``), with
    ``grouping_level`` (= ``grouping_id``) telling a subtotal from a NULL
    level value.  Partial aggregation per task, one shuffle."""
    g = gl.filter(F.col("period_type") == period_type).select("gl_account_sk", measure)
    acc = gl_accounts.select(F.col("gl_account_sk").alias("__k"), *levels)  # Spark broadcasts it if it is small
    j = g.join(acc, g["gl_account_sk"] == acc["__k"])
    return j.rollup(*levels).agg(
        F.grouping_id().cast("int").alias("grouping_level"),
        F.count(F.lit(1)).alias("row_count"),
        F.sum(measure).cast("decimal(38,2)").alias("total_balance"))
