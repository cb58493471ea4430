"""Oracle SQL for the load, derivation, history and join operators."""

from __future__ import annotations

from ledgermart.sources import schemas as S
from ledgermart.sources.testviews import VIEW_COLUMNS

RANGES = [(str(y), y * 10000 + 101, (y + 1) * 10000 + 101) for y in range(1996, 2000)]


def _label(col: str) -> str:
    whens = " ".join(f"when {col} >= {lo} and {col} < {hi} then '{lab}'" for lab, lo, hi in RANGES)
    return f"case {whens} else 'default' end"


def _key_high_water() -> str:
    parts = []
    for t in S.TABLES:
        k = S.key_column(t)
        if t in VIEW_COLUMNS and k and k in VIEW_COLUMNS[t]:
            parts.append(f"select '{t}' as table_name, '{k}' as key_column, cast(max({k}) as bigint) as last_key, "
                         f"cast(coalesce(max({k}), 0) + 1 as bigint) as next_key from {t}")
    return "\nunion all\n".join(parts)


def _payment_statistics() -> str:
    parts = []
    for c in VIEW_COLUMNS["fact_payment_order"]:
        parts.append(f"select 'fact_payment_order' as table_name, '{c}' as column_name, count(*) as row_count, "
                     f"cast(sum(case when {c} is null then 1 else 0 end) as bigint) as null_count, "
                     f"cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value, "
                     f"count(distinct {c}) as distinct_count from fact_payment_order")
    return "\nunion all\n".join(parts)


def _exact_ratio(num: str, den: str, places: int) -> str:
    n = f"cast(({num}) * 100 as hugeint)"
    d = f"cast(({den}) * 100 as hugeint)"
    unit = "0." + "0" * (places - 1) + "1"
    return (f"cast(cast(({n} * {2 * 10 ** places} + {d}) // nullif(2 * {d}, 0) as decimal(18,0)) * {unit} "
            f"as decimal(18,{places}))")


_ALLOCATED = """
select b.account_sk, b.collateral_sk,
       cast(round(cast(round(c.market_value * (100 - c.haircut_percentage) * 0.01, 2) as decimal(20,2))
                  * b.allocation_percentage * 0.01, 2) as decimal(20,2)) as allocated_collateral_value
from bridge_loan_collateral b join dim_collateral c on c.collateral_sk = b.collateral_sk
"""

_PER_LOAN = f"""
select account_sk, count(*) as collateral_count,
       cast(sum(allocated_collateral_value) as decimal(20,2)) as allocated_collateral_value
from ({_ALLOCATED}) a group by account_sk
"""

_MILESTONES = ("generated", "assigned", "reviewed", "escalated", "closed", "sar_filed")

_ALERTS = "select alert_id, " + ", ".join(
    f"min(case when milestone = '{m}' then cast(milestone_ts as date) end) as {m}_date" for m in _MILESTONES
) + " from alert_milestone_events group by alert_id"

_SCD2 = """
with cur as (select * from customer_versions where is_current_record),
latest as (select customer_nk, full_name, customer_segment, nationality_country_sk from customer_changes),
changed as (select distinct c.customer_nk from cur c join latest l on l.customer_nk = c.customer_nk
            where not (c.customer_segment is not distinct from l.customer_segment
                       and c.nationality_country_sk is not distinct from l.nationality_country_sk)),
fresh as (select customer_nk from latest where customer_nk not in (select customer_nk from cur)),
kept as (
  select v.customer_sk, v.customer_nk, v.full_name, v.customer_segment, v.nationality_country_sk, v.effective_from_date,
         case when v.is_current_record and ch.customer_nk is not null then date '2002-01-01' else v.effective_to_date end as effective_to_date,
         case when v.is_current_record and ch.customer_nk is not null then false else v.is_current_record end as is_current_record
  from customer_versions v left join changed ch on ch.customer_nk = v.customer_nk),
added as (
  select (select max(customer_sk) from customer_versions) + row_number() over (order by l.customer_nk) as customer_sk,
         l.customer_nk, l.full_name, l.customer_segment, l.nationality_country_sk,
         date '2002-01-01' as effective_from_date, cast(null as date) as effective_to_date, true as is_current_record
  from latest l where l.customer_nk in (select customer_nk from changed) or l.customer_nk in (select customer_nk from fresh))
select * from kept union all select * from added
"""

_SCD1 = """
with latest as (select customer_nk, full_name, customer_segment, nationality_country_sk from customer_changes)
select d.customer_sk, d.customer_nk,
       case when l.customer_nk is not null then l.full_name else d.full_name end as full_name,
       case when l.customer_nk is not null then l.customer_segment else d.customer_segment end as customer_segment,
       case when l.customer_nk is not null then l.nationality_country_sk else d.nationality_country_sk end as nationality_country_sk
from customer_type1 d left join latest l on l.customer_nk = d.customer_nk
union all
select (select max(customer_sk) from customer_type1) + row_number() over (order by l.customer_nk), l.customer_nk,
       l.full_name, l.customer_segment, l.nationality_country_sk
from latest l where l.customer_nk not in (select customer_nk from customer_type1)
"""

_SCD2_CHECK = """
with v as (
  select customer_nk, effective_from_date as f, effective_to_date as t, is_current_record as c,
         lag(effective_to_date) over w as prev_to, lag(1) over w as prev_exists
  from customer_versions
  window w as (partition by customer_nk order by effective_from_date, effective_to_date nulls last)),
issues as (
  select customer_nk, 'overlap' as issue from v where prev_exists is not null and (prev_to is null or prev_to > f)
  union all select customer_nk, 'reversed' from v where t < f
  union all select customer_nk, 'current_not_open' from v where c and t is not null
  union all select customer_nk, 'closed_but_open' from v where not c and t is null
  union all select customer_nk, case when sum(case when is_current_record then 1 else 0 end) > 1 then 'multiple_current'
                                     when sum(case when is_current_record then 1 else 0 end) = 0 then 'no_current' end
            from customer_versions group by customer_nk
            having sum(case when is_current_record then 1 else 0 end) <> 1)
select customer_nk, issue, count(*) as rows from issues group by customer_nk, issue
"""

_DIM_DATE = """
with span as (select (select min(cast(o_orderdate as date)) from orders) as s, (select max(cast(l_shipdate as date)) from lineitem) as e),
days as (select cast(g as date) as d from span, generate_series(span.s, span.e, interval 1 day) t(g)),
x as (select d, ((month(d) - 4 + 12) % 12) + 1 as fm from days)
select cast(year(d) * 10000 + month(d) * 100 + day(d) as int) as date_sk, d as full_date,
       cast(isodow(d) as smallint) as day_of_week_num, dayname(d) as day_of_week_name,
       cast(day(d) as smallint) as day_of_month, cast(weekofyear(d) as smallint) as week_of_year,
       cast(month(d) as smallint) as month_num, monthname(d) as month_name,
       cast(quarter(d) as smallint) as quarter_num, 'Q' || cast(quarter(d) as varchar) as quarter_name,
       cast(year(d) as smallint) as calendar_year,
       cast(year(d) + case when month(d) >= 4 then 1 else 0 end as smallint) as fiscal_year,
       cast((fm - 1) // 3 + 1 as smallint) as fiscal_quarter, cast(fm as smallint) as fiscal_month,
       isodow(d) >= 6 as is_weekend,
       ((month(d) = 1 and day(d) = 1) or (month(d) = 12 and day(d) = 25)) as is_public_holiday,
       not (isodow(d) >= 6) and not ((month(d) = 1 and day(d) = 1) or (month(d) = 12 and day(d) = 25)) as is_bank_working_day,
       d = last_day(d) as is_month_end, d = last_day(d) and month(d) % 3 = 0 as is_quarter_end,
       month(d) = 12 and day(d) = 31 as is_year_end, d = last_day(d) as is_fiscal_month_end,
       cast(day(last_day(d)) as smallint) as days_in_month, cast(day(last_day(d)) - day(d) as smallint) as days_remaining_month,
       cast(year(d - interval 12 month) * 10000 + month(d - interval 12 month) * 100 + day(d - interval 12 month) as int) as prior_year_date_sk
from x
"""

_ROLL_FORWARD = """
with g as (
  select gl_account_sk, branch_sk, period_end_date_sk, closing_balance_rcy, budget_amount,
         cast(strptime(cast(period_end_date_sk as varchar), '%Y%m%d') as date) as pd
  from fact_gl_balance where period_type = 'MONTHLY'),
h as (select *, cast(year(pd) as int) as fiscal_year,
             cast(year(last_day(pd - interval 12 month)) * 10000 + month(last_day(pd - interval 12 month)) * 100
                  + day(last_day(pd - interval 12 month)) as int) as prior_key from g)
select h.gl_account_sk, h.branch_sk, cast(h.period_end_date_sk as int) as period_end_date_sk, h.fiscal_year, h.closing_balance_rcy,
       cast(sum(h.closing_balance_rcy) over (partition by h.gl_account_sk, h.branch_sk, h.fiscal_year
            order by h.period_end_date_sk rows between unbounded preceding and current row) as decimal(22,2)) as ytd_balance,
       p.closing_balance_rcy as prior_year_closing,
       cast(h.closing_balance_rcy - coalesce(h.budget_amount, 0) as decimal(23,2)) as variance_vs_budget
from h left join (select gl_account_sk, branch_sk, period_end_date_sk, closing_balance_rcy from fact_gl_balance
                  where period_type = 'MONTHLY') p
  on p.gl_account_sk = h.gl_account_sk and p.branch_sk = h.branch_sk and p.period_end_date_sk = h.prior_key
"""

OPERATORS = {
    "key_high_water": _key_high_water(),
    "partition_layout": f"""
select {_label('booking_date_sk')} as booking_year, count(*) as rows, cast(min(booking_date_sk) as int) as min_key,
       cast(max(booking_date_sk) as int) as max_key
from fact_transaction group by 1
""",
    "pruned_transactions": f"""
select {_label('booking_date_sk')} as booking_year, count(*) as rows,
       cast(sum(amount_txn_ccy) as decimal(38,2)) as amount
from fact_transaction where booking_date_sk between 19970601 and 19980315 group by 1
""",
    "append_new_accounts": """
select o_orderkey, o_custkey,
       (select max(account_sk) from dim_account) + row_number() over (order by o_orderkey) as new_account_sk
from orders where o_orderkey not in (select account_sk from dim_account)
""",
    "payment_statistics": _payment_statistics(),
    "dim_date_generated": _DIM_DATE,
    "reporting_currency_amounts": """
select t.account_sk, t.booking_date_sk, t.booking_date, t.amount_txn_ccy, t.currency_code,
       case when t.currency_code = 'USD' then cast(1 as decimal(15,8)) else r.rate_value end as fx_rate_applied,
       cast(round(cast(t.amount_txn_ccy as decimal(20,2))
                  * case when t.currency_code = 'USD' then cast(1 as decimal(15,8)) else r.rate_value end, 2)
            as decimal(20,2)) as amount_reporting_ccy
from transactions_with_currency t
asof left join (select from_currency_code, rate_date, rate_value from dated_exchange_rate
                where to_currency_code = 'USD' and rate_type = 'MID_RATE') r
  on t.currency_code = r.from_currency_code and t.booking_date >= r.rate_date
""",
    "balance_snapshots": """
with daily as (
  select account_sk, cast(transaction_datetime as date) as snapshot_date,
         cast(sum(case when is_credit then amount_txn_ccy else 0 end) as decimal(20,2)) as credit_amount_day,
         cast(sum(case when is_credit then 0 else amount_txn_ccy end) as decimal(20,2)) as debit_amount_day,
         cast(count(*) as int) as transaction_count_day
  from fact_transaction group by 1, 2),
b as (
  select account_sk, cast(year(snapshot_date) * 10000 + month(snapshot_date) * 100 + day(snapshot_date) as int) as snapshot_date_sk,
         snapshot_date, credit_amount_day, debit_amount_day, transaction_count_day,
         cast(sum(credit_amount_day - debit_amount_day) over (partition by account_sk order by snapshot_date
              rows between unbounded preceding and current row) as decimal(20,2)) as current_balance,
         cast(datediff('day', lag(snapshot_date) over (partition by account_sk order by snapshot_date), snapshot_date) as int) as days_since_previous_txn
  from daily)
select *, current_balance < 0 as is_overdrawn from b
""",
    "month_end_balances": """
with daily as (
  select account_sk, cast(transaction_datetime as date) as snapshot_date,
         cast(sum(case when is_credit then amount_txn_ccy else 0 end) as decimal(20,2)) as credit_amount_day,
         cast(sum(case when is_credit then 0 else amount_txn_ccy end) as decimal(20,2)) as debit_amount_day,
         cast(count(*) as int) as transaction_count_day
  from fact_transaction group by 1, 2),
iv as (
  select *, cast(sum(credit_amount_day - debit_amount_day) over (partition by account_sk order by snapshot_date
              rows between unbounded preceding and current row) as decimal(20,2)) as current_balance,
         lead(snapshot_date) over (partition by account_sk order by snapshot_date) as next_day
  from daily),
me as (select distinct full_date as d from dim_date where full_date = last_day(full_date))
select iv.account_sk, cast(year(me.d) * 10000 + month(me.d) * 100 + day(me.d) as int) as snapshot_date_sk,
       me.d as snapshot_date,
       case when me.d = iv.snapshot_date then iv.credit_amount_day else cast(0 as decimal(20,2)) end as credit_amount_day,
       case when me.d = iv.snapshot_date then iv.debit_amount_day else cast(0 as decimal(20,2)) end as debit_amount_day,
       case when me.d = iv.snapshot_date then iv.transaction_count_day else 0 end as transaction_count_day,
       iv.current_balance, cast(datediff('day', iv.snapshot_date, me.d) as int) as days_since_last_txn,
       iv.current_balance < 0 as is_overdrawn
from iv join me on me.d >= iv.snapshot_date and (iv.next_day is null or me.d < iv.next_day)
""",
    "past_due_buckets": """
select case when d is null then null when d <= 0 then '0' when d <= 30 then '1-30' when d <= 60 then '31-60'
            when d <= 90 then '61-90' when d <= 180 then '91-180' else '180+' end as dpd_bucket,
       count(*) as loans, cast(sum(case when d > 90 then 1 else 0 end) as bigint) as npl_loans
from (select l_partkey % 200 as d from lineitem) x group by 1
""",
    "expected_loss_check": """
with l as (select *, cast(round(cast(ecl_pd as decimal(8,6)) * cast(ecl_lgd as decimal(8,6))
                               * cast(total_outstanding_rcy as decimal(20,2)), 2) as decimal(20,2)) as el
           from fact_loan_daily_snapshot)
select ifrs9_stage, credit_grade, count(*) as loans, cast(sum(el) as decimal(38,2)) as expected_loss,
       cast(sum(ecl_provision_amount) as decimal(38,2)) as stored_provision,
       cast(sum(case when abs(el - ecl_provision_amount) > 0.01 then 1 else 0 end) as bigint) as mismatches
from l group by ifrs9_stage, credit_grade
""",
    "loan_to_value": f"""
with e as (select account_sk, cast(sum(total_outstanding_rcy) as decimal(20,2)) as exposure
           from fact_loan_daily_snapshot group by account_sk),
c as ({_PER_LOAN})
select e.account_sk, e.exposure, c.allocated_collateral_value,
       {_exact_ratio('e.exposure', 'c.allocated_collateral_value', 4)} as loan_to_value_ratio
from e left join c on c.account_sk = e.account_sk
""",
    "collateral_allocation": _PER_LOAN,
    "over_allocated_collateral": """
select collateral_sk, cast(sum(allocation_percentage) as decimal(12,2)) as total_allocation_pct, count(*) as loan_count
from bridge_loan_collateral group by collateral_sk having sum(allocation_percentage) > 100
""",
    "weighted_customer_balance": """
with bal as (select account_sk, current_balance from fact_account_balance_daily
             where snapshot_date_sk = (select max(snapshot_date_sk) from fact_account_balance_daily))
select b.customer_sk, count(*) as account_count,
       cast(sum(cast(bal.current_balance * b.ownership_weight * 0.01 as decimal(38,6))) as decimal(24,4)) as weighted_balance
from bal join bridge_account_customer b on b.account_sk = bal.account_sk
where b.is_current group by b.customer_sk
""",
    "ownership_weight_check": """
select account_sk, cast(sum(ownership_weight) as decimal(12,2)) as total_weight, count(*) as owner_count
from bridge_account_customer where is_current group by account_sk having sum(ownership_weight) <> 100
""",
    "gl_roll_forward": _ROLL_FORWARD,
    "masked_customers": """
select customer_sk, sha256('ledgermart-test-salt' || full_name) as full_name, right(customer_number, 4) as customer_number,
       cast(date_trunc('year', acquisition_date) as date) as acquisition_date
from dim_customer where is_current_record
""",
    "account_dormancy": """
with last as (select account_sk, max(cast(transaction_datetime as date)) as last_txn_date from fact_transaction group by account_sk),
as_of_day as (select max(cast(transaction_datetime as date)) as d from fact_transaction)
select a.account_sk, l.last_txn_date, cast(datediff('day', l.last_txn_date, (select d from as_of_day)) as int) as days_inactive,
       coalesce(datediff('day', l.last_txn_date, (select d from as_of_day)) >= 365, true) as is_dormant_flag
from (select distinct account_sk from dim_account) a left join last l on l.account_sk = a.account_sk
""",
    "ledger_rollup": """
select gl.account_class, gl.level1_name, gl.level2_name,
       cast(grouping_id(gl.account_class, gl.level1_name, gl.level2_name) as int) as grouping_level,
       count(*) as row_count, cast(sum(g.closing_balance_rcy) as decimal(38,2)) as total_balance
from fact_gl_balance g join dim_gl_account gl on gl.gl_account_sk = g.gl_account_sk
where g.period_type = 'MONTHLY'
group by rollup(gl.account_class, gl.level1_name, gl.level2_name)
""",
    "scd1_customer_upsert": _SCD1,
    "scd2_customer_apply": _SCD2,
    "scd2_history_check": _SCD2_CHECK,
    "customers_as_of": """
select customer_sk, customer_nk, customer_segment from customer_versions
where effective_from_date <= date '1997-06-30' and (effective_to_date is null or date '1997-06-30' < effective_to_date)
""",
    "alert_milestones": f"""
with s as ({_ALERTS})
select alert_id, {', '.join(f'{m}_date' for m in _MILESTONES)},
       cast(datediff('day', generated_date, assigned_date) as int) as days_to_assign,
       cast(datediff('day', generated_date, closed_date) as int) as days_to_close,
       case when closed_date is not null then 'CLOSED' when escalated_date is not null then 'ESCALATED'
            when reviewed_date is not null then 'UNDER_REVIEW' when assigned_date is not null then 'ASSIGNED'
            else 'OPEN' end as alert_status
from s
""",
    "alert_milestone_calendar": f"""
with s as ({_ALERTS})
select s.alert_id,
       cast(year(s.generated_date) * 10000 + month(s.generated_date) * 100 + day(s.generated_date) as int) as generated_date_sk,
       cast(year(s.assigned_date) * 10000 + month(s.assigned_date) * 100 + day(s.assigned_date) as int) as assigned_date_sk,
       cast(year(s.reviewed_date) * 10000 + month(s.reviewed_date) * 100 + day(s.reviewed_date) as int) as reviewed_date_sk,
       cast(year(s.escalated_date) * 10000 + month(s.escalated_date) * 100 + day(s.escalated_date) as int) as escalated_date_sk,
       cast(year(s.closed_date) * 10000 + month(s.closed_date) * 100 + day(s.closed_date) as int) as closed_date_sk,
       cast(year(s.sar_filed_date) * 10000 + month(s.sar_filed_date) * 100 + day(s.sar_filed_date) as int) as sar_filed_date_sk,
       d_generated.month_name as generated_month_name, d_generated.fiscal_quarter as generated_fiscal_quarter,
       d_assigned.month_name as assigned_month_name, d_assigned.fiscal_quarter as assigned_fiscal_quarter,
       d_reviewed.month_name as reviewed_month_name, d_reviewed.fiscal_quarter as reviewed_fiscal_quarter,
       d_escalated.month_name as escalated_month_name, d_escalated.fiscal_quarter as escalated_fiscal_quarter,
       d_closed.month_name as closed_month_name, d_closed.fiscal_quarter as closed_fiscal_quarter,
       d_sar_filed.month_name as sar_filed_month_name, d_sar_filed.fiscal_quarter as sar_filed_fiscal_quarter
from s
left join dim_date d_generated on d_generated.date_sk = year(s.generated_date) * 10000 + month(s.generated_date) * 100 + day(s.generated_date)
left join dim_date d_assigned on d_assigned.date_sk = year(s.assigned_date) * 10000 + month(s.assigned_date) * 100 + day(s.assigned_date)
left join dim_date d_reviewed on d_reviewed.date_sk = year(s.reviewed_date) * 10000 + month(s.reviewed_date) * 100 + day(s.reviewed_date)
left join dim_date d_escalated on d_escalated.date_sk = year(s.escalated_date) * 10000 + month(s.escalated_date) * 100 + day(s.escalated_date)
left join dim_date d_closed on d_closed.date_sk = year(s.closed_date) * 10000 + month(s.closed_date) * 100 + day(s.closed_date)
left join dim_date d_sar_filed on d_sar_filed.date_sk = year(s.sar_filed_date) * 10000 + month(s.sar_filed_date) * 100 + day(s.sar_filed_date)
""",
    "orders_customer_version": """
select o.o_orderkey, o.o_custkey, cast(o.o_orderdate as date) as order_date, v.customer_sk as customer_version_sk
from orders o left join customer_versions v on v.customer_nk = o.o_custkey
  and v.effective_from_date <= cast(o.o_orderdate as date)
  and (v.effective_to_date is null or cast(o.o_orderdate as date) < v.effective_to_date)
""",
    "load_rejects": """
select reason, count(*) as rejected_rows from (select unnest([
    case when account_sk % 97 = 5 then 'type:customer_sk' end, case when account_sk % 83 = 11 then 'type:currency_sk' end,
    case when account_sk % 89 = 7 then 'type:is_current_record' end, case when account_sk % 89 = 7 then 'not_null:is_current_record' end,
    case when account_sk % 79 = 3 then 'domain:account_status' end, case when account_sk % 71 = 2 then 'type:open_date' end,
    case when account_sk % 73 = 1 then 'not_null:account_nk' end]) as reason from dim_account)
where reason is not null group by reason
""",
    "gl_closing_balance": """
select account_sk, cast(100 + sum(amount_txn_ccy * (case when is_credit = (account_sk % 2 = 1) then 1 else -1 end)) as decimal(38,2))
       as closing_balance
from fact_transaction group by account_sk
""",
}
# H2 with a history: what holds on every day on which something is stated
_SPLICE = """
with ch as (
  select customer_nk as nk, cast(change_ts as date) as d, customer_segment as seg from customer_order_changes
  where change_ts is not null and customer_nk is not null
  qualify row_number() over (partition by customer_nk, cast(change_ts as date) order by change_ts desc, customer_segment desc) = 1),
v as (select customer_nk as nk, effective_from_date as d, effective_to_date as e, customer_sk as sk, full_name, customer_segment as seg,
             nationality_country_sk as nat from customer_versions where customer_nk in (select nk from ch)),
gaps as (select nk, e as d from v where e is not null and not exists (
           select 1 from v o where o.nk = v.nk and o.d <= v.e and (o.e is null or o.e > v.e))),
points as (select nk, d, max(vd) as vd, max(cd) as cd, max(gd) as gd from (
    select nk, d, d as vd, null as cd, null as gd from v union all select nk, d, null, d, null from ch
    union all select nk, d, null, null, d from gaps) group by nk, d),
state as (select nk, d, lead(d) over w as next_d, max(vd) over w as vd, max(cd) over w as cd, max(gd) over w as gd,
                 vd is not null as starts from points window w as (partition by nk order by d)),
held as (
  select s.nk, s.d, s.next_d, coalesce(s.gd > s.vd, s.gd is not null) and coalesce(s.gd > s.cd, true) as absent, own.sk,
         coalesce(v.full_name, f.full_name) as full_name, coalesce(v.nat, f.nat) as nat,
         case when s.cd is not null and (s.vd is null or s.cd >= s.vd) then ch.seg else v.seg end as seg
  from state s left join v on v.nk = s.nk and v.d = s.vd left join ch on ch.nk = s.nk and ch.d = s.cd
  left join (select nk, min(d) as d from v group by nk) fd on fd.nk = s.nk left join v f on f.nk = fd.nk and f.d = fd.d
  left join v own on own.nk = s.nk and own.d = s.d),
marked as (select *, case when lag(absent) over w = false and absent = false and lag(full_name) over w is not distinct from full_name
                and lag(seg) over w is not distinct from seg and lag(nat) over w is not distinct from nat then 0 else 1 end as fresh
           from held window w as (partition by nk order by d)),
isl as (select *, sum(fresh) over (partition by nk order by d) as island from marked),
merged as (select nk, min(d) as d, nullif(max(coalesce(next_d, date '9999-12-31')), date '9999-12-31') as e, any_value(full_name) as full_name,
                  any_value(seg) as seg, any_value(nat) as nat, arg_min(sk, d) filter (where sk is not null) as sk
           from isl where not absent group by nk, island),
keyed as (select *, (select max(customer_sk) from customer_versions) + row_number() over (partition by sk is null order by nk, d) as new_sk from merged)
select customer_sk, customer_nk, full_name, customer_segment, nationality_country_sk, effective_from_date, effective_to_date, is_current_record
from customer_versions where customer_nk not in (select nk from ch)
union all
select coalesce(sk, new_sk), nk, full_name, seg, nat, d, e, e is null from keyed
"""
OPERATORS["scd2_history_splice"] = _SPLICE
OPERATORS["pruned_stored_transactions"] = f"""
select {_label('booking_date_sk')} as booking_year, customer_sk, count(*) as rows, cast(sum(amount_txn_ccy) as decimal(38,2)) as amount
from fact_transaction where booking_date_sk between 19970601 and 19980315 and customer_sk in (1, 2, 4, 5, 7, 8, 10, 11, 13, 14) group by 1, 2
"""
OPERATORS["payment_sketches"] = "\nunion all\n".join(
    f"select '{c}' as column_name, count(*) as row_count, cast(sum(case when {c} is null then 1 else 0 end) as bigint) as null_count, "
    f"cast(min({c}) as varchar) as min_value, cast(max({c}) as varchar) as max_value, true as distinct_is_near, "
    f"{'null' if c == 'payment_type' else 'true'} as has_quantiles from fact_payment_order"
    for c in ("payment_nk", "instruction_date_sk", "debtor_customer_sk", "payment_type", "payment_amount_rcy", "processing_time_seconds"))
OPERATORS["unique_key_duplicates"] = """
select 'dim_product' as table_name, p_brand as code, count(*) as cnt from part where p_partkey % 10 <> 0 and p_brand is not null group by p_brand having count(*) > 1
union all select 'dim_gl_account', 'GL' || (p_partkey % 20), count(*) from part where p_partkey % 7 <> 0 group by 2 having count(*) > 1
union all select 'dim_currency', 'C' || (r_regionkey % 3), count(*) from region group by 2 having count(*) > 1
"""
OPERATORS["long_text_rejects"] = """
select reason, count(*) as rejected_rows from (select unnest([case when c_custkey % 61 = 9 then 'fit:full_name' end,
    case when c_custkey % 53 = 4 then 'fit:age_band' end]) as reason from customer) where reason is not null group by reason
"""
OPERATORS["gl_ytd_movement"] = _ROLL_FORWARD.replace(
    "with g as (", "with m as (select *, closing_balance_rcy - coalesce(lag(closing_balance_rcy) over (partition by gl_account_sk, branch_sk, "
    "period_type order by period_end_date_sk), 0) as moved from fact_gl_balance),\ng as (", 1).replace(
    "closing_balance_rcy, budget_amount,", "closing_balance_rcy, budget_amount, moved,", 1).replace(
    "from fact_gl_balance where period_type = 'MONTHLY'),", "from m where period_type = 'MONTHLY'),", 1).replace(
    "cast(sum(h.closing_balance_rcy) over", "cast(sum(h.moved) over", 1)
OPERATORS["alert_facts_merged"] = OPERATORS["alert_milestones"].replace("\nselect alert_id, generated_date", "\nselect s.alert_id, generated_date").replace(
    "\nfrom s\n", ",\n       f.ts as stated_at, f.event_id as triggering_event_sk, cast(f.value as decimal(20,2)) as alert_amount_rcy\nfrom s "
    "left join (select user_id, ts, event_id, value from events qualify row_number() over (partition by user_id order by ts, event_id, value) = 1) f "
    "on f.user_id = s.alert_id\n")
OPERATORS["key_high_water_all"] = "\nunion all\n".join(
    f"select '{t}' as table_name, '{S.key_column(t)}' as key_column, true as present, cast(max({S.key_column(t)}) as bigint) as last_key, "
    f"cast(coalesce(max({S.key_column(t)}), 0) + 1 as bigint) as next_key from {t}" if S.key_column(t) in VIEW_COLUMNS.get(t, [])
    else f"select '{t}', '{S.key_column(t)}', false, cast(null as bigint), cast(1 as bigint)"
    for t in S.TABLES if S.key_column(t))
OPERATORS["manager_chain"] = """
with recursive walk(employee_sk, here, depth, seen) as (
  select employee_sk, employee_sk, cast(0 as bigint), [employee_sk] from employees
  union all
  select w.employee_sk, m.employee_sk, w.depth + 1, list_append(w.seen, m.employee_sk)
  from walk w join employees e on e.employee_sk = w.here join employees m on m.employee_sk = e.manager_employee_sk
  where len(w.seen) = len(list_distinct(w.seen))),
ends as (select employee_sk, arg_max(here, depth) as here, max(depth) as depth, arg_max(seen, depth) as seen from walk group by employee_sk),
said as (select *, len(seen) <> len(list_distinct(seen)) as loops from ends)
select s.employee_sk, case when not loops then depth end as depth, case when not loops then here end as top,
       case when loops and s.employee_sk = here then 'cycle' when loops then 'below_cycle'
            when e.manager_employee_sk is not null and depth = 0 then 'orphan' end as issue
from said s join employees e on e.employee_sk = s.employee_sk
"""
_LEVELS = ["account_class", "level1_name", "level2_name", "level3_name", "level4_name", "level5_name"]
OPERATORS["ledger_rollup_ragged"] = "\nunion all\n".join(
    "select " + ", ".join(c if i < n else f"cast(null as varchar) as {c}" for i, c in enumerate(_LEVELS))
    + f", {n} as depth, count(*) as row_count, cast(sum(g.closing_balance_rcy) as decimal(38,2)) as total_balance "
    + "from fact_gl_balance g join gl_account_levels a on a.gl_account_sk = g.gl_account_sk where g.period_type = 'MONTHLY'"
    + (f" and coalesce({', '.join(_LEVELS[n - 1:])}) is not null" if n else "")
    + (f" group by {', '.join(_LEVELS[:n])}" if n else "") for n in range(len(_LEVELS) + 1))
OPERATORS["masked_customers_declared"] = """
select * replace (sha256('ledgermart-test-salt' || full_name) as full_name) from dim_customer
"""
OPERATORS["orphan_transaction_rows"] = """
select t.account_sk, t.booking_date_sk, t.amount_txn_ccy from fact_transaction t left join (select distinct account_sk from dim_account) a
  on a.account_sk = t.account_sk where a.account_sk is null
"""
OPERATORS["ifrs9_portfolio_function"] = """
select snapshot_date, ifrs9_stage, dpd_bucket, count(*) as loans, cast(sum(total_outstanding_rcy) as decimal(38,2)) as exposure_usd,
       cast(cast((2 * cast(sum(ecl_pd * 1000000) as hugeint) + 100 * count(ecl_pd))
                 // nullif(200 * count(ecl_pd), 0) as decimal(18,0)) * 0.0001 as decimal(18,4)) as avg_pd
from (select l.*, d.full_date as snapshot_date from fact_loan_daily_snapshot l join dim_date d on d.date_sk = l.snapshot_date_sk)
where snapshot_date in (date '1996-06-30', date '1997-01-31') group by all
"""
OPERATORS["interval_rate_amounts"] = """
with t as (select *, row_number() over () as id from transactions_with_currency),
best as (select t.id, arg_max(r.rate_value, (r.valid_from_datetime, r.rate_value)) as rate
         from t join interval_exchange_rate r on r.from_currency_code = t.currency_code and r.valid_from_datetime <= cast(t.booking_date as timestamp)
              and (r.valid_to_datetime is null or cast(t.booking_date as timestamp) < r.valid_to_datetime) group by t.id)
select t.account_sk, t.booking_date, t.amount_txn_ccy, t.currency_code, best.rate as fx_rate_applied,
       cast(round(cast(t.amount_txn_ccy as decimal(20,2)) * best.rate, 2) as decimal(20,2)) as amount_reporting_ccy
from t left join best on best.id = t.id
"""
OPERATORS["rate_interval_check"] = """
with r as (select from_currency_code, valid_from_datetime as s, coalesce(valid_to_datetime, timestamp '9999-12-31') as e from interval_exchange_rate),
w as (select *, max(e) over (partition by from_currency_code order by s, e rows between unbounded preceding and 1 preceding) as ended
      from r where s < e)
select from_currency_code, issue, count(*) as rows from (
  select from_currency_code, case when s < ended then 'overlap' when s > ended then 'gap' end as issue from w
  union all select from_currency_code, 'reversed' from r where s >= e) where issue is not null group by from_currency_code, issue
"""
OPERATORS["alert_milestones_merged"] = OPERATORS["alert_milestones"]
