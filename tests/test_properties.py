"""Properties and brute-force checks on small inputs."""

from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgermart.operators import derive, quality
from ledgermart.plans import marts
from ledgermart.sources import schemas as S


def test_orphans_plus_semi_join_equal_the_facts(frames):
    t, a = frames["fact_transaction"], frames["dim_account"]
    orphans = quality.orphan_check(t, a, "account_sk", "account_sk").first().orphan_rows
    matched = t.join(a.select("account_sk"), "account_sk", "left_semi").count()
    assert orphans > 0 and orphans + matched == t.count()


def test_mart_counts_add_up_to_the_facts(frames):
    alerts = marts.aml_compliance(frames).agg(F.sum("alert_count")).first()[0]
    assert alerts == frames["fact_aml_alert"].count()          # left joins keep every alert
    pays = marts.payments_analytics(frames).agg(F.sum("payment_count")).first()[0]
    assert pays == frames["fact_payment_order"].count()
    loans = marts.credit_risk_portfolio(frames).agg(F.sum("loan_count")).first()[0]
    cur = frames["dim_customer"].filter("is_current_record").select("customer_sk")
    assert loans == frames["fact_loan_daily_snapshot"].join(cur, "customer_sk", "left_semi").count()


def test_rollup_totals_equal_direct_sums(frames):
    r = derive.ledger_rollup(frames["fact_gl_balance"], frames["dim_gl_account"],
                             ["account_class", "level1_name", "level2_name"])
    grand = r.filter("grouping_level = 7").first()
    g = frames["fact_gl_balance"].filter("period_type = 'MONTHLY'").join(
        frames["dim_gl_account"].select("gl_account_sk"), "gl_account_sk")
    assert grand.row_count == g.count()
    assert grand.total_balance == g.agg(F.sum("closing_balance_rcy")).first()[0]
    per_class = r.filter("grouping_level = 3").agg(F.sum("total_balance")).first()[0]
    assert per_class == grand.total_balance


def test_gl_closing_by_normal_side(spark):
    t = spark.createDataFrame([(D("100"), D("30"), D("10"), "DEBIT"), (D("100"), D("30"), D("10"), "CREDIT"),
                               (D("100"), None, D("10"), "CREDIT")],
                              "o decimal(20,2), d decimal(20,2), c decimal(20,2), side string")
    got = [r.x for r in t.select(derive.gl_closing("o", "d", "c", "side").alias("x")).collect()]
    assert got == [D("120.00"), D("80.00"), D("110.00")]


DOMAIN = ("LOW", "MEDIUM", "HIGH", "BLACKLIST")
rows = st.lists(st.tuples(
    st.one_of(st.none(), st.text(alphabet="ABC", min_size=0, max_size=5)),      # country_code, max 3, NOT NULL
    st.one_of(st.none(), st.text(alphabet="xy", min_size=0, max_size=103)),     # country_name, max 100, NOT NULL
    st.one_of(st.none(), st.sampled_from(DOMAIN + ("PURPLE", "low"))),          # aml_risk_rating, domain
), min_size=0, max_size=25)


def brute_force_reasons(row):
    code, name, risk = row
    cols = {c.name: c for c in S.columns("country")}
    out = []
    for col, v in (("country_code", code), ("country_name", name), ("aml_risk_rating", risk)):
        c = cols[col]
        if not c.nullable and v is None:
            out.append(f"not_null:{col}")
        if c.domain and v is not None and v not in c.domain:
            out.append(f"domain:{col}")
        if c.max_len and v is not None and len(v) > c.max_len:
            out.append(f"fit:{col}")
    return sorted(out)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows)
def test_split_valid_against_brute_force(spark, data):
    df = spark.createDataFrame(data, "country_code string, country_name string, aml_risk_rating string")
    good, bad = quality.split_valid(df, "country")
    g, b = good.collect(), bad.collect()
    assert len(g) + len(b) == len(data)
    def key(t):
        return tuple("\0" if v is None else v for v in t[:3]) + (t[3],)
    want_bad = sorted((tuple(r) + (tuple(brute_force_reasons(r)),) for r in data if brute_force_reasons(r)), key=key)
    got_bad = sorted(((r.country_code, r.country_name, r.aml_risk_rating, tuple(sorted(r.reject_reasons)))
                      for r in b), key=key)
    assert got_bad == want_bad
    prof = {(r.column_name, r.rule): r.failing_rows for r in quality.column_profile(df, "country").collect()}
    assert prof[("country_code", "not_null")] == sum(1 for r in data if r[0] is None)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(0, 10**6)), min_size=1, max_size=30))
def test_count_pct_equals_exact_half_up(spark, pairs):
    from decimal import ROUND_HALF_UP

    from ledgermart.functions.metrics import count_pct
    t = spark.createDataFrame(pairs, "k long, n long")
    got = [r.p for r in t.select(count_pct(F.col("k"), F.col("n")).alias("p")).collect()]
    want = [None if n == 0 else (D(100) * k / D(n)).quantize(D("0.01"), rounding=ROUND_HALF_UP) for k, n in pairs]
    assert got == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 5), min_size=0, max_size=60), st.integers(1, 7), st.integers(0, 100))
def test_keys_are_dense_and_ordered_for_any_layout(spark, values, parts, base):
    from ledgermart.sources import load
    new = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(parts)
    existing = spark.createDataFrame([(base,)], "k long")
    rows = load.append_with_keys(new, existing, "k", ["v"], num_partitions=parts).collect()
    keys = sorted(r.k for r in rows)
    assert keys == list(range(base + 1, base + 1 + len(values)))
    by_key = [r.v for r in sorted(rows, key=lambda r: r.k)]
    assert by_key == sorted(values)                      # keys follow the order column


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["EUR", "GBP"]), st.integers(0, 60), st.integers(1, 999)),
                min_size=0, max_size=12),
       st.lists(st.tuples(st.sampled_from(["EUR", "GBP", "JPY"]), st.integers(0, 70)), min_size=1, max_size=15))
def test_dated_rate_lookup_against_brute_force(spark, rates, facts):
    import datetime as dt

    from ledgermart.operators.joins import latest_rate_on_or_before
    day0 = dt.date(2024, 1, 1)
    # one rate per (currency, day): the lookup keeps the largest when a day repeats
    rate_rows = [(c, day0 + dt.timedelta(days=d), D(v)) for c, d, v in rates]
    fact_rows = [(i, c, day0 + dt.timedelta(days=d)) for i, (c, d) in enumerate(facts)]
    r = spark.createDataFrame(rate_rows, "ccy string, rate_date date, rate_value decimal(15,8)")
    f = spark.createDataFrame(fact_rows, "id int, ccy string, d date")
    got = {row.id: row.rate_value for row in latest_rate_on_or_before(f, r, ["ccy"], "d").collect()}

    def brute(c, d):
        best = {}
        for rc, rd, rv in rate_rows:
            if rc == c and rd <= d:
                best[rd] = max(best.get(rd, rv), rv)
        return best[max(best)] if best else None

    assert len(got) == len(fact_rows)
    for i, c, d in fact_rows:
        want = brute(c, d)
        assert got[i] == (None if want is None else want.quantize(D("0.00000001")))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 40), st.one_of(st.none(), st.integers(1, 30))),
                min_size=0, max_size=8),
       st.lists(st.tuples(st.integers(1, 4), st.integers(0, 80)), min_size=1, max_size=12))
def test_as_of_join_against_brute_force(spark, versions, facts):
    import datetime as dt

    from ledgermart.operators.joins import as_of_join
    day0 = dt.date(2024, 1, 1)
    vrows = [(i, nk, day0 + dt.timedelta(days=f), None if span is None else day0 + dt.timedelta(days=f + span))
             for i, (nk, f, span) in enumerate(versions)]
    frows = [(j, nk, day0 + dt.timedelta(days=d)) for j, (nk, d) in enumerate(facts)]
    v = spark.createDataFrame(vrows, "ver int, nk int, effective_from_date date, effective_to_date date")
    f = spark.createDataFrame(frows, "id int, nk int, d date")
    got = sorted((r.id, r.ver) for r in as_of_join(f, v, "nk", "nk", "d", {"ver": "ver"}).collect())
    want = []
    for j, nk, d in frows:
        hits = [i for i, vnk, fr, to in vrows if vnk == nk and fr <= d and (to is None or d < to)]
        want += [(j, i) for i in hits] or [(j, None)]
    key = lambda t: (t[0], -1 if t[1] is None else t[1])
    assert sorted(got, key=key) == sorted(want, key=key)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 150), st.integers(1, 500), st.booleans()),
                min_size=1, max_size=15),
       st.lists(st.integers(0, 200), min_size=1, max_size=8, unique=True))
def test_periodic_balance_snapshot_against_brute_force(spark, txns, snap_days):
    import datetime as dt

    day0 = dt.date(2024, 1, 1)
    t_rows = [(a, dt.datetime.combine(day0 + dt.timedelta(days=d), dt.time(12)), D(v), c) for a, d, v, c in txns]
    t = spark.createDataFrame(t_rows, "account_sk long, transaction_datetime timestamp_ntz, "
                                      "amount_txn_ccy decimal(20,2), is_credit boolean")
    dates = spark.createDataFrame([(day0 + dt.timedelta(days=d),) for d in snap_days], "full_date date")
    got = sorted((r.account_sk, r.snapshot_date, r.current_balance, r.days_since_last_txn, r.transaction_count_day)
                 for r in derive.balance_snapshot(t, dates).collect())
    want = []
    for a in sorted({x[0] for x in txns}):
        mine = [(day0 + dt.timedelta(days=d), D(v) if c else -D(v)) for aa, d, v, c in txns if aa == a]
        first = min(d for d, _ in mine)
        for sd in sorted(day0 + dt.timedelta(days=d) for d in snap_days):
            if sd < first:
                continue
            upto = [(d, x) for d, x in mine if d <= sd]
            last = max(d for d, _ in upto)
            want.append((a, sd, sum(x for _, x in upto), (sd - last).days, sum(1 for d, _ in mine if d == sd)))
    assert got == sorted(want)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 6)), st.one_of(st.none(), st.integers(0, 6))),
                min_size=0, max_size=20),
       st.lists(st.integers(0, 6), min_size=0, max_size=5), st.lists(st.integers(0, 6), min_size=0, max_size=5))
def test_soft_key_suite_against_brute_force(spark, fact_rows, dim_a, dim_b):
    facts = spark.createDataFrame(fact_rows, "a_sk long, b_sk long")
    da = spark.createDataFrame([(k,) for k in dim_a], "a_sk long")
    db = spark.createDataFrame([(k, k) for k in dim_b], "b_sk long, dup long")
    keys = [("f", "a_sk", "dim_a", "a_sk"), ("f", "b_sk", "dim_b", "b_sk")]
    got = {r.fk_column: (r.orphan_rows, r.null_fk_rows) for r in
           quality.soft_key_suite({"f": facts, "dim_a": da, "dim_b": db}, keys).collect()}
    for col, idx, dim in (("a_sk", 0, set(dim_a)), ("b_sk", 1, set(dim_b))):
        orphans = sum(1 for r in fact_rows if r[idx] is not None and r[idx] not in dim)
        nulls = sum(1 for r in fact_rows if r[idx] is None)
        assert got[col] == (orphans, nulls)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 4), st.one_of(st.none(), st.sampled_from("AB")), st.booleans()),
                min_size=0, max_size=8),
       st.dictionaries(st.integers(1, 6), st.one_of(st.none(), st.sampled_from("ABC")), max_size=5))
def test_scd2_apply_against_a_python_model(spark, versions, changes):
    import datetime as dt

    from ledgermart.operators import history
    as_of = dt.date(2024, 6, 1)
    dim_rows = [(i + 1, nk, seg, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if cur else dt.date(2021, 1, 1), cur)
                for i, (nk, seg, cur) in enumerate(versions)]
    schema = ("sk long, nk long, seg string, effective_from_date date, effective_to_date date, "
              "is_current_record boolean")
    dim = spark.createDataFrame(dim_rows, schema)
    ch = spark.createDataFrame(sorted(changes.items()), "nk long, seg string")
    got = sorted(tuple(r) for r in history.scd2_apply(dim, ch, "nk", "sk", ["seg"], as_of).collect())

    current = [r for r in dim_rows if r[5]]
    changed = {nk for (sk, nk, seg, f, t, c) in current if nk in changes and seg != changes[nk]}
    fresh = {nk for nk in changes if nk not in {r[1] for r in current}}
    want = [(sk, nk, seg, f, as_of, False) if (c and nk in changed) else (sk, nk, seg, f, t, c)
            for (sk, nk, seg, f, t, c) in dim_rows]
    base = max([r[0] for r in dim_rows], default=0)
    for i, nk in enumerate(sorted(changed | fresh)):
        want.append((base + i + 1, nk, changes[nk], as_of, None, True))
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 6), st.sampled_from(["CURRENT", "SAVINGS", "LOAN"]),
                          st.integers(0, 1), st.booleans()), min_size=0, max_size=12),
       st.lists(st.tuples(st.integers(1, 6), st.integers(1, 900)), min_size=0, max_size=10))
def test_customer_account_summary_against_distinct_counts(spark, accounts, balances):
    """The two-level aggregation equals COUNT(DISTINCT ...) and the plain sum,
    also with duplicate account rows and several balance rows per account."""
    from ledgermart.plans.marts import customer_account_summary
    acct = spark.createDataFrame(accounts, "customer_sk long, account_sk long, account_type string, "
                                           "currency_sk long, is_current_record boolean")
    bal = spark.createDataFrame([(a, 20241231, D(v)) for a, v in balances],
                                "account_sk long, snapshot_date_sk int, current_balance decimal(20,2)")
    f = {"dim_account": acct, "fact_account_balance_daily": bal,
         "dim_currency": spark.createDataFrame([(0, "USD"), (1, "EUR")], "currency_sk int, currency_code string"),
         "exchange_rate": spark.createDataFrame([("USD", "USD", "MID_RATE", D("1"), None),
                                                 ("EUR", "USD", "MID_RATE", D("2"), None)],
                                                "from_currency_code string, to_currency_code string, rate_type string, "
                                                "rate_value decimal(15,8), valid_to_datetime timestamp_ntz")}
    got = {r.customer_sk: (r.total_accounts, r.current_accounts, r.savings_accounts, r.loan_accounts,
                           r.total_balance_usd) for r in customer_account_summary(f).collect()}
    want = {}
    for c in {a[0] for a in accounts if a[4]}:
        rows = [a for a in accounts if a[0] == c and a[4]]
        distinct = lambda t=None: len({a[1] for a in rows if t is None or a[2] == t})
        terms = [D(v) * (2 if a[3] == 1 else 1) for a in rows for (b, v) in balances if b == a[1]]
        total = sum(terms).quantize(D("1E-10")) if terms else None
        want[c] = (distinct(), distinct("CURRENT"), distinct("SAVINGS"), distinct("LOAN"), total)
    assert got == want
