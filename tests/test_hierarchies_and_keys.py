"""Manager chains, ragged levels, bitmap look-ups, declared masking, table functions."""

import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgermart.operators import derive, hierarchy, quality
from ledgermart.plans import views
from ledgermart.sources import schemas as S


def walk(parent, node):
    seen, at = [node], node
    while parent.get(at) in parent:
        at = parent[at]
        if at in seen:
            return None, None, "cycle" if at == node else "below_cycle"
        seen.append(at)
    return len(seen) - 1, at, "orphan" if len(seen) == 1 and parent[node] is not None else None


@pytest.mark.parametrize("seed", [1, 2])
def test_parent_chain_equals_a_walk(spark, seed):
    rng = random.Random(seed)
    parent = {k: rng.choice([None, *range(max(0, k - 3), k)]) if k else None for k in range(120)}
    parent.update({k: k + 1 for k in range(200, 270)}, **{})          # one long chain
    parent[270] = None
    parent.update({300: 301, 301: 302, 302: 300, 303: 302, 304: 303, 305: 305, 306: 999})
    df = spark.createDataFrame([(k, p) for k, p in parent.items()] + [(5, None), (None, 3)], "k bigint, p bigint")
    parent[5] = min(p for p in (parent[5], 10 ** 9) if p is not None) if parent[5] is not None else None
    got = {r["k"]: (r["depth"], r["top"], r["issue"]) for r in hierarchy.parent_chain(df, "k", "p").collect()}
    assert got == {k: walk(parent, k) for k in parent}
    assert got[200] == (70, 270, None)


def test_parent_chain_of_nothing(spark):
    assert hierarchy.parent_chain(spark.createDataFrame([], "k bigint, p bigint"), "k", "p").collect() == []


def test_ragged_rollup_tells_unnamed_levels_from_subtotals(spark):
    accounts = [(1, "A", None, None), (2, "A", "x", None), (3, "A", None, "deep"), (4, None, None, None), (5, "B", "y", "z")]
    facts = [(1, 10), (1, 5), (2, 1), (3, 2), (4, 7), (5, 100), (9, 1000)]
    a = spark.createDataFrame(accounts, "k int, l1 string, l2 string, l3 string")
    f = spark.createDataFrame([(k, Decimal(v)) for k, v in facts], "k int, v decimal(20,2)")
    got = Counter(tuple(r) for r in hierarchy.ragged_rollup(f, a, "k", ["l1", "l2", "l3"], "v").collect())
    want = Counter()
    for depth in range(4):
        groups = {}
        for k, *path in accounts:
            last = max([i + 1 for i, x in enumerate(path) if x is not None], default=0)
            if depth <= last:
                cell = tuple(path[:depth] + [None] * (3 - depth))
                n, s = groups.get(cell, (0, 0))
                mine = [v for j, v in facts if j == k]
                groups[cell] = (n + len(mine), s + sum(mine))
        want.update({(*cell, depth, n, Decimal(s).quantize(Decimal("0.01"))): 1 for cell, (n, s) in groups.items()})
    assert got == want
    assert got[("A", None, None, 1, 4, Decimal("18.00"))] and got[("A", None, None, 2, 1, Decimal("2.00"))]   # subtotal, unnamed level


@pytest.mark.parametrize("limit", [None, 0])
def test_orphan_rows_equal_the_anti_join(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(quality, "BITMAP_BROADCAST", limit)
    rng = random.Random(3)
    keys = [rng.choice([rng.randrange(-50, 200), rng.randrange(10 ** 9)]) for _ in range(400)] + [0, 1, 32768, 32769, None, -1]
    dim = spark.createDataFrame([(k,) for k in keys], "pk bigint")
    facts = [(i, k) for i, k in enumerate([*range(-60, 260), 32767, 32768, 32769, 32770, None, 10 ** 12, *[k for k in keys if k]])]
    f = spark.createDataFrame(facts, "id int, fk bigint")
    got = quality.orphan_rows(f, dim, "fk", "pk")
    assert sorted(r["id"] for r in got.collect()) == sorted(i for i, k in facts if k is None or k not in set(keys))
    text = got._jdf.queryExecution().executedPlan().toString()
    assert ("LeftAnti" in text) == (limit == 0)
    assert got.columns == ["id", "fk"]


def test_soft_keys_into_the_own_table_and_between_facts():
    keys = {(t, fk, dim) for t, fk, dim, _ in S.soft_foreign_keys()}
    assert {("dim_employee", "manager_employee_sk", "dim_employee"), ("dim_date", "prior_year_date_sk", "dim_date"),
            ("fact_aml_alert", "triggering_transaction_sk", "fact_transaction")} <= keys
    assert not any(fk == S.key_column(t) for t, fk, _ in keys)


def test_soft_key_suite_without_a_key_is_empty(spark, frames):
    got = quality.soft_key_suite({"dim_currency": frames["dim_currency"]})
    assert got.count() == 0 and got.columns == ["table_name", "fk_column", "dim_table", "orphan_rows", "null_fk_rows"]


def test_every_tagged_column_of_every_table_is_masked(spark):
    for t in S.TABLES:
        fields = [f for f in S.table_schema(t)]
        row = spark.range(1).select(*[F.lit({"string": "1234567890", "date": "2020-05-17", "timestamp": "2020-05-17 01:02:03",
                                             "timestamp_ntz": "2020-05-17 01:02:03", "boolean": "true"}.get(f.dataType.typeName(), "7"))
                                      .cast(f.dataType).alias(f.name) for f in fields])
        plain, masked = row.first().asDict(), derive.mask_declared(row, t, "salt").first().asDict()
        tagged = {c.name for c in S.columns(t) if c.pii}
        assert {c for c in plain if plain[c] != masked[c]} == tagged, t
        empty = row.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
        assert all(v is None for v in derive.mask_declared(empty, t, "salt").first())
    assert {c.name for c in S.columns("dim_account") if derive.mask_rule(c) == "last4"} == {"account_number"}


def test_table_functions_push_their_condition_below_the_aggregate(spark, frames):
    views.register_functions(spark, frames)
    day = "DATE'1997-01-31'"
    got = spark.sql(f"SELECT * FROM credit_risk({day})")
    want = spark.table("vw_credit_risk_portfolio").filter(f"snapshot_date = {day}")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate") < plan.index("1997-01-31" if "1997-01-31" in plan else "9892")
    assert spark.sql("SELECT * FROM aml_alerts('HIGH')").select("alert_severity").distinct().collect() == [("HIGH",)]
    assert spark.sql("SELECT count(*) AS n FROM customer(1)").first()["n"] == spark.table("vw_customer_360").filter("customer_sk = 1").count()
    assert spark.sql("SELECT DISTINCT calendar_year FROM financial_performance(1997)").collect() == [(1997,)]


def test_view_dictionary(spark, frames):
    rows = views.view_dictionary(spark, frames).collect()
    assert {r["view_name"] for r in rows} == set(views.MART_VIEWS) == set(S.VIEW_COMMENTS)
    assert all(r["view_comment"] for r in rows)
    mine = [r["column_name"] for r in sorted(rows, key=lambda r: r["position"]) if r["view_name"] == "vw_payments_analytics"]
    assert mine == views.MART_VIEWS["vw_payments_analytics"](frames).columns
