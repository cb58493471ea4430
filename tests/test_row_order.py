"""The order of ordered queries, by position: NULL last ascending, first
descending, as in the reference's database."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.01"
ASCENDING = {"ifrs9_portfolio": ["ifrs9_stage", "dpd_bucket"], "net_interest_margin": ["calendar_year", "month_num"],
             "customer_360_first20": ["customer_sk"]}
DESCENDING = {"false_positive_rate_by_rule": "fp_pct", "payments_by_volume": "total_volume_usd"}


@pytest.mark.parametrize("name", sorted(ASCENDING))
def test_ascending(spark, name):
    rows = [tuple(r[c] for c in ASCENDING[name]) for r in E.queries()[name](spark, SF).collect()]
    assert len(rows) > 1 and rows == sorted(rows, key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("name", sorted(DESCENDING))
def test_descending(spark, name):
    rows = [r[DESCENDING[name]] for r in E.queries()[name](spark, SF).collect()]
    known = [x for x in rows if x is not None]
    assert len(rows) > 1 and rows == [None] * (len(rows) - len(known)) + sorted(known, reverse=True)
