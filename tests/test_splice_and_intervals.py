"""History splicing against a day-by-day model, in any order and any cut
into batches; interval rates against a search over all intervals."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgermart.operators import history, joins

DAY0 = dt.date(2020, 1, 1)
DIM = "sk bigint, nk bigint, segment string, branch string, effective_from_date date, effective_to_date date, is_current_record boolean"
CHANGE = "nk bigint, segment string, change_ts timestamp_ntz"


def day(k):
    return None if k is None else DAY0 + dt.timedelta(days=k)


def moment(k, hour):
    return dt.datetime.combine(day(k), dt.time(hour))


def model(versions, changes, horizon=80):
    """{nk: [(from, to, segment, branch)]} by asking every day what holds."""
    out = {}
    for nk in {v[0] for v in versions} | {c[0] for c in changes}:
        mine = sorted(v for v in versions if v[0] == nk)
        said = {}
        for _, segment, k, hour in sorted((c for c in changes if c[0] == nk), key=lambda c: (c[2], c[3], c[1])):
            said[k] = segment
        state, spans = None, []
        for k in range(horizon):
            starts = [v for v in mine if v[1] == k]
            if not starts and k not in said and any(v[2] == k for v in mine) and not any(
                    v[1] <= k and (v[2] is None or v[2] > k) for v in mine):
                state = None
            known = [v for v in mine if v[1] <= k] or mine[:1]
            branch = known[-1][4] if known else None
            if k in said:
                state = (said[k], branch)
            elif starts:
                state = (starts[-1][3], branch)
            if state and spans and spans[-1][1] == k and spans[-1][2:] == state:
                spans[-1] = (spans[-1][0], k + 1, *state)
            elif state:
                spans.append((k, k + 1, *state))
        out[nk] = [(day(a), None if b == horizon else day(b), s, r) for a, b, s, r in spans]
    return out


def case(seed):
    rng, versions, changes = random.Random(seed), [], []
    for nk in range(1, 9):
        k = rng.randrange(20)
        for _ in range(rng.randrange(0 if nk > 6 else 1, 5)):
            end = k + rng.randrange(1, 12)
            versions.append((nk, k, end, rng.choice("AB"), rng.choice("xy")))
            k = end + rng.choice([0, 0, 3])
        if versions and versions[-1][0] == nk and rng.random() < 0.6:
            versions[-1] = (*versions[-1][:2], None, *versions[-1][3:])
        for _ in range(rng.randrange(0, 9)):
            changes.append((nk, rng.choice("ABC"), rng.randrange(60), rng.randrange(3)))
    return rng, versions, changes


def frames(spark, versions, changes):
    dim = spark.createDataFrame([(100 + i, nk, s, b, day(a), day(z), z is None) for i, (nk, a, z, s, b) in enumerate(versions)], DIM)
    return dim, spark.createDataFrame([(nk, s, moment(k, h)) for nk, s, k, h in changes], CHANGE)


def as_spans(dim):
    rows = dim.select("nk", "effective_from_date", "effective_to_date", "segment", "branch", "is_current_record", "sk").collect()
    assert len({r["sk"] for r in rows}) == len(rows) and all(r["sk"] is not None for r in rows)
    assert all(r["is_current_record"] == (r["effective_to_date"] is None) for r in rows)
    out = {}
    for r in sorted(rows, key=lambda r: (r["nk"], r["effective_from_date"])):
        out.setdefault(r["nk"], []).append(tuple(r)[1:5])
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_splice_equals_the_model_in_any_order(spark, seed):
    rng, versions, changes = case(seed)
    dim, every = frames(spark, versions, changes)
    changed = {c[0] for c in changes}
    want = {k: v for k, v in model(versions, changes).items() if k in changed}
    once = history.scd2_splice(dim, every, "nk", "sk", "change_ts")
    assert {k: v for k, v in as_spans(once).items() if k in changed} == want
    # versions that stay keep their keys, unchanged keys their rows
    rest = [k for k in {v[0] for v in versions} if k not in changed]
    assert sorted(once.filter(F.col("nk").isin(rest)).collect()) == sorted(dim.filter(F.col("nk").isin(rest)).collect())
    stored = {(r["nk"], r["effective_from_date"]): r["sk"] for r in dim.collect()}
    assert all(stored.get((r["nk"], r["effective_from_date"]), r["sk"]) == r["sk"] for r in once.collect())
    # batches in another order, with the log of what was seen
    rng.shuffle(changes)
    state, log = dim, None
    for a in range(0, len(changes), 9):
        batch = frames(spark, [], changes[a:a + 9])[1]
        state = spark.createDataFrame(history.scd2_splice(state, batch, "nk", "sk", "change_ts", log).collect(), DIM)
        log = spark.createDataFrame(history.change_log(batch, "nk", "change_ts", log).collect(), CHANGE)
    assert {k: v for k, v in as_spans(state).items() if k in changed} == want


def test_splice_cases(spark):
    versions = [(1, 10, 20, "A", "x"), (1, 20, None, "B", "y"), (2, 5, None, "A", "x")]
    dim, changes = frames(spark, versions, [(1, "B", 15, 0), (1, "A", 3, 0), (2, "A", 7, 0), (9, "C", 4, 1), (9, "B", 4, 0)])
    got = history.scd2_splice(dim, changes.unionByName(spark.createDataFrame([(None, "Z", moment(1, 1)), (3, "Z", None)], CHANGE)), "nk", "sk", "change_ts")
    assert as_spans(got) == {
        1: [(day(3), day(15), "A", "x"), (day(15), day(20), "B", "x"), (day(20), None, "B", "y")],  # opened earlier, split
        2: [(day(5), None, "A", "x")],                                                             # nothing new
        9: [(day(4), None, "C", None)]}                                                            # the later of the day
    keys = {(r["nk"], r["effective_from_date"]): r["sk"] for r in got.collect()}
    assert keys[1, day(3)] == 100 and keys[1, day(20)] == 101 and keys[1, day(15)] == 103 and keys[9, day(4)] == 104
    # a stored version that says nothing new any more goes, and its key is told
    merged = history.scd2_splice(dim, frames(spark, [], [(1, "B", 10, 0)])[1].withColumn("branch", F.lit("y")), "nk", "sk", "change_ts")
    assert as_spans(merged)[1] == [(day(10), None, "B", "y")]
    assert [tuple(r) for r in history.replaced_keys(dim, merged, "nk", "sk").collect()] == [(101, 100)]
    assert history.unplaced_changes(spark.createDataFrame([(None, "Z", moment(1, 1)), (3, "Z", None), (3, "Z", moment(1, 1))], CHANGE),
                                    "nk", "change_ts").count() == 2
    empty = spark.createDataFrame([], CHANGE)
    assert sorted(history.scd2_splice(dim, empty, "nk", "sk", "change_ts").collect()) == sorted(dim.collect())


RATE = "ccy string, rate decimal(15,8), valid_from_datetime timestamp_ntz, valid_to_datetime timestamp_ntz"


@pytest.mark.parametrize("seed", [1, 2])
def test_interval_rate_equals_a_search(spark, seed):
    rng, t0 = random.Random(seed), dt.datetime(2020, 1, 1)

    def when(hours):
        return None if hours is None else t0 + dt.timedelta(hours=hours)
    rates = []
    for ccy in "ABC":
        for _ in range(12):
            a = rng.choice([None, *range(0, 4000, 7)]) if ccy == "C" else rng.randrange(4000)
            b = None if rng.random() < 0.2 else (a or 0) + rng.randrange(-50, 1500)
            rates.append((ccy, rng.randrange(1, 99), a, b))
    facts = [(i, rng.choice(["A", "B", "C", "D", None]), rng.choice([None, *range(-900, 6000)])) for i in range(600)]
    facts += [(1000 + i, c, a) for i, (c, _, a, b) in enumerate(rates)] + [(2000 + i, c, b) for i, (c, _, a, b) in enumerate(rates)]
    from decimal import Decimal
    r = spark.createDataFrame([(c, Decimal(v), when(a), when(b)) for c, v, a, b in rates], RATE)
    f = spark.createDataFrame([(i, c, when(h)) for i, c, h in facts], "id int, ccy string, t timestamp_ntz")
    low, far = -10 ** 6, 10 ** 6

    def want(c, h):
        held = [(low if a is None else a, v) for x, v, a, b in rates
                if x == c and h is not None and (low if a is None else a) <= h < (far if b is None else b)]
        return max(held)[1] if held else None
    got = joins.interval_rate(f, r, ["ccy"], "t", rate_col="rate").collect()
    assert len(got) == len(facts)
    assert {x["id"]: None if x["rate"] is None else int(x["rate"]) for x in got} == {i: want(c, h) for i, c, h in facts}


def test_interval_rate_without_rates(spark):
    f = spark.createDataFrame([(1, "A", dt.datetime(2020, 1, 1))], "id int, ccy string, t timestamp_ntz")
    assert joins.interval_rate(f, spark.createDataFrame([], RATE), ["ccy"], "t", rate_col="rate").collect()[0]["rate"] is None


def test_interval_join_is_an_equi_join(spark):
    f = spark.createDataFrame([(1, "A", dt.datetime(2020, 1, 1))], "id int, ccy string, t timestamp_ntz")
    r = spark.createDataFrame([], RATE)
    plan = joins.interval_rate(f, r, ["ccy"], "t", rate_col="rate")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rate_interval_check(spark):
    t = [dt.datetime(2020, 1, k) for k in range(1, 9)]
    from decimal import Decimal
    rows = [("A", t[0], t[2]), ("A", t[1], t[3]), ("A", t[4], None), ("A", t[5], t[5]), ("B", None, t[1]), ("B", t[1], t[2])]
    got = joins.rate_interval_check(spark.createDataFrame([(c, Decimal(1), a, b) for c, a, b in rows], RATE), ["ccy"]).collect()
    assert Counter(tuple(r) for r in got) == Counter([("A", "overlap", 1), ("A", "gap", 1), ("A", "reversed", 1)])


def test_alert_facts_in_any_order(spark):
    """The snapshot with its other columns does not depend on the batches."""
    rng, t0 = random.Random(6), dt.datetime(2024, 1, 1)
    events = [(rng.randrange(9), rng.choice([*history.MILESTONES, None]), t0 + dt.timedelta(hours=rng.randrange(900)), rng.randrange(5), rng.choice("ab"))
              for _ in range(120)] + [(77, "assigned", None, 1, "a")]
    kind = "alert_id int, milestone string, milestone_ts timestamp_ntz, amount int, who string"
    frame = spark.createDataFrame(events, kind)
    once = history.accumulate_alert_facts(None, frame, ["amount", "who"])
    first = {}
    for a, _, ts, amount, who in events:
        if ts is not None:
            first[a] = min(first.get(a, (ts, amount, who)), (ts, amount, who))
    assert {r["alert_id"]: (r["stated_at"], r["amount"], r["who"]) for r in once.collect()} == {**first, 77: (None, None, None)}
    assert sorted(map(str, once.drop("stated_at", "amount", "who").collect())) == sorted(map(str, history.accumulate_alerts(None, frame).collect()))
    rng.shuffle(events)
    state = None
    for a in range(0, len(events), 45):
        state = history.accumulate_alert_facts(state, spark.createDataFrame(events[a:a + 45], kind), ["amount", "who"])
        state = spark.createDataFrame(state.collect(), state.schema)
    assert sorted(map(str, state.collect())) == sorted(map(str, once.collect()))
    # columns that only the stored snapshot has stay
    noted = state.filter("alert_id < 5").withColumn("note", F.col("alert_id") * 10)
    more = history.accumulate_alert_facts(noted, frame, ["amount", "who"])
    assert {r["alert_id"]: r["note"] for r in more.collect()} == {**{a: a * 10 if a < 5 else None for a in first}, 77: None}
