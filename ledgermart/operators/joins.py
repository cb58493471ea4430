"""Dimension joins of a star schema, expressed for Catalyst.

Broadcast policy
----------------
A side is broadcast only when its size has a proven bound:

* ``BOUNDED_DIMENSIONS`` lists dimensions whose row count is bounded by
  the domain, not by data volume (calendar days, ISO currencies, a
  one-row scalar).  Those get an explicit ``broadcast`` hint.
* every other dimension (customers, accounts, branches, products,
  countries, rules, the chart of accounts, ...) is joined without a hint.  AQE measures the shuffled size at run time
  and turns the join into a broadcast only below
  ``spark.sql.adaptive.autoBroadcastJoinThreshold``; beyond it the join
  stays a sort-merge join, and AQE's skew-join split handles a hot key
  on the fact side (a customer holding a third of all facts).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Dimensions whose cardinality is bounded by the business domain.
BOUNDED_DIMENSIONS = {
    "dim_date": "one row per calendar day: about 366 per year",
    "dim_currency": "ISO 4217 currencies: under 300",
    "currency_rate": "one open rate per currency",
}

CURRENT_FLAG = "is_current_record"


def hinted(dim: DataFrame, name: str) -> DataFrame:
    """Broadcast ``dim`` only when ``name`` is a dimension of bounded size."""
    return F.broadcast(dim) if name in BOUNDED_DIMENSIONS else dim


def current(dim: DataFrame, flag: str = CURRENT_FLAG) -> DataFrame:
    """Current versions only: a bare boolean predicate, so NULL is not current."""
    return dim.filter(F.col(flag))


def project(dim: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """``SELECT src AS dst, ...``: pick and rename columns (role-playing aliases)."""
    return dim.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def join_dim(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str,
             columns: Mapping[str, str], how: str = "inner", current_only: bool = False,
             name: str | None = None) -> DataFrame:
    """Join a fact to a dimension on one surrogate key and add ``columns``.

    ``current_only`` filters the dimension to current versions **before**
    the join (the reference's ``AND d.is_current_record`` in ON): with an
    inner join facts bound to a closed version drop out; with a left join
    they stay with NULL attributes.  Only the key and the wanted columns
    are read from the dimension.
    """
    d = current(dim) if current_only else dim
    key_alias = f"__{name or 'dim'}_{dim_key}"
    d = d.select(F.col(dim_key).alias(key_alias), *[F.col(s).alias(t) for s, t in columns.items()])
    if name:
        d = hinted(d, name)
    out = fact.join(d, fact[fact_key] == d[key_alias], how)
    return out.drop(key_alias)


def latest_only(fact: DataFrame, key: str) -> DataFrame:
    """Rows at the global maximum of ``key`` (an uncorrelated scalar subquery).

    Catalyst runs the subquery once; the maximum is over the whole table,
    not per entity, as in the reference.
    """
    return fact.filter(F.col(key) == fact.select(F.max(key)).scalar())


def open_rates(rates: DataFrame, to_ccy: str = "USD", rate_type: str = "MID_RATE") -> DataFrame:
    """Open rates (no end) to ``to_ccy`` of ``rate_type``: (from_currency_code, rate_value).

    Two open rates for one pair fan out, as in the reference; see
    ``quality.rate_fanout_check``.
    """
    return (rates.filter((F.col("to_currency_code") == to_ccy) & (F.col("rate_type") == rate_type)
                         & F.col("valid_to_datetime").isNull())
            .select("from_currency_code", "rate_value"))


def currency_rates(dim_currency: DataFrame, rates: DataFrame, to_ccy: str = "USD",
                   rate_type: str = "MID_RATE") -> DataFrame:
    """(currency_sk, rate_value): the reference's correlated lookup
    ``fx.from_currency_code = (SELECT currency_code FROM dim_currency WHERE
    currency_sk = a.currency_sk)`` rewritten as a join of two bounded
    tables.  Spark rejects correlated scalar subqueries in ON."""
    r = open_rates(rates, to_ccy, rate_type)
    return dim_currency.select("currency_sk", "currency_code").join(
        r, F.col("currency_code") == F.col("from_currency_code")).select("currency_sk", "rate_value")


def anti_join(fact: DataFrame, dim: DataFrame, fk: str, pk: str) -> DataFrame:
    """Facts with no dimension row.  A NULL foreign key never matches, so it
    is returned too (the reference's LEFT JOIN ... WHERE pk IS NULL)."""
    d = dim.select(F.col(pk).alias("__pk"))
    return fact.join(d, fact[fk] == d["__pk"], "left_anti")


def semi_join(fact: DataFrame, dim: DataFrame, fk: str, pk: str) -> DataFrame:
    d = dim.select(F.col(pk).alias("__pk"))
    return fact.join(d, fact[fk] == d["__pk"], "left_semi")


def as_of_join(facts: DataFrame, versions: DataFrame, fact_nk: str, dim_nk: str, event_date: str,
               columns: Mapping[str, str], from_col: str = "effective_from_date",
               to_col: str = "effective_to_date", how: str = "left") -> DataFrame:
    """Bind each fact to the dimension version valid on its date.

    Valid means ``from <= d AND (to IS NULL OR d < to)`` (half-open: an
    event on ``to`` belongs to the next version).  The equi part on the
    natural key keeps the join a hash/sort-merge join; the interval is a
    residual condition over the few versions of one key, never a range
    join over the whole table.
    """
    v = versions.select(F.col(dim_nk).alias("__nk"), F.col(from_col).alias("__from"),
                        F.col(to_col).alias("__to"), *[F.col(s).alias(t) for s, t in columns.items()])
    d = facts[event_date]
    cond = ((facts[fact_nk] == v["__nk"]) & (v["__from"] <= d)
            & (v["__to"].isNull() | (d < v["__to"])))
    return facts.join(v, cond, how).drop("__nk", "__from", "__to")


def rate_day_spine(rates: DataFrame, pair_cols: Iterable[str], until: Column,
                   rate_date: str = "rate_date", rate_col: str = "rate_value") -> DataFrame:
    """Turn dated rates into one row per (pair, calendar day) carrying the
    rate in force that day: the rate of the latest ``rate_date`` on or
    before it, up to ``until`` for the last one.

    Its size is pairs x days, bounded by the calendar and independent of
    the fact volume.  The window runs over the rate table only (partitioned
    by pair, a few thousand rows each); rows with the same pair and date
    keep the largest rate value so the lookup stays one row per day.
    """
    pair_cols = list(pair_cols)
    r = (rates.groupBy(*pair_cols, F.col(rate_date).cast("date").alias("__d"))
         .agg(F.max(rate_col).alias(rate_col)))
    w = Window.partitionBy(*pair_cols).orderBy("__d")
    r = r.withColumn("__next", F.lead("__d").over(w))
    last_day = F.coalesce(F.date_sub(F.col("__next"), 1), until.cast("date"))
    return (r.filter(F.col("__d") <= last_day)
            .select(*pair_cols, rate_col, F.explode(F.sequence(F.col("__d"), last_day)).alias("rate_day")))


def latest_rate_on_or_before(facts: DataFrame, rates: DataFrame, pair_cols: Iterable[str],
                             fact_date: str, rate_date: str = "rate_date",
                             rate_col: str = "rate_value") -> DataFrame:
    """Dated rate lookup (J11): each fact gets the rate of the latest
    ``rate_date`` on or before its date, per currency pair and type.

    Exact and without candidate blow-up: the rates become a day spine
    (:func:`rate_day_spine`) and the fact joins it on (pair, day)
    equality, one match at most.  The composite key spreads a hot pair
    over all its days.  Facts before the first rate get NULL.
    """
    pair_cols = list(pair_cols)
    # the spine ends with the last rate; later facts look up that day
    until = rates.select(F.max(F.col(rate_date).cast("date"))).scalar()
    spine = rate_day_spine(rates, pair_cols, until, rate_date, rate_col)
    spine = spine.select(*[F.col(c).alias(f"__r_{c}") for c in pair_cols], F.col("rate_day").alias("__rd"),
                         F.col(rate_col))
    cond = [facts[c] == spine[f"__r_{c}"] for c in pair_cols] + [F.least(facts[fact_date].cast("date"), until) == spine["__rd"]]
    out = facts.join(F.broadcast(spine), cond, "left")  # pairs x days: bounded by the rate table's own calendar
    return out.drop(*[f"__r_{c}" for c in pair_cols], "__rd")


# ------------------------------------------------------------ rates by validity

def rate_segments(rates: DataFrame, pair_cols: Iterable[str], from_col: str = "valid_from_datetime",
                  to_col: str = "valid_to_datetime", rate_col: str = "rate_value") -> DataFrame:
    """Disjoint pieces of the rates' validity: (pair, ``__month``, ``__from``,
    ``__to``, rate), each inside one calendar month.

    Validity is half-open; a missing start is valid from the beginning, a
    missing end until further notice, and an interval that ends before it
    begins is never valid.  Where intervals overlap the one that started
    last holds, ties by the greatest rate, and an earlier one goes on when
    the later ends.

    Intervals are cut into the months they touch.  Boundaries meet intervals
    on (pair, month) with the interval as a residual test, so one long or
    open interval costs a row per month and a hot pair spreads over months;
    there is no join on the interval alone.  After the last boundary nothing
    changes, so open intervals end there (see :func:`interval_rate`)."""
    pair_cols = list(pair_cols)
    far = F.lit("9999-12-31").cast("timestamp_ntz")
    first, last = _rate_span(rates, from_col, to_col)
    r = rates.select(*pair_cols, F.col(rate_col).alias("__rate"),
                     F.coalesce(F.col(from_col).cast("timestamp_ntz"), first).alias("__s"),
                     F.coalesce(F.col(to_col).cast("timestamp_ntz"), far).alias("__e")).filter(F.col("__s") < F.col("__e"))
    end = F.least(F.col("__e"), last)
    months = F.sequence(F.trunc(F.col("__s").cast("date"), "month"), F.trunc(end.cast("date"), "month"), F.expr("interval 1 month"))
    pieces = r.select("*", F.explode(months).alias("__month"))
    start = F.col("__month").cast("timestamp_ntz")
    stop = F.add_months("__month", 1).cast("timestamp_ntz")
    pieces = pieces.withColumn("__a", F.greatest("__s", start)).withColumn("__b", F.least("__e", stop)).filter("__a < __b")
    points = pieces.select(*pair_cols, "__month", F.explode(F.array("__a", "__b")).alias("__at")).filter(
        F.col("__at") < F.add_months("__month", 1).cast("timestamp_ntz")).distinct()
    p = points.select(*[F.col(c).alias(f"__p_{c}") for c in pair_cols], F.col("__month").alias("__p_month"), "__at")
    same = [F.col(c).eqNullSafe(F.col(f"__p_{c}")) for c in pair_cols] + [F.col("__month") == F.col("__p_month")]
    inside = (F.col("__a") <= F.col("__at")) & (F.col("__at") < F.col("__b"))
    met = p.join(pieces, [*same, inside], "left")
    held = met.groupBy(*[F.col(f"__p_{c}").alias(c) for c in pair_cols], F.col("__p_month").alias("__month"), "__at").agg(
        F.max(F.when(F.col("__rate").isNotNull(), F.struct("__s", "__rate")))["__rate"].alias(rate_col))
    by = Window.partitionBy(*pair_cols, "__month").orderBy("__at")
    until = F.coalesce(F.lead("__at").over(by), F.add_months("__month", 1).cast("timestamp_ntz"))
    return held.withColumn("__to", until).filter(F.col(rate_col).isNotNull()).select(
        *pair_cols, "__month", F.col("__at").alias("__from"), "__to", rate_col)


def _rate_span(rates: DataFrame, from_col: str, to_col: str) -> tuple[Column, Column]:
    """A moment before every boundary of the rates, and the last boundary."""
    ends = rates.select(F.explode(F.array(F.col(from_col).cast("timestamp_ntz"), F.col(to_col).cast("timestamp_ntz"))).alias("t"))
    one = ends.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    now = F.lit("1970-01-01").cast("timestamp_ntz")   # no boundary at all: any moment will do
    return (one.select(F.coalesce(F.col("a") - F.expr("interval 1 day"), now)).scalar(), one.select(F.coalesce("b", now)).scalar())


def interval_rate(facts: DataFrame, rates: DataFrame, pair_cols: Iterable[str], fact_ts: str,
                  from_col: str = "valid_from_datetime", to_col: str = "valid_to_datetime", rate_col: str = "rate_value",
                  out: str | None = None) -> DataFrame:
    """J11 by validity interval: each fact gets the rate valid at its time
    (NULL where none is), one row per fact.

    An equi-join on (pair, month) with the piece as a residual test.  Facts
    after the last boundary look up that moment, facts before the first one
    the day before it, so neither needs an interval of its own."""
    pair_cols = list(pair_cols)
    segments = rate_segments(rates, pair_cols, from_col, to_col, rate_col)
    first, last = _rate_span(rates, from_col, to_col)
    t = F.col(fact_ts).cast("timestamp_ntz")
    f = facts.withColumn("__t", F.when(t.isNotNull(), F.least(F.greatest(t, first), last)))
    f = f.withColumn("__m", F.trunc(F.col("__t").cast("date"), "month"))
    s = segments.select(*[F.col(c).alias(f"__r_{c}") for c in pair_cols], "__month", "__from", "__to", F.col(rate_col).alias("__rate"))
    on = [F.col(c) == F.col(f"__r_{c}") for c in pair_cols] + [
        F.col("__m") == F.col("__month"), F.col("__from") <= F.col("__t"), F.col("__t") < F.col("__to")]
    return f.join(s, on, "left").select(*facts.columns, F.col("__rate").alias(out or rate_col))


def rate_interval_check(rates: DataFrame, pair_cols: Iterable[str], from_col: str = "valid_from_datetime",
                        to_col: str = "valid_to_datetime") -> DataFrame:
    """(pair, issue, rows): ``overlap`` (starts before an earlier one ended),
    ``gap`` (starts after all earlier ones ended) and ``reversed`` (never
    valid; left out of the other two)."""
    pair_cols = list(pair_cols)
    low, far = F.lit("0001-01-01").cast("timestamp_ntz"), F.lit("9999-12-31").cast("timestamp_ntz")
    r = rates.select(*pair_cols, F.coalesce(F.col(from_col).cast("timestamp_ntz"), low).alias("__s"),
                     F.coalesce(F.col(to_col).cast("timestamp_ntz"), far).alias("__e"))
    w = Window.partitionBy(*pair_cols).orderBy("__s", "__e").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max("__e").over(w)
    sound = r.filter("__s < __e").select(*pair_cols, F.when(F.col("__s") < ended, "overlap").when(F.col("__s") > ended, "gap").alias("issue"))
    bad = r.filter("__s >= __e").select(*pair_cols, F.lit("reversed").alias("issue"))
    return sound.filter("issue IS NOT NULL").unionByName(bad).groupBy(*pair_cols, "issue").agg(F.count(F.lit(1)).alias("rows"))


def bridge_allocate(fact: DataFrame, bridge: DataFrame, fact_key: str, bridge_key: str,
                    other_key: str, weight: str, amount: str, out: str) -> DataFrame:
    """Many-to-many through a weighted bridge: one output row per
    (fact, bridge partner) with ``amount * weight / 100``."""
    b = bridge.select(F.col(bridge_key).alias("__bk"), F.col(other_key), F.col(weight).alias("__w"))
    j = fact.join(b, fact[fact_key] == b["__bk"])
    return j.withColumn(out, (F.col(amount) * F.col("__w") / F.lit(100)).cast("decimal(38,6)")).drop("__bk", "__w")
