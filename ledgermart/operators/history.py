"""History maintenance for type 1 / type 2 dimensions and the accumulating
alert snapshot (H1-H6).

Rules (the model declares the history kinds, not the procedure):

* type 1: the newest change per natural key overwrites the attributes;
  the surrogate key is kept; new natural keys get new keys (L7);
* type 2: tracked attributes are compared NULL-safely; a natural key
  whose current row differs is closed at ``as_of`` and gets a new current
  version with a new key, taking the change's attributes and copying the
  others from the current version; unchanged keys are untouched, so
  applying the same batch twice changes nothing;
* versions are half-open ``[effective_from_date, effective_to_date)``;
* alert milestones keep the earliest date per milestone, so replaying or
  reordering milestone events gives the same snapshot.

Outputs are new frames; write them to a new folder (never overwrite the
folder being read).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermart.operators.joins import as_of_join
from ledgermart.sources.load import append_with_keys


def latest_change(changes: DataFrame, nk: str, attrs: Sequence[str], change_ts: str | None) -> DataFrame:
    """One row per natural key: the newest change (partial aggregate, so a
    key with many changes is combined map-side).  A change without a time is
    older than any other; ties go to the greatest attribute values, so the
    pick does not depend on the order of rows."""
    order = [*([change_ts] if change_ts else []), *attrs]
    picked = changes.groupBy(nk).agg(F.max_by(F.struct(*attrs), F.struct(*order)).alias("__c"))
    return picked.select(nk, *[F.col(f"__c.{a}").alias(a) for a in attrs])


def scd1_upsert(dim: DataFrame, changes: DataFrame, nk: str, sk: str, attrs: Sequence[str],
                change_ts: str | None = None) -> DataFrame:
    """H1: overwrite attributes of existing keys, add new keys after the
    highest surrogate key."""
    latest = latest_change(changes, nk, attrs, change_ts)
    lc = latest.select(F.col(nk).alias("__nk"), F.lit(True).alias("__hit"),
                       *[F.col(a).alias(f"__new_{a}") for a in attrs])
    upd = dim.join(lc, dim[nk] == lc["__nk"], "left")
    updated = upd.select(*[F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c)
                           if c in attrs else F.col(c) for c in dim.columns])
    fresh = latest.join(dim.select(F.col(nk).alias("__nk")), latest[nk] == F.col("__nk"), "left_anti")
    added = append_with_keys(fresh, dim, sk, [nk])
    added = added.select(*[F.col(c) if c in added.columns else F.lit(None).cast(dim.schema[c].dataType).alias(c)
                           for c in dim.columns])
    return updated.unionByName(added)


def _differs(left: str, right: str, attrs: Sequence[str]) -> Column:
    same = F.lit(True)
    for a in attrs:
        same = same & F.col(f"{left}{a}").eqNullSafe(F.col(f"{right}{a}"))
    return ~same


def scd2_apply(dim: DataFrame, changes: DataFrame, nk: str, sk: str, tracked: Sequence[str], as_of,
               change_ts: str | None = None, from_col: str = "effective_from_date",
               to_col: str = "effective_to_date", flag: str = "is_current_record") -> DataFrame:
    """H2: apply a batch of changes to a type 2 dimension as of ``as_of``.

    A change to a key whose current version starts after ``as_of`` is not
    applied (it would end before it starts); :func:`back_dated` lists these."""
    as_of = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    # the new version takes every attribute the change carries; only the
    # tracked ones decide whether there is a change
    attrs = [c for c in changes.columns if c not in (nk, change_ts) and c in dim.columns]
    latest = latest_change(changes, nk, attrs, change_ts)
    lc = latest.select(F.col(nk).alias("__nk"), *[F.col(a).alias(f"__new_{a}") for a in tracked])
    cur = dim.filter(F.col(flag)).select(nk, *tracked, F.col(from_col).alias("__from"))
    cmp = cur.join(lc, cur[nk] == lc["__nk"])
    late = cmp.filter(F.col("__from") > as_of).select(F.col("__nk").alias("__late")).distinct()
    cmp = cmp.join(late, cmp["__nk"] == late["__late"], "left_anti")
    changed = cmp.filter(_differs("", "__new_", tracked)).select(F.col(nk).alias("__chg")).distinct()
    fresh = latest.join(cur.select(F.col(nk).alias("__c")).distinct(), latest[nk] == F.col("__c"), "left_anti")
    tagged = dim.join(changed, dim[nk] == changed["__chg"], "left")
    close = F.col(flag) & F.col("__chg").isNotNull()
    kept = tagged.select(*[
        F.when(close, as_of).otherwise(F.col(c)).alias(c) if c == to_col else
        F.when(close, F.lit(False)).otherwise(F.col(c)).alias(c) if c == flag else F.col(c)
        for c in dim.columns])
    new_versions = latest.join(changed, latest[nk] == changed["__chg"], "left_semi").unionByName(fresh.drop("__c"))
    # attributes the change does not carry are copied from the newest current
    # version (one row per key, picked by a partial aggregate)
    history_cols = {sk, nk, from_col, to_col, flag}
    carried = [c for c in dim.columns if c not in history_cols and c not in attrs]
    if carried:
        prev = dim.filter(F.col(flag)).groupBy(F.col(nk).alias("__pk")).agg(
            F.max_by(F.struct(*carried), F.col(from_col)).alias("__prev"))
        new_versions = new_versions.join(prev, new_versions[nk] == prev["__pk"], "left").select(
            *new_versions.columns, *[F.col(f"__prev.{c}").alias(c) for c in carried])
    added = append_with_keys(new_versions, dim, sk, [nk])
    defaults = {from_col: as_of, to_col: F.lit(None).cast("date"), flag: F.lit(True)}
    added = added.select(*[F.col(c) if c in added.columns else
                           defaults.get(c, F.lit(None)).cast(dim.schema[c].dataType).alias(c) for c in dim.columns])
    return kept.unionByName(added)


def back_dated(dim: DataFrame, changes: DataFrame, nk: str, as_of, from_col: str = "effective_from_date",
               flag: str = "is_current_record") -> DataFrame:
    """The changes that :func:`scd2_apply` does not apply: their key's
    current version starts after ``as_of``."""
    as_of = F.lit(as_of).cast("date") if not isinstance(as_of, Column) else as_of
    late = dim.filter(F.col(flag) & (F.col(from_col) > as_of)).select(F.col(nk).alias("__late")).distinct()
    return changes.join(late, changes[nk] == late["__late"], "left_semi")


# ------------------------------------------------------------ splicing (H2)

_OPEN = "9999-12-31"


def change_log(changes: DataFrame, nk: str, change_ts: str, log: DataFrame | None = None) -> DataFrame:
    """One change per key and day, of all those seen so far: the latest of
    the day, ties by the greatest attributes.  Pass the result as ``log``
    with the next batch.  Changes without a key or a time have no place in a
    history; :func:`unplaced_changes` lists them."""
    every = changes if log is None else log.unionByName(changes)
    attrs = [c for c in changes.columns if c not in (nk, change_ts)]
    # a partial maximum: a key with very many changes costs one row per task and day
    day = every.filter(F.col(nk).isNotNull() & F.col(change_ts).isNotNull()).groupBy(
        nk, F.to_date(change_ts).alias("__day")).agg(F.max(F.struct(change_ts, *attrs)).alias("__c"))
    return day.select(*[F.col(nk) if c == nk else F.col(f"__c.{c}").alias(c) for c in changes.columns])


def unplaced_changes(changes: DataFrame, nk: str, change_ts: str) -> DataFrame:
    return changes.filter(F.col(nk).isNull() | F.col(change_ts).isNull())


def scd2_splice(dim: DataFrame, changes: DataFrame, nk: str, sk: str, change_ts: str, log: DataFrame | None = None,
                from_col: str = "effective_from_date", to_col: str = "effective_to_date",
                flag: str = "is_current_record") -> DataFrame:
    """H2 with a history: fit every change into the versions of its key,
    back-dated ones and any number per key included.

    A version start and a change each state what holds from that day until
    the next statement; on one day a change goes before a version, and the
    latest change before the others.  An end that no other version covers
    says that the key is absent, until the next statement.  Days between two
    statements become one version; neighbours that agree in every attribute
    become one (islands).  So a change inside a version splits it, a change
    before the first version opens the key earlier, and a change that says
    nothing new leaves no trace.

    The result depends on the statements alone, not on their order or on how
    they are cut into batches, if all changes seen before are passed as
    ``log`` (see :func:`change_log`).  Attributes that changes do not carry
    come from the version in force (before the first one: from the first).
    A version keeps the key of the earliest stored version in it, and others
    get new keys; :func:`replaced_keys` tells what became of the old ones.
    Of overlapping versions the later start holds.  Versions of keys without
    a change, without a key or without a start are returned as they are.

    After the per-day aggregate a key has one row per day at the most, so
    the windows over a key are bounded by the calendar, not by the changes."""
    history = {sk, nk, from_col, to_col, flag}
    attrs = [c for c in dim.columns if c not in history]
    carried = [c for c in attrs if c in changes.columns]
    said = change_log(changes.select(nk, change_ts, *carried), nk, change_ts,
                      None if log is None else log.select(nk, change_ts, *carried))
    keys = said.select(F.col(nk).alias("__k")).distinct()
    placed = F.col(nk).isNotNull() & F.col(from_col).isNotNull()
    mine = dim.filter(placed).join(keys, F.col(nk) == F.col("__k"), "left_semi")
    other = dim.filter(~placed).unionByName(dim.filter(placed).join(keys, F.col(nk) == F.col("__k"), "left_anti"))

    # one row per key and day: what a version and what a change says there
    none = F.lit(None)
    versions = mine.select(
        F.col(nk).alias("nk"), F.col(from_col).alias("day"), F.struct(F.col(sk).alias("sk"), *attrs).alias("v"),
        none.cast(said.select(F.struct(*carried)).schema[0].dataType).alias("c"),
        F.coalesce(F.col(to_col), F.lit(_OPEN).cast("date")).alias("until"))
    stated = said.select(F.col(nk).alias("nk"), F.to_date(change_ts).alias("day"), none.cast(versions.schema["v"].dataType).alias("v"),
                         F.struct(*carried).alias("c"), none.cast("date").alias("until"))
    days = versions.unionByName(stated).groupBy("nk", "day").agg(F.max("v").alias("v"), F.max("c").alias("c"), F.max("until").alias("until"))

    key = Window.partitionBy("nk").orderBy("day")
    before, after = key.rowsBetween(Window.unboundedPreceding, 0), key.rowsBetween(1, Window.unboundedFollowing)
    covered = F.max("until").over(before)
    next_version = F.min(F.when(F.col("v").isNotNull(), F.col("day"))).over(after)
    ends = F.when(F.col("v").isNotNull() & (covered < F.coalesce(next_version, F.lit(_OPEN).cast("date"))), covered)
    rows = days.withColumn("ends", ends).withColumn("in_force", F.last("v", ignorenulls=True).over(before)).withColumn(
        "in_force", F.coalesce("in_force", F.first("v", ignorenulls=True).over(after)))
    value = F.struct(*[F.when(F.col("c").isNotNull(), F.col(f"c.{a}")).otherwise(F.col(f"in_force.{a}")).alias(a) if a in carried
                       else F.col(f"in_force.{a}").alias(a) for a in attrs]).alias("value")
    statement = rows.select("nk", "day", "ends", F.col("v.sk").alias("sk"), value)
    at = F.array_compact(F.array(F.struct(F.col("day").alias("day"), F.lit(True).alias("there")),
                                 F.when(F.col("ends").isNotNull(), F.struct(F.col("ends").alias("day"), F.lit(False).alias("there")))))
    timeline = statement.select("nk", "sk", "value", F.explode(at).alias("s")).select(
        "nk", "s.day", "s.there", F.when(F.col("s.there"), F.col("sk")).alias("sk"), F.when(F.col("s.there"), F.col("value")).alias("value"))

    key = Window.partitionBy("nk").orderBy("day", "there")   # an end gives way to what starts on its day
    spans = timeline.withColumn("until", F.lead("day").over(key)).filter(F.col("until").isNull() | (F.col("day") < F.col("until")))
    goes_on = F.lag("value").over(key).eqNullSafe(F.col("value")) & F.lag("there").over(key)
    islands = spans.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn(
        "island", F.sum("fresh").over(key.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.filter("there").groupBy("nk", "island").agg(
        F.min("day").alias("start"), F.max(F.coalesce("until", F.lit(_OPEN).cast("date"))).alias("until"),
        F.min_by("value", "day").alias("value"), F.min(F.when(F.col("sk").isNotNull(), F.struct("day", "sk")))["sk"].alias("sk"))
    open_end = F.col("until") == F.lit(_OPEN).cast("date")
    cells = {nk: F.col("nk"), from_col: F.col("start"), to_col: F.when(~open_end, F.col("until")), flag: open_end, sk: F.col("sk")}
    out = merged.select(*[cells.get(c, F.col(f"value.{c}") if c in attrs else None).cast(dim.schema[c].dataType).alias(c) for c in dim.columns])
    kept = out.filter(F.col(sk).isNotNull())
    fresh = append_with_keys(out.filter(F.col(sk).isNull()).drop(sk), dim, sk, [nk, from_col])
    return other.unionByName(kept).unionByName(fresh.withColumn(sk, F.col(sk).cast(dim.schema[sk].dataType)).select(*dim.columns))


def replaced_keys(old: DataFrame, new: DataFrame, nk: str, sk: str, from_col: str = "effective_from_date",
                  to_col: str = "effective_to_date") -> DataFrame:
    """(old key, new key) of the stored versions that a splice merged into
    another one: the new key is that of the version valid on the old start.
    Facts bound to the old key are re-bound with it (H6)."""
    gone = old.join(new.select(F.col(sk).alias("__k")), F.col(sk) == F.col("__k"), "left_anti").select(sk, nk, from_col)
    return as_of_join(gone, new, nk, nk, from_col, {sk: f"new_{sk}"}, from_col, to_col).select(F.col(sk).alias(f"old_{sk}"), f"new_{sk}")


def scd2_check(dim: DataFrame, nk: str, from_col: str = "effective_from_date", to_col: str = "effective_to_date",
               flag: str = "is_current_record") -> DataFrame:
    """H3: (natural key, issue, rows) for every broken history rule:
    ``multiple_current``, ``no_current``, ``overlap`` (a version starts
    before the previous one ends, or after an open one), ``reversed``
    (ends before it starts) and ``current_not_open`` / ``closed_but_open``
    (flag and end date disagree).  Empty when the history is sound."""
    w = Window.partitionBy(nk).orderBy(F.col(from_col), F.col(to_col).asc_nulls_last())
    prev_to = F.lag(to_col).over(w)
    prev_exists = F.lag(F.lit(1)).over(w).isNotNull()
    rows = dim.select(nk, from_col, to_col, flag,
                      (prev_exists & (prev_to.isNull() | (prev_to > F.col(from_col)))).alias("__overlap"))
    row_issues = rows.select(nk, F.explode(F.array_compact(F.array(
        F.when(F.col("__overlap"), F.lit("overlap")),
        F.when(F.col(to_col) < F.col(from_col), F.lit("reversed")),
        F.when(F.col(flag) & F.col(to_col).isNotNull(), F.lit("current_not_open")),
        F.when(~F.col(flag) & F.col(to_col).isNull(), F.lit("closed_but_open")),
    ))).alias("issue"))
    per_key = dim.groupBy(nk).agg(F.sum(F.when(F.col(flag), 1).otherwise(0)).alias("__cur"))
    key_issues = per_key.select(nk, F.when(F.col("__cur") > 1, F.lit("multiple_current"))
                                .when(F.col("__cur") == 0, F.lit("no_current")).alias("issue")) \
        .filter(F.col("issue").isNotNull())
    return row_issues.unionByName(key_issues).groupBy(nk, "issue").agg(F.count(F.lit(1)).alias("rows"))


def current_view(dim: DataFrame, flag: str = "is_current_record") -> DataFrame:
    """H4: current versions (NULL flag is not current)."""
    return dim.filter(F.col(flag))


def as_of_view(dim: DataFrame, when, from_col: str = "effective_from_date",
               to_col: str = "effective_to_date") -> DataFrame:
    """H4: versions valid on ``when`` (half-open interval)."""
    d = F.lit(when).cast("date") if not isinstance(when, Column) else when
    return dim.filter((F.col(from_col) <= d) & (F.col(to_col).isNull() | (d < F.col(to_col))))


# Milestones of the accumulating alert snapshot, in the order they occur.
MILESTONES = ("generated", "assigned", "reviewed", "escalated", "closed", "sar_filed")


def milestone_dates(events: DataFrame, alert: str, milestone: str, ts: str) -> DataFrame:
    """Earliest day per alert and milestone, pivoted to one row per alert
    (conditional minima: one partial aggregate, no pivot shuffle)."""
    day = F.to_date(F.col(ts))
    return events.groupBy(F.col(alert).alias("alert_id")).agg(*[
        F.min(F.when(F.col(milestone) == m, day)).alias(f"{m}_date") for m in MILESTONES])


def accumulate_alerts(existing: DataFrame | None, events: DataFrame, alert: str = "alert_id",
                      milestone: str = "milestone", ts: str = "milestone_ts") -> DataFrame:
    """H5: merge milestone events into the accumulating snapshot.

    The snapshot keeps, per alert, the earliest date of each milestone
    (``least`` of the stored and the new date), then derives the day
    counts from generation and the status from the furthest milestone
    reached.  Replaying a batch or receiving milestones out of order gives
    the same snapshot."""
    new = milestone_dates(events, alert, milestone, ts)
    if existing is not None:
        old = existing.select("alert_id", *[f"{m}_date" for m in MILESTONES])
        o = old.select(F.col("alert_id").alias("__o"), *[F.col(f"{m}_date").alias(f"__o_{m}") for m in MILESTONES])
        j = new.join(o, new["alert_id"] == o["__o"], "full_outer")
        new = j.select(F.coalesce("alert_id", "__o").alias("alert_id"), *[
            F.least(F.col(f"{m}_date"), F.col(f"__o_{m}")).alias(f"{m}_date") for m in MILESTONES])
    return derive_alert_measures(new)


def accumulate_alert_facts(existing: DataFrame | None, events: DataFrame, carry: Sequence[str], alert: str = "alert_id",
                           milestone: str = "milestone", ts: str = "milestone_ts") -> DataFrame:
    """H5 with the other columns of the fact: as :func:`accumulate_alerts`,
    and ``carry`` holds what the alert's earliest event said (ties: the least
    values), with that event's time in ``stated_at``.  Further columns of the
    stored snapshot stay as they are (NULL for new alerts).  Replayed and
    reordered batches give the same snapshot."""
    carry = list(carry)
    said = events.groupBy(F.col(alert).alias("__a")).agg(F.min(F.when(F.col(ts).isNotNull(), F.struct(
        F.col(ts).alias("stated_at"), *carry))).alias("__new"))
    out = accumulate_alerts(existing, events, alert, milestone, ts)
    out = out.join(said, out["alert_id"].eqNullSafe(said["__a"]), "left").drop("__a")
    first, further = F.col("__new"), []
    if existing is not None:
        further = [c for c in existing.columns if c not in out.columns and c not in carry and c != "stated_at"]
        old = existing.select(F.col("alert_id").alias("__o"), F.when(F.col("stated_at").isNotNull(), F.struct(
            "stated_at", *carry)).alias("__old"), *further)
        out = out.join(old, out["alert_id"].eqNullSafe(old["__o"]), "left").drop("__o")
        first = F.least(F.col("__old"), F.col("__new"))
    kept = [c for c in out.columns if not c.startswith("__") and c not in further]
    out = out.withColumn("__first", first)
    return out.select(*kept, *[F.col(f"__first.{c}").alias(c) for c in ("stated_at", *carry)], *further)


def derive_alert_measures(snap: DataFrame) -> DataFrame:
    gen = F.col("generated_date")
    status = (F.when(F.col("closed_date").isNotNull(), F.lit("CLOSED"))
              .when(F.col("escalated_date").isNotNull(), F.lit("ESCALATED"))
              .when(F.col("reviewed_date").isNotNull(), F.lit("UNDER_REVIEW"))
              .when(F.col("assigned_date").isNotNull(), F.lit("ASSIGNED")).otherwise(F.lit("OPEN")))
    return snap.select(
        "alert_id", *[f"{m}_date" for m in MILESTONES],
        F.datediff(F.col("assigned_date"), gen).alias("days_to_assign"),
        F.datediff(F.col("closed_date"), gen).alias("days_to_close"),
        status.alias("alert_status"))


def late_facts(facts: DataFrame, versions: DataFrame, fact_nk: str, dim_nk: str, event_date: str,
               sk: str, out: str) -> DataFrame:
    """H6: bind each fact to the dimension version valid on its date; a
    fact with no valid version keeps a NULL key (and shows up in Q8)."""
    return as_of_join(facts, versions, fact_nk, dim_nk, event_date, {sk: out})
