"""The load job end to end: typed, defaulted, partitioned, verified.

The reference's start-up runs schema, data and key-reset scripts in order,
stops at the first error and then counts rows per table.  Here:

1. every frame is conformed to its declared schema (``try_cast``, fixed
   width trimmed, absent columns added) and absent columns get their
   declared defaults, with one load date and timestamp for the batch;
2. rows with a value its declared type cannot hold (looked at before the
   cast), or failing NOT NULL / allowed values / fit, are split off with
   their reasons, written beside the run under ``_rejects`` and counted
   (``strict=True`` stops the load instead, like the reference);
3. all tables are written in load order to a new run folder, the
   transaction fact range-partitioned by booking year, periodic snapshots
   by snapshot date, type 2 dimensions in current / history folders, other
   facts sorted by date key and main foreign key; the pointer is switched
   only when every table is written;
4. before that, the written tables are counted against their minimums; a
   missing, unreadable or short table stops the load and the previous run
   stays current;
5. with ``analyze_into`` the tables of the run are registered and analysed;
6. soft foreign keys are checked, with the keys that could not be, and the
   next surrogate key per table is reported (the key reset of the
   reference).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import DataFrame

from ledgermart.operators.quality import skipped_soft_keys, soft_key_suite, split_valid, verified_counts
from ledgermart.sources import load, stored
from ledgermart.sources import schemas as S


def prepare(frames: Mapping[str, DataFrame], load_date: str, load_ts: str,
            strict: bool = False) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Conform, default, validate and key every declared table present.

    The rules are checked on the columns the source provides (plus the
    defaults).  A generated surrogate key the source does not carry stays
    open here: it follows from the position that each valid row gets in the
    written files (L7, :func:`ledgermart.sources.stored.keys_from_positions`),
    so a fact is written once."""
    good, rejected = {}, {}
    for t in S.LOAD_ORDER:
        try:
            df = frames[t]
        except KeyError:
            continue
        tagged = load.with_misfits(df, t)
        typed = load.fill_defaults(load.conform(tagged, t, add_missing=False), t, load_date, load_ts)
        ok, bad = split_valid(typed, t, strict=strict)
        good[t], rejected[t] = load.conform(ok, t), bad   # declared order, absent columns as NULL
    return good, rejected


# Periodic snapshots are partitioned by their snapshot date key: a one-day
# query then prunes folders, statically or - through the filtered, broadcast
# date dimension - by dynamic partition pruning.
SNAPSHOT_KEYS = {
    "fact_account_balance_daily": "snapshot_date_sk",
    "fact_loan_daily_snapshot": "snapshot_date_sk",
    "fact_gl_balance": "period_end_date_sk",
}


def physical_layout(tables) -> dict[str, dict[str, list[str]]]:
    """File layout per table, by rule: type 2 dimensions are partitioned by
    their current-version flag; periodic snapshots by their date key and
    sorted by their first other foreign key; other facts sorted by their
    first date key and first other foreign key."""
    out = {}
    for t in tables:
        cols = [c.name for c in S.columns(t)]
        own = S.key_column(t)
        if S.HISTORY.get(t) == "type2" and "is_current_record" in cols:
            out[t] = {"partition_by": ["is_current_record"]}
        elif t in SNAPSHOT_KEYS:
            key = SNAPSHOT_KEYS[t]
            fks = [c for c in cols if c.endswith("_sk") and c not in (own, key) and not c.endswith("date_sk")][:1]
            out[t] = {"partition_by": [key], "sort_by": fks, "bloom": fks}
        elif t.startswith("fact_"):
            dates = [c for c in cols if c.endswith("date_sk")][:1]
            fks = [c for c in cols if c.endswith("_sk") and c != own and c not in dates][:1]
            out[t] = {"sort_by": dates + fks, "bloom": fks}
    return out


class LoadVerificationError(RuntimeError):
    """A written table is missing, unreadable or below its minimum."""


def all_minimums() -> dict[str, int]:
    """Every declared table with its least row count (0 where none is declared)."""
    return {t: S.ROW_MINIMUMS.get(t, 0) for t in S.LOAD_ORDER}


def present_minimums(frames: Mapping[str, DataFrame]) -> dict[str, int]:
    """For a partial load: the tables at hand, without least row counts."""
    out = {}
    for t in S.LOAD_ORDER:
        try:
            frames[t]
        except KeyError:
            continue
        out[t] = 0
    return out


def load_warehouse(frames: Mapping[str, DataFrame], root: str, first_year: int, last_year: int,
                   strict: bool = False, load_date: str | None = None,
                   minimums: Mapping[str, int] | None = None, analyze_into: str | None = None) -> dict:
    """Run the load; returns run id, rows written per table (from the
    written files), the rejected rows per table (read from where they were
    written) and their counts, the row-count verification, the soft keys
    checked and skipped, and the key high-water marks.

    ``minimums`` (all 22 tables by default) is what the run must hold to
    become current; otherwise :class:`LoadVerificationError` is raised.
    ``analyze_into`` names a database whose tables are pointed at the run
    and analysed for the cost-based optimiser."""
    now = _dt.datetime.now()
    load_date = load_date or now.date().isoformat()
    load_ts = now.strftime("%Y-%m-%d %H:%M:%S")
    good, rejected = prepare(frames, load_date, load_ts, strict)
    ranges = load.year_ranges(first_year, last_year)
    spark = next(iter(good.values())).sparkSession
    minimums = all_minimums() if minimums is None else dict(minimums)
    written, verified, rejects, counts = {}, [], {}, {}

    def check(folder: str) -> None:
        written.update({t: load.read_run(spark, folder, t) for t in good})
        verified.extend(verified_counts(written, dict.fromkeys(written, 0) | minimums))
        for t, bad in rejected.items():
            bad.write.parquet(f"{folder}/_rejects/{t}")
            rejects[t] = spark.read.parquet(f"{folder}/_rejects/{t}")
            counts[t] = rejects[t].count()
        failed = [f"{t} {status} ({n} rows, at least {m})" for t, n, m, status in verified if status != "OK"]
        if failed:
            raise LoadVerificationError("; ".join(failed))
    keyed = {t for t in good if S.key_column(t) and S.key_column(t) not in frames[t].columns}
    run_id = load.full_refresh(good, root, partitioned={"fact_transaction": ("booking_date_sk", ranges)},
                               layout=physical_layout(good), check=check, keyed=keyed)
    if analyze_into:
        folder, there = f"{root}/{run_id}", [t for t, n, _, _ in verified if n]
        stored.analyze_tables(spark, stored.register_tables(spark, folder, there, analyze_into), analyze_into)
    return {
        "run_id": run_id,
        "rows": {t: n for t, n, _, _ in verified if t in written},
        "rejected": rejects,
        "rejected_rows": counts,
        "verification": spark.createDataFrame(
            verified, "table_name string, actual_rows bigint, expected_min bigint, status string"),
        "next_keys": load.key_high_water(written),
        "soft_keys": soft_key_suite(written),
        "soft_keys_skipped": skipped_soft_keys(written),
    }
