"""Command-line jobs (spark-submit or ``python -m ledgermart.jobs``).

``load``   read every declared table found under ``--source`` (one folder
           or file per table, Parquet, CSV or JSON), run the load job into
           ``--root`` and print the verification and the next keys - the
           reference's start-up sequence (schema, data, key reset, verify).
``mart``   run one mart or governance query over the loaded tables and
           write it (Parquet) to ``--out``, or show the first rows.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def _source_frames(spark: SparkSession, source: str, fmt: str) -> dict:
    from ledgermart.sources import load
    from ledgermart.sources import schemas as S
    from ledgermart.sources.pointer import exists

    frames = {}
    for t in S.LOAD_ORDER:
        for cand in (f"{source}/{t}", f"{source}/{t}.{fmt}"):
            if exists(spark, cand):  # a table that is there must be readable: any error stops the load
                frames[t] = load.read_table(spark, cand, t, fmt=fmt, typed=False)
                break
    return frames


def cmd_load(args) -> int:
    from ledgermart.plans import warehouse
    from ledgermart.session import get_spark

    spark = get_spark(args.master, args.partitions, app_name="ledgermart-load")
    frames = _source_frames(spark, args.source.rstrip("/"), args.format)
    if not frames:
        print(f"no declared table found under {args.source}", file=sys.stderr)
        return 2
    minimums = warehouse.present_minimums(frames) if args.partial else None
    try:
        out = warehouse.load_warehouse(frames, args.root.rstrip("/"), args.first_year, args.last_year,
                                       strict=args.strict, minimums=minimums, analyze_into=args.analyze)
    except warehouse.LoadVerificationError as failed:
        print(f"the load did not become current: {failed}", file=sys.stderr)
        return 1
    print(f"run {out['run_id']}: {sum(v or 0 for v in out['rows'].values())} rows in {len(out['rows'])} tables")
    out["verification"].orderBy("table_name").show(50, truncate=False)
    out["next_keys"].orderBy("table_name").show(50, truncate=False)
    rejected = {t: n for t, n in out["rejected_rows"].items() if n}
    print(f"rejected rows, kept under {args.root}/{out['run_id']}/_rejects: {rejected or 'none'}")
    print(f"soft keys not checked (table or column absent): {len(out['soft_keys_skipped'])}")
    return 0


def cmd_mart(args) -> int:
    from ledgermart.plans.governance import GOVERNANCE
    from ledgermart.plans.marts import MARTS
    from ledgermart.session import get_spark
    from ledgermart.sources import load
    from ledgermart.sources import schemas as S
    from ledgermart.sources.pointer import current, exists

    spark = get_spark(args.master, args.partitions, app_name=f"ledgermart-{args.name}")
    root = args.root.rstrip("/")
    run = current(spark, root)
    if run is None:
        print(f"nothing was loaded into {root}", file=sys.stderr)
        return 2
    frames = {t: load.read_current(spark, root, t) for t in S.LOAD_ORDER if exists(spark, f"{root}/{run}/{t}")}
    fn = {**MARTS, **GOVERNANCE}[args.name]
    df = fn(frames)
    if args.out:
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.show, truncate=False)
    return 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="ledgermart.jobs")
    p.add_argument("--master", default=None, help="e.g. local[8]; omit under spark-submit")
    p.add_argument("--partitions", type=int, default=None, help="spark.sql.shuffle.partitions")
    sub = p.add_subparsers(dest="cmd", required=True)
    lp = sub.add_parser("load")
    lp.add_argument("--source", required=True)
    lp.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    lp.add_argument("--root", required=True)
    lp.add_argument("--first-year", type=int, default=2022)
    lp.add_argument("--last-year", type=int, default=2025)
    lp.add_argument("--strict", action="store_true", help="stop at the first rejected row")
    lp.add_argument("--partial", action="store_true", help="accept a source without all tables, or short ones")
    lp.add_argument("--analyze", metavar="DATABASE", help="register the tables there and analyse them (needs a lasting catalogue)")
    lp.set_defaults(func=cmd_load)
    mp = sub.add_parser("mart")
    mp.add_argument("name")
    mp.add_argument("--root", required=True)
    mp.add_argument("--out", default=None)
    mp.add_argument("--show", type=int, default=20)
    mp.set_defaults(func=cmd_mart)
    args = p.parse_args(argv)
    return args.func(args)


if __name__ == "__main__":
    sys.exit(main())
