"""Data-quality checks (Q1-Q10).

Parquet tables accept NULL into NOT NULL columns and refuse CHECK
constraints, so the declared rules are enforced here, as queries:

* :func:`column_profile` evaluates NOT NULL, allowed values and fit
  (length, decimal precision, integer width) for every declared column of
  a frame in **one** aggregate pass, then unpivots the counters to rows;
* :func:`soft_key_suite` checks every soft foreign key: rows look up their
  keys in the dimensions' broadcast bitmaps and only counts move (or, for
  keys that no bitmap fits, distinct values are counted and anti-joined);
* :func:`split_valid` keeps failing rows with their reasons instead of
  aborting the load; ``strict=True`` raises like the reference's
  stop-on-first-error load.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermart.session import materialize
from ledgermart.sources import schemas as S

Frames = Mapping[str, DataFrame]

INTEGER_WIDTH = {"smallint": "smallint", "int": "int", "bigint": "bigint"}


# --------------------------------------------------------------- row rules

def rule_predicates(df: DataFrame, name: str) -> list[tuple[str, str, Column]]:
    """(column, rule, failing-row predicate) for the declared columns of
    ``name`` present in ``df``.  Rules: ``not_null``, ``domain`` (NULL
    passes), ``fit`` (text longer than declared, number outside the
    declared precision or integer width; NULL passes)."""
    present = set(df.columns)
    out = []
    for c in S.columns(name):
        if c.name not in present:
            continue
        col = F.col(c.name)
        if not c.nullable:
            out.append((c.name, "not_null", col.isNull()))
        if c.domain:
            out.append((c.name, "domain", F.coalesce(~col.cast("string").isin(*c.domain), F.lit(False))))
        if c.max_len:
            out.append((c.name, "fit", F.coalesce(F.length(col.cast("string")) > c.max_len, F.lit(False))))
        elif c.dtype.startswith("decimal") or c.dtype in INTEGER_WIDTH:
            out.append((c.name, "fit", col.isNotNull() & col.try_cast(c.dtype).isNull()))
    return out


def column_profile(df: DataFrame, name: str) -> DataFrame:
    """Q5 + Q6 + Q7 in one scan: (table_name, column_name, rule, failing_rows)."""
    preds = rule_predicates(df, name)
    if not preds:
        return df.sparkSession.createDataFrame(
            [], "table_name string, column_name string, rule string, failing_rows bigint")
    counters = [F.count(F.when(p, F.lit(1))).cast("bigint").alias(f"{c}::{r}")
                for c, r, p in preds]
    one = df.agg(*counters)
    long = one.unpivot([], [f"{c}::{r}" for c, r, _ in preds], "check", "failing_rows")
    return long.select(
        F.lit(name).alias("table_name"),
        F.split_part(F.col("check"), F.lit("::"), F.lit(1)).alias("column_name"),
        F.split_part(F.col("check"), F.lit("::"), F.lit(2)).alias("rule"),
        F.col("failing_rows"))


def not_null_check(df: DataFrame, name: str) -> DataFrame:
    return column_profile(df, name).filter(F.col("rule") == "not_null")


def domain_check(df: DataFrame, name: str) -> DataFrame:
    return column_profile(df, name).filter(F.col("rule") == "domain")


def fit_check(df: DataFrame, name: str) -> DataFrame:
    return column_profile(df, name).filter(F.col("rule") == "fit")


def split_valid(df: DataFrame, name: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Q10: (good, rejected).  ``rejected`` carries ``reject_reasons``, an
    array of ``rule:column``.  Good + rejected = input, row for row.
    With ``strict`` the first rejected row raises instead (ANSI
    ``raise_error`` inside the plan, no driver round trip).  Reasons that
    typing found before the cast (``type:column``) come first."""
    preds = rule_predicates(df, name)
    reasons = F.array_compact(F.array(*[F.when(p, F.lit(f"{r}:{c}")) for c, r, p in preds])) \
        if preds else F.array().cast("array<string>")
    if S.MISFITS in df.columns:
        reasons = F.concat(F.coalesce(S.MISFITS, F.array().cast("array<string>")), reasons)
    tagged = df.withColumn("reject_reasons", reasons).drop(S.MISFITS)
    bad = F.size("reject_reasons") > 0
    if strict:
        tagged = tagged.withColumn("reject_reasons", F.when(
            bad, F.raise_error(F.concat(F.lit(f"{name}: "), F.array_join("reject_reasons", ", ")))
        ).otherwise(F.col("reject_reasons")))
    return tagged.filter(~bad).drop("reject_reasons"), tagged.filter(bad)


# ------------------------------------------------------------- table rules

def row_count_check(frames: Frames, minimums: Mapping[str, int] | None = None) -> DataFrame:
    """Q1: (table_name, actual_rows, expected_min, status) with status OK,
    LOW (below the minimum, a failure) or ERROR (the table is not there)."""
    from pyspark.errors import AnalysisException

    minimums = dict(S.ROW_MINIMUMS if minimums is None else minimums)
    parts, spark = [], SparkSession.getActiveSession()
    for t, m in minimums.items():
        try:
            df = frames[t]
        except (KeyError, AnalysisException):
            df = None
        if df is None:
            parts.append((t, m, None))
            continue
        spark = df.sparkSession
        parts.append((t, m, df.agg(F.count(F.lit(1)).alias("actual_rows"))))
    out = None
    for t, m, counted in parts:
        if counted is None:
            row = spark.range(1).select(F.lit(None).cast("bigint").alias("actual_rows"))
        else:
            row = counted
        row = row.select(F.lit(t).alias("table_name"), "actual_rows",
                         F.lit(m).cast("bigint").alias("expected_min"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("status", F.when(F.col("actual_rows").isNull(), "ERROR")
                          .when(F.col("actual_rows") >= F.col("expected_min"), "OK").otherwise("LOW"))


def verified_counts(frames: Frames, minimums: Mapping[str, int]) -> list[tuple[str, int | None, int, str]]:
    """Q1 as an action, table by table: a table that is missing or whose
    files cannot be read is an ERROR of its own and hides no other table."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    out = []
    for t, m in minimums.items():
        try:
            n = frames[t].count()
            out.append((t, n, m, "OK" if n >= m else "LOW"))
        except (KeyError, PySparkException, Py4JJavaError):
            out.append((t, None, m, "ERROR"))
    return out


def unique_check(df: DataFrame, keys: Iterable[str], where: Column | None = None,
                 count_col: str = "cnt") -> DataFrame:
    """Q2: key values occurring more than once (among rows matching ``where``)."""
    keys = list(keys)
    if where is not None:
        df = df.filter(where)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_col))
            .filter(F.col(count_col) > 1))


def unique_key_check(df: DataFrame, key: str) -> DataFrame:
    """Q3: a unique index: duplicates among non-NULL values only."""
    return unique_check(df, [key], F.col(key).isNotNull())


def rate_fanout_check(rates: DataFrame) -> DataFrame:
    """More than one open rate per (from, to, type): such a pair would
    multiply balances in the customer mart (the reference has no guard)."""
    return unique_check(rates, ["from_currency_code", "to_currency_code", "rate_type"],
                        F.col("valid_to_datetime").isNull())


def orphan_check(fact: DataFrame, dim: DataFrame, fk: str, pk: str) -> DataFrame:
    """Q4: one row, ``orphan_rows``: facts with no dimension row, NULL keys included."""
    keys = fact.groupBy(F.col(fk).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    d = dim.select(F.col(pk).alias("__pk"))
    missing = keys.join(d, keys["__k"] == d["__pk"], "left_anti")
    return missing.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("bigint").alias("orphan_rows"))


#: Bits of one bitmap and the bytes they take; a set of bitmaps up to this
#: size goes to every task.
BITMAP_BITS, BITMAP_BYTES, BITMAP_BROADCAST = 32_768, 4_096, 64 * 1024 * 1024


def key_bitmaps(dim: DataFrame, pk: str) -> DataFrame:
    """(bucket, bits): the exact set of a dimension's whole-number keys, one
    bit per key of a bucket of 32,768 (generated keys are dense)."""
    k = F.col(pk).cast("bigint")
    return dim.filter(k.isNotNull()).groupBy(F.bitmap_bucket_number(k).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(k)).alias("bits"))


def orphan_rows(fact: DataFrame, dim: DataFrame, fk: str, pk: str) -> DataFrame:
    """Facts with no dimension row, NULL keys included, without shuffling the
    facts: the dimension's keys become bitmaps, the facts look their bit up,
    and only orphans go on.  The same rows as an anti join.

    The bitmaps are counted first.  Up to ``BITMAP_BROADCAST`` bytes they go
    to every task (16,384 buckets, half a billion dense keys); beyond that,
    or where keys are so scattered that the bitmaps would take more than the
    keys, it is the exact anti join."""
    maps = materialize(key_bitmaps(dim, pk), "bitmaps")
    size = maps.agg(F.count(F.lit(1)).alias("buckets"), F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("keys")).first()
    if _too_large(size["buckets"], size["keys"]):
        d = dim.select(F.col(pk).alias("__pk"))
        return fact.join(d, fact[fk] == d["__pk"], "left_anti")
    k = F.col(fk).cast("bigint")
    looked = fact.join(F.broadcast(maps.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))),
                       F.bitmap_bucket_number(k) == F.col("__bucket"), "left")
    return looked.filter(~_in_bitmap(k, "__bits")).select(*fact.columns)


def _too_large(buckets: int, keys: int) -> bool:
    """Whether bitmaps are beyond a broadcast, or larger than scattered keys by themselves."""
    scattered = buckets * BITMAP_BYTES > 16 * 1024 * 1024 and keys * 64 < buckets * BITMAP_BYTES
    return scattered or buckets * BITMAP_BYTES > BITMAP_BROADCAST


def _in_bitmap(k: Column, bits: str) -> Column:
    """Whether the whole number ``k`` is in its bucket's bitmap (not without one)."""
    at = F.bitmap_bit_position(k)
    byte = F.conv(F.hex(F.substring(bits, F.call_function("div", at, F.lit(8)).cast("int") + 1, 1)), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))


def skipped_soft_keys(frames: Frames, keys: Iterable[tuple[str, str, str, str]] | None = None) -> list[tuple[str, str, str]]:
    """(table, foreign key, dimension) of the declared keys that
    :func:`soft_key_suite` cannot check: a table or column is not there."""
    keys = list(S.soft_foreign_keys() if keys is None else keys)
    there = set(_present_keys(frames, keys))
    return [(t, fk, dim) for t, fk, dim, pk in keys if (t, fk, dim, pk) not in there]


def _present_keys(frames: Frames, keys) -> list[tuple[str, str, str, str]]:
    out = []
    for t, fk, dim, pk in keys:
        try:
            fact, d = frames[t], frames[dim]
        except KeyError:
            continue
        if fk in fact.columns and pk in d.columns:
            out.append((t, fk, dim, pk))
    return out


def _bitmaps_of_keys(frames: Frames, dims: list[tuple[str, str]]) -> dict[tuple[str, str], DataFrame]:
    """The key bitmaps of each (dimension, key column) that fits a broadcast,
    all written by one job and measured by another (see :func:`orphan_rows`)."""
    if not dims:
        return {}
    named = None
    for i, (dim, pk) in enumerate(dims):
        m = key_bitmaps(frames[dim], pk).select(F.lit(i).alias("d"), "bucket", "bits")
        named = m if named is None else named.unionByName(m)
    maps = materialize(named, "bitmaps")
    sizes = maps.groupBy("d").agg(F.count(F.lit(1)).alias("buckets"), F.sum(F.bitmap_count("bits")).alias("keys")).collect()
    large = {r["d"] for r in sizes if _too_large(r["buckets"], r["keys"])}
    return {key: maps.filter(F.col("d") == i).select("bucket", "bits") for i, key in enumerate(dims) if i not in large}


def _look_up(df: DataFrame, checks: list[tuple[int, str, DataFrame]]) -> tuple[DataFrame, list[Column]]:
    """``df`` with the bitmap of each foreign key's bucket beside it, row for
    row, and two counters per check (tag, foreign key, bitmaps): rows whose
    key the dimension lacks, and rows without a key."""
    counters = []
    for tag, fk, maps in checks:
        bucket, bits, k = f"__bucket{tag}", f"__bits{tag}", F.col(fk).cast("bigint")
        df = df.join(F.broadcast(maps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))),
                     F.bitmap_bucket_number(k) == F.col(bucket), "left")
        counters += [F.count(F.when(k.isNotNull() & ~_in_bitmap(k, bits), F.lit(1))).cast("bigint").alias(f"__orphans{tag}"),
                     F.count(F.when(k.isNull(), F.lit(1))).cast("bigint").alias(f"__nulls{tag}")]
    return df, counters


def soft_key_suite(frames: Frames, keys: Iterable[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Q8: (table_name, fk_column, dim_table, orphan_rows, null_fk_rows) for
    every soft foreign key whose table, column and dimension are present.

    The dimensions' keys become bitmaps that go to every task; each table is
    scanned once, looks up all its foreign keys there and adds up, so no key
    of a fact is shuffled and a task holds no more than the bitmaps.  Keys
    of a dimension whose bitmaps are too large are counted per distinct
    value and anti-joined (:func:`_orphans_by_value`)."""
    keys = _present_keys(frames, list(S.soft_foreign_keys() if keys is None else keys))
    if not keys:
        spark = next((frames[t] for t in frames), None)
        if spark is None:
            raise ValueError("no table to check")
        return spark.sparkSession.createDataFrame(
            [], "table_name string, fk_column string, dim_table string, orphan_rows bigint, null_fk_rows bigint")
    checks, rest = _key_checks(frames, keys)
    out = _orphans_by_value(frames, rest) if rest else None
    for t, found in checks.items():
        part = _orphans_by_bitmap(frames, t, found)
        out = part if out is None else out.unionByName(part)
    return out


def _orphans_by_bitmap(frames: Frames, t: str, found: list[tuple[int, str, str, DataFrame]]) -> DataFrame:
    df, counters = _look_up(frames[t], [(tag, fk, maps) for tag, fk, _dim, maps in found])
    one = df.agg(*counters).select(F.explode(F.array(*[_key_cell(tag, fk, dim) for tag, fk, dim, _maps in found])).alias("x"))
    return one.select(F.lit(t).alias("table_name"), "x.fk_column", "x.dim_table", "x.orphan_rows", "x.null_fk_rows")


def _key_checks(frames: Frames, keys) -> tuple[dict[str, list[tuple[int, str, str, DataFrame]]], list]:
    """Per table its (tag, foreign key, dimension, bitmaps), and the keys whose dimension has no bitmaps."""
    maps = _bitmaps_of_keys(frames, list(dict.fromkeys((dim, pk) for _t, _fk, dim, pk in keys)))
    checks: dict[str, list[tuple[int, str, str, DataFrame]]] = {}
    for tag, (t, fk, dim, pk) in enumerate(keys):
        if (dim, pk) in maps:
            checks.setdefault(t, []).append((tag, fk, dim, maps[dim, pk]))
    return checks, [key for key in keys if (key[2], key[3]) not in maps]


def _key_cell(tag: int, fk: str, dim: str) -> Column:
    return F.struct(F.lit(fk).alias("fk_column"), F.lit(dim).alias("dim_table"),
                    F.col(f"__orphans{tag}").alias("orphan_rows"), F.col(f"__nulls{tag}").alias("null_fk_rows"))


def _orphans_by_value(frames: Frames, keys: list[tuple[str, str, str, str]]) -> DataFrame:
    """:func:`soft_key_suite` without bitmaps.

    Each table is scanned once for all its foreign keys: its key columns
    are unpivoted to (fk, key) pairs and counted per distinct pair
    (partial aggregation, so a hot key value costs one row per task).  The
    distinct pairs are anti-joined once with the dimension keys, tagged
    with the foreign key they serve (an anti join, so a dimension key
    listed twice does no harm); one shuffle for all keys."""
    by_table: dict[str, list[tuple[int, str]]] = {}
    for tag, (t, fk, _dim, _pk) in enumerate(keys):
        by_table.setdefault(t, []).append((tag, fk))
    pairs = None
    for t, fks in by_table.items():
        tagged = F.array(*[F.struct(F.lit(tag).alias("tag"), F.col(fk).cast("bigint").alias("k")) for tag, fk in fks])
        p = frames[t].select(F.explode(tagged).alias("p")).select("p.tag", "p.k")
        pairs = p if pairs is None else pairs.unionByName(p)
    # one row per (key, value) before any join: a hot value is combined map-side
    counts = pairs.groupBy("tag", "k").agg(F.count(F.lit(1)).alias("n"))
    dims = None
    for tag, (_t, _fk, dim, pk) in enumerate(keys):
        d = frames[dim].select(F.lit(tag).alias("d_tag"), F.col(pk).cast("bigint").alias("d_k"))
        dims = d if dims is None else dims.unionByName(d)
    missing = counts.join(dims, (counts["tag"] == dims["d_tag"]) & (counts["k"] == dims["d_k"]), "left_anti")
    per_fk = missing.groupBy("tag").agg(
        F.sum(F.when(F.col("k").isNotNull(), F.col("n")).otherwise(0)).cast("bigint").alias("orphan_rows"),
        F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)).cast("bigint").alias("null_fk_rows"))
    # every checked key gets a row, also when nothing is missing
    listed = pairs.sparkSession.createDataFrame(
        [(tag, t, fk, dim) for tag, (t, fk, dim, _pk) in enumerate(keys)],
        "l_tag int, table_name string, fk_column string, dim_table string")
    out = listed.join(per_fk, listed["l_tag"] == per_fk["tag"], "left")
    return out.select("table_name", "fk_column", "dim_table",
                      F.coalesce("orphan_rows", F.lit(0)).cast("bigint").alias("orphan_rows"),
                      F.coalesce("null_fk_rows", F.lit(0)).cast("bigint").alias("null_fk_rows"))


def soft_key_coverage(frames: Frames, keys: Iterable[tuple[str, str, str, str]] | None = None) -> DataFrame:
    """Q8/Q9: a row for every declared key, those that could not be checked
    included: (table_name, fk_column, dim_table, status, orphan_rows,
    null_fk_rows); the status is ``ok``, ``orphans`` or ``skipped``, with
    NULL counts for the last."""
    keys = list(S.soft_foreign_keys() if keys is None else keys)
    checked = soft_key_suite(frames, keys)
    listed = checked.sparkSession.createDataFrame([(t, fk, dim) for t, fk, dim, _ in keys], "t string, fk string, d string")
    out = listed.join(checked, (F.col("t") == F.col("table_name")) & (F.col("fk") == F.col("fk_column")), "left")
    status = F.when(F.col("orphan_rows").isNull(), "skipped").when(F.col("orphan_rows") > 0, "orphans").otherwise("ok")
    return out.select(F.col("t").alias("table_name"), F.col("fk").alias("fk_column"), F.col("d").alias("dim_table"),
                      status.alias("status"), "orphan_rows", "null_fk_rows")


def quality_profile(frames: Frames, names: Iterable[str] | None = None) -> DataFrame:
    """Column rules of every table present: the union of :func:`column_profile`."""
    out = None
    for t in (names or [n for n in S.TABLES]):
        try:
            df = frames[t]
        except KeyError:
            continue
        p = column_profile(df, t)
        out = p if out is None else out.unionByName(p)
    return out


def run_suite(frames: Frames, names: Iterable[str] | None = None) -> DataFrame:
    """Q9: every "expected 0" rule in one frame: (rule, table_name, subject,
    failing_rows, passed).

    Per table one aggregate pass yields the row count, every column rule and
    the foreign keys, which are looked up as in :func:`soft_key_suite`."""
    names = list(names or [n for n in S.TABLES])
    checks, rest = _key_checks(frames, _present_keys(frames, list(S.soft_foreign_keys())))
    parts = []
    spark = None
    for t in names:
        try:
            df = frames[t]
        except KeyError:
            df = None
        if df is None:
            if t in S.ROW_MINIMUMS:
                parts.append(("missing", t, None))
            continue
        spark = df.sparkSession
        preds = rule_predicates(df, t)
        counters = [F.count(F.when(p, F.lit(1))).cast("bigint").alias(f"{r}::{c}")
                    for c, r, p in preds]
        mine = checks.pop(t, [])
        looked, orphans = _look_up(df, [(tag, fk, maps) for tag, fk, _dim, maps in mine])
        one = looked.agg(F.count(F.lit(1)).alias("__rows"), *counters, *orphans)
        cells = [F.struct(F.lit(r).alias("rule"), F.lit(c).alias("subject"), F.col(f"{r}::{c}").alias("failing_rows"))
                 for c, r, _ in preds]
        if t in S.ROW_MINIMUMS:
            low = F.when(F.col("__rows") >= S.ROW_MINIMUMS[t], F.lit(0)).otherwise(F.lit(1)).cast("bigint")
            cells.append(F.struct(F.lit("row_count").alias("rule"), F.lit("*").alias("subject"),
                                  low.alias("failing_rows")))
        cells += [F.struct(F.lit("foreign_key").alias("rule"), F.lit(f"{fk}->{dim}").alias("subject"),
                           F.col(f"__orphans{tag}").alias("failing_rows")) for tag, fk, dim, _maps in mine]
        if cells:
            parts.append(("rows", t, one.select(F.explode(F.array(*cells)).alias("x")).select(
                "x.rule", F.lit(t).alias("table_name"), "x.subject", "x.failing_rows")))
    out = None
    for kind, t, p in parts:
        if kind == "missing":
            if spark is None:
                continue
            p = spark.range(1).select(F.lit("row_count").alias("rule"), F.lit(t).alias("table_name"),
                                      F.lit("*").alias("subject"), F.lit(1).cast("bigint").alias("failing_rows"))
        out = p if out is None else out.unionByName(p)
    # keys of tables that are not profiled, and keys without bitmaps
    fks = [_orphans_by_bitmap(frames, t, found) for t, found in checks.items()] + ([_orphans_by_value(frames, rest)] if rest else [])
    for fk in fks:
        out = out.unionByName(fk.select(
            F.lit("foreign_key").alias("rule"), "table_name",
            F.concat_ws("->", "fk_column", "dim_table").alias("subject"),
            F.col("orphan_rows").alias("failing_rows")))
    for t, key in S.UNIQUE_KEYS.items():
        if t in names and key in _columns(frames, t):
            out = out.unionByName(unique_key_check(frames[t], key).agg(
                F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("failing_rows"))
                .select(F.lit("unique").alias("rule"), F.lit(t).alias("table_name"),
                        F.lit(key).alias("subject"), "failing_rows"))
    return out.withColumn("passed", F.col("failing_rows") == 0)


def _columns(frames: Frames, t: str) -> list[str]:
    try:
        return frames[t].columns
    except KeyError:
        return []


def validation_summary(frames: Frames, names: Iterable[str] | None = None) -> DataFrame:
    """(table_name, good_rows, rejected_rows) of :func:`split_valid` for every
    table present, one aggregate pass per table."""
    out = None
    for t in (names or list(S.TABLES)):
        try:
            df = frames[t]
        except KeyError:
            continue
        preds = [p for _, _, p in rule_predicates(df, t)]
        bad = F.lit(False)
        for p in preds:
            bad = bad | p
        row = df.agg(F.count(F.when(~bad, F.lit(1))).cast("bigint").alias("good_rows"),
                     F.count(F.when(bad, F.lit(1))).cast("bigint").alias("rejected_rows")) \
            .select(F.lit(t).alias("table_name"), "good_rows", "rejected_rows")
        out = row if out is None else out.unionByName(row)
    return out
