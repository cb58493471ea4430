"""Typed loading, defaults, partitioned writes and key generation.

All reads use the declared schemas; all writes go to a new directory and
switch a pointer afterwards, so a failed or repeated load never leaves a
half-written table behind (the reference drops and reloads everything on
every start; ours is an idempotent full refresh).
"""

from __future__ import annotations

import uuid as _uuid
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermart.session import checkpoint_dir, materialize
from ledgermart.sources import pointer, stored
from ledgermart.sources import schemas as S

# ------------------------------------------------------------------- read

def conform(df: DataFrame, name: str, add_missing: bool = True) -> DataFrame:
    """Cast every declared column present in ``df`` to its declared type
    with ``try_cast`` (a misfit becomes NULL instead of failing the job),
    trim fixed-width text, and add absent declared columns as NULL.
    Column order follows the declaration; undeclared columns are dropped."""
    present = set(df.columns)
    cols = []
    for c in S.columns(name):
        if c.name in present:
            x = F.col(c.name)
            if c.fixed:
                x = F.rtrim(x.cast("string"))
            cols.append(x.try_cast(S.spark_type(c.dtype)).alias(c.name))
        elif add_missing:
            cols.append(F.lit(None).cast(S.spark_type(c.dtype)).alias(c.name))
    if S.MISFITS in present:
        cols.append(F.col(S.MISFITS))
    return df.select(*cols)


def with_misfits(raw: DataFrame, name: str) -> DataFrame:
    """Tag rows, before any cast, with ``type:column`` for every non-NULL
    value that its declared type cannot hold."""
    present = set(raw.columns)
    checks = [F.when(F.col(c.name).isNotNull() & F.col(c.name).try_cast(S.spark_type(c.dtype)).isNull(), F.lit(f"type:{c.name}"))
              for c in S.columns(name) if c.name in present and raw.schema[c.name].dataType != S.spark_type(c.dtype)]
    found = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return raw.withColumn(S.MISFITS, found)


def misfits(raw: DataFrame, name: str) -> DataFrame:
    """Rows whose non-NULL values do not survive the cast to the declared
    type: (column_name, raw_value) pairs, one per failing cell."""
    present = set(raw.columns)
    checks = [F.when(F.col(c.name).isNotNull() & F.col(c.name).try_cast(S.spark_type(c.dtype)).isNull(),
                     F.struct(F.lit(c.name).alias("column_name"),
                              F.col(c.name).cast("string").alias("raw_value")))
              for c in S.columns(name) if c.name in present]
    if not checks:
        return raw.sparkSession.createDataFrame([], "column_name string, raw_value string")
    return raw.select(F.explode(F.array_compact(F.array(*checks))).alias("m")).select("m.*")


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet",
               options: Mapping[str, str] | None = None, typed: bool = True) -> DataFrame:
    """L2: read ``name`` from ``path`` and conform it to the declared schema
    (``typed=False`` leaves the values as they are, so that the load can
    reject what does not fit instead of reading NULL).

    Declared columns the source lacks stay absent, so that
    :func:`fill_defaults` can still supply their defaults (an explicit NULL
    would not get one); ``conform(df, name)`` adds the rest as NULL.

    Parquet is read with its own footer schema, then cast (so column
    pruning and filter pushdown still reach the scan); CSV is read as text
    by header name (no inference pass over the data); JSON is read with
    the declared names as text fields.  Both are then cast."""
    reader = spark.read.options(**(options or {}))
    if fmt == "parquet":
        raw = reader.parquet(path)
    elif fmt == "csv":
        raw = reader.option("header", "true").option("inferSchema", "false").csv(path)
    elif fmt == "json":
        text_schema = ", ".join(f"`{c.name}` string" for c in S.columns(name))
        raw = reader.schema(text_schema).json(path)
    else:
        raw = reader.format(fmt).load(path)
    return conform(raw, name, add_missing=False) if typed else raw


def fill_defaults(df: DataFrame, name: str, load_date: str | None = None,
                  load_ts: str | None = None) -> DataFrame:
    """L3: add declared defaults for columns **absent** from ``df``; an
    explicit NULL in a present column stays NULL.  ``CURRENT_DATE`` and
    ``CURRENT_TIMESTAMP`` are fixed once per load (pass them to replay a
    batch identically); UUIDs are random, so write before reusing."""
    present = set(df.columns)
    d = F.lit(load_date).cast("date") if load_date else F.current_date()
    ts = F.lit(load_ts).cast("timestamp_ntz") if load_ts else F.localtimestamp()
    out = df
    for c in S.columns(name):
        if c.name in present or c.default is None or c.key:
            continue
        if c.default == S.CURRENT_DATE:
            v = d
        elif c.default == S.CURRENT_TIMESTAMP:
            v = ts
        elif c.default == S.UUID:
            v = F.expr("uuid()")
        elif isinstance(c.default, bool):
            v = F.lit(c.default)
        else:
            v = F.lit(str(c.default))
        out = out.withColumn(c.name, v.cast(S.spark_type(c.dtype)))
    return out


# ------------------------------------------------------------ partitions

def year_ranges(first_year: int, last_year: int) -> list[tuple[str, int, int]]:
    """Half-open yearly ranges ``[yyyy0101, (yyyy+1)0101)`` as (label, lo, hi)."""
    return [(str(y), y * 10000 + 101, (y + 1) * 10000 + 101) for y in range(first_year, last_year + 1)]


def range_label(key: Column, ranges: Sequence[tuple[str, int, int]], default: str = "default") -> Column:
    """Partition label of a date key: the range ``lo <= key < hi`` it falls
    in, else ``default`` (also for NULL keys)."""
    expr = None
    for label, lo, hi in ranges:
        cond = (key >= lo) & (key < hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default)) if expr is not None else F.lit(default)


def with_partition_label(df: DataFrame, key: str, ranges, part_col: str = "booking_year") -> DataFrame:
    return df.withColumn(part_col, range_label(F.col(key), ranges))


def write_range_partitioned(df: DataFrame, path: str, key: str, ranges, part_col: str = "booking_year",
                            files_per_range: int | None = None, mode: str = "overwrite", bloom: Sequence[str] = ()) -> None:
    """Write ``df`` partitioned by the yearly (or any) range of ``key``.

    Rows are range-partitioned on the key before the write, so every task
    writes a contiguous key slice into a few partition folders and each
    file's row groups carry tight min/max statistics for later skipping;
    a year is never funnelled into a single task.  A seeded random
    tiebreaker in the range key splits a hot day (one date holding a
    third of all rows) over several tasks instead of one.  ``bloom`` names
    the columns that get Parquet Bloom filters."""
    out = with_partition_label(df, key, ranges, part_col)
    n = files_per_range * (len(ranges) + 1) if files_per_range else None
    order = [F.col(key), F.rand(seed=17)]
    out = out.repartitionByRange(n, *order) if n else out.repartitionByRange(*order)
    (out.sortWithinPartitions(key).write.mode(mode).options(**stored.bloom_options(bloom)).partitionBy(part_col).parquet(path))


def prune_by_date_key(df: DataFrame, key: str, from_sk: int, to_sk: int, ranges,
                      part_col: str = "booking_year") -> DataFrame:
    """Rows with ``from_sk <= key <= to_sk``, plus a predicate on the
    partition column listing only the touched ranges, so the scan reads
    only those folders.  ``default`` stays in the list unless the whole
    interval lies inside the named ranges."""
    touched = [label for label, lo, hi in ranges if lo <= to_sk and from_sk < hi]
    inside = any(lo <= from_sk for _, lo, _ in ranges) and any(to_sk < hi for _, _, hi in ranges) and \
        _covered(from_sk, to_sk, ranges)
    labels = touched + ([] if inside else ["default"])
    return df.filter(F.col(part_col).isin(labels) & F.col(key).between(from_sk, to_sk))


def _covered(lo_key: int, hi_key: int, ranges) -> bool:
    spans = sorted((lo, hi) for _, lo, hi in ranges)
    cur = lo_key
    for lo, hi in spans:
        if lo <= cur < hi:
            cur = hi
    return cur > hi_key


# --------------------------------------------------------------- keys

def append_with_keys(new_rows: DataFrame, existing: DataFrame | None, key: str,
                     order_by: Sequence[str] | None = None, num_partitions: int | None = None,
                     existing_key: str | None = None) -> DataFrame:
    """Give ``new_rows`` dense surrogate keys continuing after the
    highest key in ``existing`` (1 when empty).

    With ``order_by`` the keys follow that order: rows are range-partitioned
    on it (a seeded random tiebreaker spreads a hot value over several
    partitions) and sorted inside each partition.  Without it the keys
    follow the rows' current layout, as a sequence hands out numbers in
    arrival order, and no shuffle is needed.

    No single-partition window over the data: each row is tagged with its
    partition id and position, and the tagged rows are written as Parquet to
    the shared checkpoint folder (``session.materialize``), so every later
    pass reads the same tags and a lost executor recomputes nothing
    inconsistent; the per-partition counts (one row per partition) give
    running offsets, joined back by broadcast."""
    spark = new_rows.sparkSession
    checkpoint_dir(spark)
    # highest existing key: an uncorrelated scalar subquery, evaluated once
    base = (existing.select(F.coalesce(F.max(existing_key or key), F.lit(0)).cast("bigint")).scalar()
            if existing is not None else F.lit(0).cast("bigint"))
    laid = new_rows
    if order_by:
        # without a number AQE merges small ranges, neighbours only, so the order stays
        by = ([num_partitions] if num_partitions else []) + [*order_by, "__tb"]
        laid = laid.withColumn("__tb", F.rand(seed=29)).repartitionByRange(*by).sortWithinPartitions(*order_by, "__tb")
    laid = (laid.withColumn("__pid", F.spark_partition_id())
            .withColumn("__pos", F.monotonically_increasing_id() - (F.spark_partition_id().cast("bigint") * (1 << 33))))
    if order_by:
        laid = laid.drop("__tb")
    laid = materialize(laid, "keys")
    counts = laid.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # this window sees one row per partition only (bounded by the partition count)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).select("__pid", "__off")
    keyed = laid.join(F.broadcast(offsets), "__pid")
    return keyed.withColumn(key, base + F.col("__off") + F.col("__pos") + 1).drop("__pid", "__pos", "__off")


def key_high_water(frames: Mapping[str, DataFrame], names: Iterable[str] | None = None) -> DataFrame:
    """(table_name, key_column, last_key, next_key) per table with a
    generated key; ``next_key`` is 1 for an empty table."""
    out = None
    for t in (names or list(S.TABLES)):
        k = S.key_column(t)
        try:
            df = frames[t]
        except KeyError:
            continue
        if not k or k not in df.columns:
            continue
        row = df.agg(F.max(F.col(k).cast("bigint")).alias("last_key")).select(
            F.lit(t).alias("table_name"), F.lit(k).alias("key_column"), "last_key",
            (F.coalesce(F.col("last_key"), F.lit(0)) + 1).cast("bigint").alias("next_key"))
        out = row if out is None else out.unionByName(row)
    return out


def key_high_water_all(frames: Mapping[str, DataFrame]) -> DataFrame:
    """L8 for every declared table with a generated key: as
    :func:`key_high_water`, and (``present`` false, no last key, next key 1)
    for a table that is not there, whose keys start anew."""
    here = key_high_water(frames)
    declared = [(t, S.key_column(t)) for t in S.TABLES if S.key_column(t)]
    listed = here.sparkSession.createDataFrame(declared, "t string, k string")
    out = listed.join(here, F.col("t") == F.col("table_name"), "left")
    return out.select(F.col("t").alias("table_name"), F.col("k").alias("key_column"), F.col("table_name").isNotNull().alias("present"),
                      "last_key", F.coalesce("next_key", F.lit(1)).cast("bigint").alias("next_key"))


# ------------------------------------------------------------ bucketing

def write_bucketed(df: DataFrame, table: str, keys: Sequence[str], num_buckets: int, path: str,
                   mode: str = "overwrite") -> None:
    """Write ``df`` as a catalogue table bucketed and sorted by ``keys``.

    A fact and its largest dimension written with the same keys and bucket
    count join bucket by bucket: the planner sees matching hash
    partitioning on both scans and inserts no exchange, so the fact is
    never shuffled for that join (e.g. loans and customers on
    ``customer_sk``).  Pick ``num_buckets`` so one bucket of the fact fits
    a task comfortably (a few hundred MB)."""
    (df.write.mode(mode).bucketBy(num_buckets, *keys).sortBy(*keys)
     .option("path", path).format("parquet").saveAsTable(table))


def register_bucketed(spark: SparkSession, table: str, path: str, keys: Sequence[str], num_buckets: int) -> None:
    """Re-attach bucketed files written by :func:`write_bucketed` in a new
    session (the bucket spec lives in the catalogue, not in the files)."""
    cols = ", ".join(keys)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} USING parquet CLUSTERED BY ({cols}) "
              f"SORTED BY ({cols}) INTO {num_buckets} BUCKETS LOCATION '{path}'")


# ------------------------------------------------------------ statistics

def collect_statistics(df: DataFrame, table: str = "", exact_distinct: bool = False) -> DataFrame:
    """(table_name, column_name, row_count, null_count, min_value,
    max_value, distinct_count).

    Counts, NULLs, minima and maxima come from one aggregate pass.
    Distinct counts are HyperLogLog estimates in the same pass by default.
    ``exact_distinct`` counts them exactly without one expansion per column:
    every cell becomes a (column, value) pair, pairs are de-duplicated with
    partial aggregation and counted per column, so one shuffle serves all
    columns.  Floating-point values are normalised (-0.0 = 0.0) first."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for c in df.columns:
        col = F.col(c)
        aggs += [F.sum(F.when(col.isNull(), 1).otherwise(0)).cast("bigint").alias(f"{c}__nulls"),
                 F.min(col).cast("string").alias(f"{c}__min"),
                 F.max(col).cast("string").alias(f"{c}__max")]
        if not exact_distinct:
            aggs.append(F.approx_count_distinct(col).cast("bigint").alias(f"{c}__ndv"))
    one = df.agg(*aggs)
    stacked = one.select("__rows", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__nulls").alias("null_count"),
                 F.col(f"{c}__min").alias("min_value"), F.col(f"{c}__max").alias("max_value"),
                 (F.lit(None).cast("bigint") if exact_distinct else F.col(f"{c}__ndv")).alias("distinct_count"))
        for c in df.columns])).alias("s"))
    out = stacked.select(F.lit(table).alias("table_name"), "s.column_name",
                         F.col("__rows").cast("bigint").alias("row_count"),
                         "s.null_count", "s.min_value", "s.max_value", "s.distinct_count")
    if not exact_distinct:
        return out
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}

    def cell(c: str) -> Column:
        v = F.col(c)
        if c in floating:
            v = F.when(v == 0, F.lit(0.0)).otherwise(v)
        return F.struct(F.lit(c).alias("c"), v.cast("string").alias("v"))

    cells = df.select(F.explode(F.array(*[cell(c) for c in df.columns])).alias("x")).select("x.c", "x.v") \
        .filter(F.col("v").isNotNull())
    ndv = cells.distinct().groupBy("c").agg(F.count(F.lit(1)).alias("__ndv"))
    j = out.drop("distinct_count").join(ndv, out["column_name"] == ndv["c"], "left")
    return j.select("table_name", "column_name", "row_count", "null_count", "min_value", "max_value",
                    F.coalesce("__ndv", F.lit(0)).cast("bigint").alias("distinct_count"))


def analyze_table(spark: SparkSession, table: str) -> None:
    """L9 for catalogue tables: planner statistics for CBO and AQE."""
    spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR ALL COLUMNS")


# ------------------------------------------------------------ refresh

def full_refresh(frames: Mapping[str, DataFrame], root: str, order: Sequence[str] | None = None,
                 partitioned: Mapping[str, tuple[str, list]] | None = None, run_id: str | None = None,
                 layout: Mapping[str, Mapping[str, Sequence[str]]] | None = None,
                 check: Callable[[str], None] | None = None, keyed: Iterable[str] = ()) -> str:
    """L4: write every table in load order (reference, dimensions, bridges,
    facts) under ``root/<run_id>/<table>``, stopping at the first failure,
    then publish the run as the current one (:mod:`.pointer`).  Readers use
    :func:`read_current`; a failed run never replaces the current one.
    ``check(run_folder)`` runs before that and stops it by raising.

    ``partitioned`` names range-partitioned facts (key, ranges);
    ``layout`` gives other tables ``partition_by`` folders (e.g. the
    current-version flag of a type 2 dimension, the Parquet counterpart of
    a partial index) and ``sort_by`` columns (date key and main foreign
    key, the counterpart of a plain index: row-group min/max statistics
    then let scans skip) and ``bloom`` columns (single values skip row
    groups).  Tables with such a layout and those of ``keyed``, whose
    generated key follows from the rows' positions, get a manifest
    (:mod:`.stored`)."""
    run_id = run_id or _uuid.uuid4().hex[:12]
    order = [t for t in (order or S.LOAD_ORDER) if t in frames]
    partitioned = partitioned or {}
    layout = layout or {}
    spark = None
    for t in order:
        df = frames[t]
        spark = df.sparkSession
        target = f"{root}/{run_id}/{t}"
        spec = layout.get(t, {})
        bloom = [c for c in spec.get("bloom", ()) if c in df.columns]
        recorded = [*([partitioned[t][0]] if t in partitioned else []), *spec.get("partition_by", ()), *spec.get("sort_by", ())]
        if t in partitioned:
            key, ranges = partitioned[t]
            write_range_partitioned(df, target, key, ranges, bloom=bloom)
            stored.write_manifest(spark, f"{root}/{run_id}", t, recorded, t in keyed)
            continue
        sort_by = [c for c in spec.get("sort_by", ()) if c in df.columns]
        part_by = [c for c in spec.get("partition_by", ()) if c in df.columns]
        out = df
        if part_by:
            # few files per folder, and a hot folder value spread over tasks
            out = out.repartitionByRange(*[F.col(c) for c in part_by], F.rand(seed=23))
        if sort_by or part_by:
            out = out.sortWithinPartitions(*(part_by + sort_by))
        w = out.write.mode("overwrite").options(**stored.bloom_options(bloom))
        if part_by:
            w = w.partitionBy(*part_by)
        w.parquet(target)
        if recorded or t in keyed:
            stored.write_manifest(spark, f"{root}/{run_id}", t, recorded, t in keyed)
    if check is not None:
        check(f"{root}/{run_id}")
    if spark is not None:
        pointer.publish(spark, root, run_id)
    return run_id


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table as of the current run.  Partition folder values come back
    as inferred text or numbers, so declared columns are cast back to their
    declared types (a cast on a partition column still prunes folders)."""
    run_id = pointer.current(spark, root)
    if run_id is None:
        raise FileNotFoundError(f"nothing was loaded into {root}")
    return read_run(spark, f"{root}/{run_id}", table)


def read_run(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One table of one run, typed as in :func:`read_current`.  A generated
    key that the source did not have comes from the rows' positions."""
    try:
        df = spark.read.parquet(f"{folder}/{table}")
        manifest = stored.read_manifest(spark, folder, table)
        told = manifest.agg(F.max("keyed").alias("keyed"), F.count(F.lit(1)).alias("files")).first() if manifest is not None else None
        if told and told["keyed"]:
            df = stored.keys_from_positions(df, manifest, table, S.key_column(table), files=told["files"])
    except AnalysisException as failed:
        # a write of no rows into partition folders leaves the folder but no file to take a schema from
        if failed.getCondition() != "UNABLE_TO_INFER_SCHEMA" or pointer.folders(spark, f"{folder}/{table}"):
            raise
        df = conform(spark.createDataFrame([], "__none string"), table)
    if table not in S.TABLES:
        return df
    declared = {c.name: S.spark_type(c.dtype) for c in S.columns(table)}
    fixes = {c: F.col(c).cast(declared[c]) for c, t in df.dtypes
             if c in declared and t != declared[c].simpleString()}
    return df.withColumns(fixes) if fixes else df


def register_views(spark: SparkSession, frames: Mapping[str, DataFrame], names: Iterable[str] | None = None) -> list[str]:
    """Expose frames (tables, marts) to SQL by name; nothing is materialised."""
    done = []
    for n in (names or list(frames)):
        try:
            frames[n].createOrReplaceTempView(n)
            done.append(n)
        except KeyError:
            continue
    return done


def data_dictionary(spark: SparkSession, names: Iterable[str] | None = None) -> DataFrame:
    """The declared model as rows: (namespace, table_name, table_comment,
    column_name, data_type, not_null, max_len, default_value, allowed_values,
    is_key, is_pii)."""
    rows = []
    for t in (names or list(S.TABLES)):
        for c in S.columns(t):
            rows.append((S.namespace(t), t, S.TABLE_COMMENTS.get(t), c.name, c.dtype, not c.nullable, c.max_len,
                         None if c.default is None else str(c.default).upper() if isinstance(c.default, bool)
                         else str(c.default), ",".join(c.domain) if c.domain else None, c.key, c.pii))
    return spark.createDataFrame(rows, "namespace string, table_name string, table_comment string, column_name string, "
                                       "data_type string, not_null boolean, max_len int, default_value string, "
                                       "allowed_values string, is_key boolean, is_pii boolean")
