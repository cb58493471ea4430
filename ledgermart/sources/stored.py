"""What is known about the files of a stored run: the manifest.

After a table is written, one aggregate pass records per file the number of
rows, the rows before it (in file order) and the least and greatest value of
the columns that the layout sorts or partitions by.  The manifest is a small
table of its own under ``<run>/_manifest/<table>`` and serves two ends:

* **keys from positions (L7)**: a table that was written without its
  generated key gets it when it is read, as first key of the file plus the
  row's position in it.  Files are never changed after they are written, so
  the keys are fixed, dense and unique without a second write;
* **pruning (L6)**: a range on a recorded column chooses files before Spark
  lists or opens them; Parquet Bloom filters on the foreign keys
  (:func:`bloom_options`) then skip row groups for single values.

A manifest has one row per file, a few hundred bytes less than what the
driver's own file listing holds of it.  It is broadcast up to
``BROADCAST_FILES`` files; beyond, the join is left to Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermart.sources import pointer
from ledgermart.sources import schemas as S

#: Files up to which a manifest (about 100 bytes a row) is broadcast.
BROADCAST_FILES = 200_000


def manifest_path(folder: str, table: str) -> str:
    return f"{folder}/_manifest/{table}"


def _file(table: str) -> Column:
    """The file of a row, relative to the table's folder."""
    return F.element_at(F.split("_metadata.file_path", f"/{table}/"), -1)


def write_manifest(spark: SparkSession, folder: str, table: str, columns: Iterable[str] = (), keyed: bool = False) -> DataFrame | None:
    """Record the files of ``folder/table``; ``keyed`` says that the table's
    generated key follows from positions.  None for a table without files."""
    try:
        df = spark.read.parquet(f"{folder}/{table}")
    except AnalysisException as failed:
        if failed.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return None
    columns = [c for c in dict.fromkeys(columns) if c in df.columns]
    ends = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    files = df.select(_file(table).alias("file"), *columns).groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *ends)
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)   # one row per file
    out = files.withColumn("rows_before", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("keyed", F.lit(keyed))
    out.coalesce(1).write.mode("overwrite").parquet(manifest_path(folder, table))
    return spark.read.parquet(manifest_path(folder, table))


def read_manifest(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    path = manifest_path(folder, table)
    return spark.read.parquet(path) if pointer.exists(spark, path) else None


def keys_from_positions(df: DataFrame, manifest: DataFrame, table: str, key: str, base: int = 0,
                        files: int | None = None) -> DataFrame:
    """``df`` as read from the files of ``manifest``, with the generated key
    ``base`` + rows before the file + position in the file + 1.  A query
    that does not use the key does not run the join either (the right side
    is known to be unique, so Spark drops it)."""
    first = manifest.groupBy("file").agg(F.max("rows_before").alias("__first"))
    if (manifest.count() if files is None else files) <= BROADCAST_FILES:
        first = F.broadcast(first)
    placed = df.withColumns({"__file": _file(table), "__row": F.col("_metadata.row_index")})
    value = (F.lit(base).cast("bigint") + F.col("__first") + F.col("__row") + 1)
    kind = df.schema[key].dataType if key in df.columns else None
    out = placed.join(first, placed["__file"] == first["file"], "left")
    cells = [F.col(c) for c in df.columns if c != key]
    at = df.columns.index(key) if key in df.columns else 0
    cells.insert(at, (value.cast(kind) if kind is not None else value).alias(key))
    return out.select(*cells)


# ------------------------------------------------------------ pruning

def bloom_options(columns: Sequence[str]) -> dict[str, str]:
    """Writer options for Bloom filters on ``columns``, sized by what is in a row group."""
    out = {"parquet.bloom.filter.adaptive.enabled": "true"} if columns else {}
    for c in columns:
        out[f"parquet.bloom.filter.enabled#{c}"] = "true"
    return out


def files_in_range(manifest: DataFrame, ranges: Mapping[str, tuple]) -> list[str]:
    """The files that can hold a row with every column in its (low, high)
    range, ends included; columns that the manifest does not record rule out nothing."""
    out = manifest
    for c, (low, high) in ranges.items():
        if f"min_{c}" in manifest.columns:
            out = out.filter((F.col(f"min_{c}") <= high) & (F.col(f"max_{c}") >= low))
    return sorted(r["file"] for r in out.select("file").toLocalIterator())


def read_pruned(spark: SparkSession, folder: str, table: str, ranges: Mapping[str, tuple],
                values: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Rows of a stored table with every column of ``ranges`` in its range
    and every column of ``values`` among the given ones.  Only the files
    that the manifest does not rule out are listed; the predicates go to the
    scan, where row-group statistics and Bloom filters skip further."""
    manifest, base = read_manifest(spark, folder, table), f"{folder}/{table}"
    keep = F.lit(True)
    for c, (low, high) in ranges.items():
        keep = keep & F.col(c).between(low, high)
    for c, some in (values or {}).items():
        keep = keep & F.col(c).isin(list(some))
    if manifest is None:
        return spark.read.parquet(base).filter(keep)
    files = files_in_range(manifest, ranges)
    if not files:
        return spark.read.parquet(base).filter(F.lit(False))
    return spark.read.option("basePath", base).parquet(*[f"{base}/{f}" for f in files]).filter(keep)


# ------------------------------------------------------------ planner statistics

#: Settings under which Spark's planner uses column statistics.
COST_BASED = {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.cbo.planStats.enabled": "true"}


def register_tables(spark: SparkSession, folder: str, tables: Iterable[str], database: str = "default") -> list[str]:
    """Make the files of a run catalogue tables of ``database`` (external:
    dropping them leaves the files), partition columns with their declared
    types.  They last as long as the catalogue.  A key that follows from
    positions is NULL in them; :func:`ledgermart.sources.load.read_run` has it."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    done = []
    for t in tables:
        name, path = f"`{database}`.`{t}`", f"{folder}/{t}"
        declared = {c.name: S.spark_type(c.dtype).simpleString() for c in S.columns(t)} if t in S.TABLES else {}
        parts = sorted({n.split("=", 1)[0] for n in pointer.folders(spark, path) if "=" in n})
        fields = [(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema]
        columns = ", ".join(f"`{n}` {declared.get(n, kind)}" for n, kind in fields)
        by = f"PARTITIONED BY ({', '.join(f'`{n}`' for n in parts)})" if parts else ""
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {by} LOCATION '{path}'")
        if parts:
            spark.sql(f"MSCK REPAIR TABLE {name}")
        done.append(t)
    return done


def planner_columns(df: DataFrame) -> list[str]:
    """The columns that joins and filters use: keys, dates and flags."""
    return [c for c, kind in df.dtypes if c.endswith("_sk") or kind in ("boolean", "date")]


def analyze_tables(spark: SparkSession, tables: Iterable[str], database: str = "default",
                   columns: Mapping[str, Sequence[str]] | None = None) -> None:
    """ANALYZE with equi-height histograms for the columns of
    :func:`planner_columns` (or those given): row counts, sizes, distinct
    counts and the distribution of values, for the cost-based optimiser."""
    setting = "spark.sql.statistics.histogram.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        for t in tables:
            name = f"`{database}`.`{t}`"
            use = list((columns or {}).get(t) or planner_columns(spark.table(name)))
            what = f"FOR COLUMNS {', '.join(f'`{c}`' for c in use)}" if use else ""
            spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS {what}")
    finally:
        spark.conf.set(setting, before)


# ------------------------------------------------------------ mergeable statistics

#: 2^12 registers: distinct counts within about 5 % (three standard errors);
#: quantile sketches of size 200: ranks within about 1.65 %.
HLL_BITS, KLL_SIZE = 12, 200
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def sketch_statistics(df: DataFrame, by: Column, columns: Sequence[str] | None = None) -> DataFrame:
    """(part, column_name, row_count, null_count, min_value, max_value,
    distinct, quantiles) per part of the table, e.g. per day: counts and ends,
    an HLL sketch and, for numbers, a KLL sketch.  A new day costs the
    aggregation of that day; stored rows are merged by :func:`merge_statistics`.

    One aggregation for all columns, no row is expanded per cell."""
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    cells = []
    for c in columns:
        v = F.col(c)
        number = kinds[c] in (*_WHOLE, "float", "double") or kinds[c].startswith("decimal")
        # -0.0 and 0.0 are one value; other types are told apart by their text
        norm = F.when(v == 0, F.lit(0).cast(kinds[c])).otherwise(v) if kinds[c] in ("float", "double") else v
        quantiles = F.kll_sketch_agg_double(v.cast("double"), F.lit(KLL_SIZE)) if number else F.lit(None).cast("binary")
        cells.append(F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("row_count"), F.sum(v.isNull().cast("bigint")).alias("null_count"),
            F.min(v).cast("string").alias("min_value"), F.max(v).cast("string").alias("max_value"),
            F.min(v.cast("double") if number else F.lit(None).cast("double")).alias("min_number"),
            F.max(v.cast("double") if number else F.lit(None).cast("double")).alias("max_number"),
            F.hll_sketch_agg(norm.cast("string"), F.lit(HLL_BITS)).alias("distinct"), quantiles.alias("quantiles")))
    parts = df.groupBy(by.alias("part")).agg(F.array(*cells).alias("cells"))
    return parts.select("part", F.inline("cells"))


def merge_statistics(parts: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """(column_name, row_count, null_count, min_value, max_value,
    distinct_count, quantiles) of the parts together."""
    ask = F.array(*[F.lit(float(q)) for q in quantiles])
    number = F.col("min_number").isNotNull()
    least = F.min(F.when(F.col("min_value").isNotNull(), F.struct(F.when(number, F.col("min_number")).alias("n"), "min_value")))
    most = F.max(F.when(F.col("max_value").isNotNull(), F.struct(F.when(number, F.col("max_number")).alias("n"), "max_value")))
    merged = parts.groupBy("column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"),
        least["min_value"].alias("min_value"), most["max_value"].alias("max_value"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_count"),
        F.kll_merge_agg_double("quantiles").alias("k"))
    enough = F.col("k").isNotNull() & (F.kll_sketch_get_n_double("k") > 0)
    return merged.select("column_name", "row_count", "null_count", "min_value", "max_value", "distinct_count",
                         F.when(enough, F.kll_sketch_get_quantile_double("k", ask)).alias("quantiles"))
