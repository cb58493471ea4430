"""Session construction with the settings every job in this library assumes."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings the library relies on.  ANSI stays on (overflow and division by
# zero raise, as in the reference); the session zone is UTC so that
# zone-free timestamps never shift date keys; AQE re-plans joins from
# measured shuffle sizes and splits skewed join partitions.
BASE_CONF = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # broadcast at runtime only when the measured side is below this size
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of key assignment go away with their DataFrames
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Suggested settings for a large cluster (about 1000 executors, 100 TB):
# start with many shuffle partitions and let AQE coalesce them to the
# advisory size; split skewed join partitions early; read big Parquet
# splits; broadcast only what AQE measured below 64 MB.
CLUSTER_CONF = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.parquet.aggregatePushdown": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "ledgermart", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's settings.

    On a cluster pass ``master=None`` and let spark-submit decide; size
    ``shuffle_partitions`` to the data (AQE coalesces small ones anyway).
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if not master or not master.startswith("local"):
        conf.update(CLUSTER_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        conf.setdefault("spark.driver.memory", os.environ.get("LEDGERMART_DRIVER_MEMORY", "16g"))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; we read it from the
    session.  Only when it is unset (local tests) do we pick a scratch
    folder of our own, and that is only sensible in local mode.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="ledgermart-ckpt-")
    sc.setCheckpointDir(local)
    try:
        spark.conf.set("spark.checkpoint.dir", local)
    except Exception:  # a core setting may be read-only at run time; the context has it
        pass
    return local


def materialize(df, label: str = "stage", partition_by: tuple[str, ...] = ()):
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint
    folder and reading it back.  Columnar and compressed, so cheaper than
    an RDD checkpoint of wide rows; the files are durable, so a lost
    executor never forces a recomputation of what was written.

    The folder goes when the driver ends, or earlier with the
    :func:`scratch` block in which it was written; the shuffle files that
    led to it go at once."""
    spark = df.sparkSession
    path = scratch_folder(spark, label)
    # the shuffle files of this write are not needed once it is there
    cleanup, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    try:
        before = spark.conf.get(cleanup)
        spark.conf.set(cleanup, "true")
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(cleanup, before)
    return spark.read.schema(df.schema).parquet(path) if partition_by else spark.read.parquet(path)


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder under the shared checkpoint folder, not made yet; it goes
    when the driver ends or with the :func:`scratch` block."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/ledgermart/{label}-{uuid.uuid4().hex}"
    _delete_on_exit(spark, path)
    if _open_scratch:
        _open_scratch[-1].append((spark, path))
    return path


#: Input of one partition of :func:`spread`, and the input up to which the
#: number of partitions is left to Spark; beyond MOST_PARTITIONS tasks grow
#: (and spill) instead of getting more.
SPREAD_BYTES, SPREAD_FROM, MOST_PARTITIONS = 4 * 1024 * 1024, 64 * 1024 * 1024, 20_000


def input_bytes(df) -> int:
    """Bytes of the files that ``df`` reads; 0 for a frame without files."""
    sc, total = df.sparkSession.sparkContext, 0
    for f in df.inputFiles():
        where = sc._jvm.org.apache.hadoop.fs.Path(f)
        total += where.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(where).getLen()
    return total


def spread(df, *keys):
    """``df`` dealt by ``keys`` into partitions whose number follows the
    input: one per ``SPREAD_BYTES`` of the files it reads.  A join or an
    aggregate on these keys then needs no exchange of its own, and what one
    of its tasks holds stays the same however large the input is, whatever
    the session's number of shuffle partitions (which AQE only lowers).
    Small frames are returned as they are."""
    size = input_bytes(df)
    if size <= SPREAD_FROM:
        return df
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES))
    return df.repartition(min(n, MOST_PARTITIONS), *keys)


_open_scratch: list[list] = []


@contextmanager
def scratch():
    """Folders that :func:`materialize` writes inside the block go at its end;
    only what was written before or after it may be read then.  Yields a
    function that writes a result which outlives the block."""
    outer = len(_open_scratch)
    _open_scratch.append([])

    def keep(df, label: str = "kept"):
        inner = _open_scratch.pop()
        try:
            return materialize(df, label)
        finally:
            _open_scratch.append(inner)
    try:
        yield keep
    finally:
        for spark, path in _open_scratch.pop():
            delete_folder(spark, path)
        assert len(_open_scratch) == outer


def delete_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate files wherever it lies."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the file system remove ``path`` when the driver ends: nothing
    that is built lazily on it can be read after that."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
