"""A pointer to the current version of a stored table set.

Each publication is a new, never rewritten folder ``<root>/_current/<n>``
with one JSON row; the current one is the complete folder (it has Spark's
``_SUCCESS`` mark) with the greatest name.  A crash while publishing leaves
the previous pointer in force, and there is no moment without one.  Only a
missing folder means "nothing published yet"; every other failure to read
is raised.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` is there, on whatever file system it names."""
    p, fs = _path(spark, path)
    return fs.exists(p)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in ``path``, sorted; none if it is missing."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def _complete(spark: SparkSession, root: str) -> list[str]:
    return [n for n in folders(spark, f"{root}/_current") if exists(spark, f"{root}/_current/{n}/_SUCCESS")]


def publish(spark: SparkSession, root: str, version: str) -> None:
    """Make ``version`` (a folder name under ``root``) the current one."""
    done = folders(spark, f"{root}/_current")
    n = int(done[-1]) + 1 if done else 0
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.json(f"{root}/_current/{n:012d}")


def current(spark: SparkSession, root: str) -> str | None:
    """The current version, or None if nothing was ever published."""
    done = _complete(spark, root)
    if not done:
        return None
    return spark.read.schema("version string").json(f"{root}/_current/{done[-1]}").first()["version"]


def drop_older(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Delete all but the newest ``keep`` published versions and pointers
    (readers of the previous version can finish)."""
    done = _complete(spark, root)
    versions = {n: spark.read.schema("version string").json(f"{root}/_current/{n}").first()["version"] for n in done[-keep - 2:]}
    kept = {versions[n] for n in done[-keep:]}
    for n in done[:-keep]:
        if n in versions and versions[n] not in kept:
            delete(spark, f"{root}/{versions[n]}")
        delete(spark, f"{root}/_current/{n}")
