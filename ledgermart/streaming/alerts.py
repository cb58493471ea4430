"""Incremental maintenance of the accumulating alert snapshot (H5 on a stream).

The alert fact is an accumulating snapshot: one row per alert, rewritten
as its milestones (assigned, reviewed, escalated, closed, SAR filed)
arrive.  Two Structured Streaming forms:

* :func:`milestone_state` - a stateful streaming aggregation: per alert
  the earliest day of each milestone, kept in the checkpointed state
  store and emitted in ``update`` mode whenever an alert changes;
* :func:`maintain_snapshot` - ``foreachBatch`` that merges every
  micro-batch into the snapshot with the batch operator
  :func:`ledgermart.operators.history.accumulate_alerts` and writes a new
  snapshot version, then switches the pointer.  The merge keeps the
  earliest date per milestone, so a micro-batch replayed after a failure
  (at-least-once delivery into ``foreachBatch``) leaves the same result.

Both survive executor loss: the stream's progress and state live in the
checkpoint location, which must be on the shared file system.

With ``buckets`` the snapshot is stored in hash buckets of the alert id and
each micro-batch rewrites only the buckets its alerts fall in (dynamic
partition overwrite), so the cost of a batch follows the batch, not the
size of the snapshot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgermart.operators.history import MILESTONES, accumulate_alerts, derive_alert_measures
from ledgermart.sources import pointer

EVENT_SCHEMA = "alert_id bigint, milestone string, milestone_ts timestamp_ntz"


def milestone_state(events: DataFrame) -> DataFrame:
    """Streaming per-alert milestone minima and derived measures (run with
    ``outputMode("update")``)."""
    day = F.to_date("milestone_ts")
    agg = events.groupBy("alert_id").agg(*[
        F.min(F.when(F.col("milestone") == m, day)).alias(f"{m}_date") for m in MILESTONES])
    return derive_alert_measures(agg)


def current_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """The snapshot version the pointer names, or None before the first
    batch.  A pointer that is lost while versions are there is an error, not
    a first batch: merging without them would replace history."""
    version = pointer.current(spark, root)
    if version is None:
        if any(name.startswith("v") for name in pointer.folders(spark, root)):
            raise RuntimeError(f"{root} holds snapshot versions but no complete pointer")
        return None
    return spark.read.parquet(f"{root}/{version}")


def merge_batch(batch: DataFrame, batch_id: int, root: str) -> None:
    """Merge one micro-batch of milestone events into the snapshot at ``root``."""
    spark = batch.sparkSession
    existing = current_snapshot(spark, root)
    merged = accumulate_alerts(existing, batch)
    version = f"v{batch_id:010d}-{uuid.uuid4().hex[:8]}"  # a replayed batch never rewrites what it reads
    if existing is None:  # not a version until it is published: a crash before that leaves a first batch
        version = f"first-{version}"
    merged.write.parquet(f"{root}/{version}")
    pointer.publish(spark, root, version)
    pointer.drop_older(spark, root)


def _bucket(n: int):
    return F.pmod(F.xxhash64("alert_id"), F.lit(n)).cast("int")


def read_bucketed_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    if not pointer.exists(spark, root):  # nothing written yet
        return None
    return spark.read.parquet(root).drop("alert_bucket")


def merge_batch_bucketed(batch: DataFrame, batch_id: int, root: str, buckets: int) -> None:
    """Merge one micro-batch, rewriting only the hash buckets it touches."""
    from ledgermart.session import materialize

    spark = batch.sparkSession
    touched = [r[0] for r in batch.select(_bucket(buckets)).distinct().collect()]   # at most ``buckets`` values
    if not touched:
        return
    existing = None
    if pointer.exists(spark, root):  # any failure to read what is there stops the batch
        existing = spark.read.parquet(root).filter(F.col("alert_bucket").isin(touched)).drop("alert_bucket")
    merged = accumulate_alerts(existing, batch).withColumn("alert_bucket", _bucket(buckets))
    # cut the lineage to the files about to be replaced, then overwrite just those buckets
    staged = materialize(merged, f"alerts-{batch_id}")
    (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("alert_bucket").parquet(root))


def maintain_snapshot(events: DataFrame, root: str, checkpoint: str, available_now: bool = False,
                      processing_time: str | None = None, buckets: int | None = None) -> StreamingQuery:
    """Start the stream that keeps ``root`` equal to the batch snapshot of
    all events seen so far (versioned folders, or hash buckets rewritten in
    place with ``buckets``)."""
    if buckets:
        fn = lambda df, i: merge_batch_bucketed(df, i, root, buckets)
    else:
        fn = lambda df, i: merge_batch(df, i, root)
    w = events.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
