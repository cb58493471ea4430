"""ledgermart: a Spark-native analytics library for a bank's star schema.

Everything is lazy DataFrame composition: functions take DataFrames (or a
mapping of named frames) and return DataFrames; the caller decides on the
action.  Catalyst plans the joins and aggregates, executors do the work.

Sub-packages
------------
sources    declared schemas, typed loading, defaults, partitioned writes,
           and the bank-shaped views over the driver's test tables
functions  column expressions: percent ratios, exact averages, buckets
operators  joins (current / as-of / bridge), data quality, history (SCD),
           derivations (date dimension, balances, roll-forward, masking)
plans      the five marts and the governance queries built on top
streaming  incremental maintenance of the accumulating alert snapshot
"""

from ledgermart.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
