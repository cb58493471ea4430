"""Integer date keys (``YYYYMMDD``), the join and partition key of every fact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(d: Column) -> Column:
    """``year*10000 + month*100 + day`` as int, from a date or timestamp."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def key_to_date(k: Column) -> Column:
    """Inverse of :func:`date_key`; NULL for a key that is not a calendar day."""
    return F.try_to_date(k.cast("string"), "yyyyMMdd")


def key_year(k: Column) -> Column:
    """Year of a date key by integer division (no parsing)."""
    return F.floor(k / F.lit(10000)).cast("int")
