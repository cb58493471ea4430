"""Aggregate expressions with the reference's numeric semantics.

S-rules (see SURVEY 2.14) in one place:

* money stays decimal; sums are widened to ``decimal(38, s)``;
* averages are ``cast(sum as double) / count`` (PostgreSQL keeps at least
  16 digits, so a double is closer than Spark's 6-digit decimal average);
* percent ratios divide as double, round half away from zero to 2 places
  and come back as ``decimal(18,2)``: Spark's wide decimal division keeps
  6 places and would round twice (0.1249996 -> 0.125000 -> 0.13);
* denominators are always guarded with ``nullif`` (ANSI mode raises on 0);
* a NULL flag is neither true nor false: conditional counts give 0 for it.

All of these are ordinary partial-aggregable Spark aggregates, so a hot
group key is combined map-side before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dec_sum(x: Column | str, scale: int = 2) -> Column:
    """``SUM`` of a decimal measure as ``decimal(38, scale)``; NULL on no input."""
    return F.sum(_c(x)).cast(f"decimal(38,{scale})")


def exact_avg(x: Column | str) -> Column:
    """``AVG`` ignoring NULLs: exact decimal (or integer) sum over count, as double."""
    x = _c(x)
    return F.sum(x).cast("double") / F.nullif(F.count(x), F.lit(0))


def merged_avg(total: Column | str, n: Column | str) -> Column:
    """:func:`exact_avg` over groups that were added up before: the sum of
    their sums over the sum of their counts."""
    return F.sum(_c(total)).cast("double") / F.nullif(F.sum(_c(n)), F.lit(0))


def cond_sum(pred: Column, x: Column | str, scale: int = 2) -> Column:
    """``SUM(CASE WHEN pred THEN x ELSE 0 END)``: 0 when nothing matches."""
    return F.sum(F.when(pred, _c(x)).otherwise(F.lit(0))).cast(f"decimal(38,{scale})")


def cond_count(pred: Column) -> Column:
    """``SUM(CASE WHEN pred THEN 1 ELSE 0 END)``: a NULL predicate counts 0."""
    return F.sum(F.when(pred, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def safe_pct(numerator: Column, denominator: Column, places: int = 2) -> Column:
    """``ROUND(100.0 * n / NULLIF(d, 0), places)`` as ``decimal(18, places)``."""
    ratio = (F.lit(100.0) * numerator.cast("double")) / F.nullif(denominator.cast("double"), F.lit(0.0))
    return F.round(ratio, places).cast(f"decimal(18,{places})")


def count_pct(k: Column, n: Column, places: int = 2) -> Column:
    """``ROUND(100.0 * k / NULLIF(n, 0), places)`` for non-negative counts,
    exactly: integer half-up rounding ``(2*10^(p+2)*k + n) div 2n``, so no
    binary fraction or intermediate decimal scale can tip a tie.  Returns
    ``decimal(18, places)``."""
    from decimal import Decimal

    scaled = k.cast("bigint") * F.lit(2 * 10 ** (places + 2)) + n.cast("bigint")
    q = F.call_function("div", scaled, F.nullif(n.cast("bigint") * F.lit(2), F.lit(0)))
    return (q.cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal(18,{places})")


def avg_round(x: Column | str, places: int) -> Column:
    """``ROUND(AVG(x)::numeric, places)``: exact decimal average rounded half
    away from zero, as ``decimal(18, places)``.  Spark divides a decimal sum
    by the count at 26+ digits of scale, so the single rounding to
    ``places`` is exact."""
    x = _c(x)
    return F.round(F.sum(x) / F.nullif(F.count(x), F.lit(0)), places).cast(f"decimal(18,{places})")
