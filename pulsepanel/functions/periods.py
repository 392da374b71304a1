"""Calendar arithmetic on integer ``YYYYMM`` periods.

A period index ``idx = year*12 + month - 1`` turns calendar months into
consecutive integers, so "previous month" and "three months later" become
``idx - 1`` and ``idx + 3`` and window frames can use value-based RANGE
offsets.  All helpers return ``Column`` expressions (JVM-side, codegen).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def period_index(period) -> Column:
    """YYYYMM -> months since year 0 (int)."""
    p = _col(period).cast("int")
    return (F.floor(p / 100) * 12 + p % 100 - 1).cast("int")


def period_from_index(idx) -> Column:
    """Inverse of :func:`period_index`."""
    i = _col(idx).cast("int")
    return (F.floor(i / 12) * 100 + F.pmod(i, F.lit(12)) + 1).cast("int")


def add_periods(period, n: int) -> Column:
    """YYYYMM + n months with year carry (201611 + 3 -> 201702)."""
    return period_from_index(period_index(period) + F.lit(int(n)))


def period_of_timestamp(ts) -> Column:
    """Timestamp/date -> YYYYMM int."""
    t = _col(ts)
    return (F.year(t) * 100 + F.month(t)).cast("int")


def index_of_timestamp(ts) -> Column:
    """Timestamp/date -> month index (year*12 + month - 1)."""
    t = _col(ts)
    return (F.year(t) * 12 + F.month(t) - 1).cast("int")


def day_index(ts) -> Column:
    """Timestamp/date -> days since 1970-01-01 (a daily period index)."""
    return F.datediff(F.to_date(_col(ts)), F.lit("1970-01-01").cast("date")).cast("int")
