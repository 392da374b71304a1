"""Scans with tolerant column subsets and pushed-down period predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, columns=None, defaults: dict | None = None,
               where=None) -> DataFrame:
    """Parquet scan of ``wanted ∩ existing`` columns.

    Missing wanted columns are added as typed literals from ``defaults`` (or
    dropped when no default is given).  Selection and ``where`` are declared
    lazily so Catalyst prunes the ReadSchema and pushes the filter into the
    Parquet reader; splitting into tasks is Spark's.
    """
    df = spark.read.parquet(path)
    if where is not None:
        df = df.where(where)
    if columns is None:
        return df
    return ensure_columns(df, columns, defaults or {})


def ensure_columns(df: DataFrame, columns, defaults: dict) -> DataFrame:
    existing = set(df.columns)
    out = []
    for c in columns:
        if c in existing:
            out.append(F.col(c))
        elif c in defaults:
            out.append(F.lit(defaults[c]).alias(c))
    return df.select(*out)


def require_columns(df: DataFrame, columns, what: str = "input") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns {missing}")


def require_rows(df: DataFrame, what: str = "input") -> None:
    """Raise if there is no row (stops at the first one)."""
    if df.isEmpty():
        raise ValueError(f"{what} has no rows")


def scan_month_filter(df: DataFrame, period_col: str, periods, columns=None) -> DataFrame:
    """``to_table(columns, filter=field==m)`` → select + isin, pushed to the scan."""
    if isinstance(periods, (int, str)):
        periods = [periods]
    cond = F.col(period_col).isin([int(p) for p in periods])
    out = df.where(cond)
    return out.select(*columns) if columns else out


def period_list(df: DataFrame, period_col: str) -> DataFrame:
    """Distinct non-NULL periods (one row per month)."""
    return df.select(period_col).where(F.col(period_col).isNotNull()).distinct()


def timestamp_period_filter(ts_col: str, periods):
    """Predicate ``ts`` in the given YYYYMM months as half-open timestamp ranges.

    Unlike ``year*100+month IN (...)`` this form is pushed into the Parquet
    reader (row-group min/max pruning).
    """
    cond = None
    for p in sorted({int(p) for p in periods}):
        y, m = divmod(p, 100)
        ny, nm = (y + 1, 1) if m == 12 else (y, m + 1)
        lo = F.lit(f"{y:04d}-{m:02d}-01 00:00:00").cast("timestamp_ntz")
        hi = F.lit(f"{ny:04d}-{nm:02d}-01 00:00:00").cast("timestamp_ntz")
        c = (F.col(ts_col) >= lo) & (F.col(ts_col) < hi)
        cond = c if cond is None else (cond | c)
    return cond
