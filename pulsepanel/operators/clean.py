"""Key normalisation, duplicate detection and deterministic de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalize_keys(df: DataFrame, key: str = "msno", period: str = "safra") -> tuple[DataFrame, DataFrame]:
    """(clean rows, rejected rows): key -> string, period -> int.

    A period that does not parse is not an error that stops the job: such
    rows go to the rejected side with a reason, the rest continue.
    """
    # Through double: a float period (201601.0) is what a column with a gap
    # becomes; a fraction is not a period.
    number = F.col(period).cast("string").try_cast("double")
    p = F.when(number == F.floor(number), number.try_cast("int"))
    x = df.withColumn("_p", p)
    bad = F.col("_p").isNull() | F.col(key).isNull()
    good = (x.where(~bad)
            .withColumn(key, F.col(key).cast("string"))
            .withColumn(period, F.col("_p")).drop("_p"))
    rejected = (x.where(bad).drop("_p")
                .withColumn("_reason", F.when(F.col(key).isNull(), "null key")
                            .otherwise("unparsable period")))
    return good, rejected


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with their multiplicity (partial agg)."""
    keys = list(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))


def dedup(df: DataFrame, keys, order_cols, keep: str = "last", cols=None) -> DataFrame:
    """One row per key: the last (or first) in ``order_cols`` order.

    ``max_by``/``min_by`` over a struct of the kept columns is a partial
    aggregate, so a key holding a third of all rows is reduced map-side
    instead of being ranked in one window task.  ``order_cols`` must make
    the order total for the result to be deterministic.  ``cols`` lists the
    output columns besides the keys (default: all): Catalyst does not prune
    fields of a struct built inside an aggregate, so name only what is
    needed to keep the scan and the shuffle narrow.
    """
    keys = list(keys)
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    rest = [c for c in (cols if cols is not None else df.columns) if c not in keys]
    final = keys + rest if cols is not None else df.columns
    df = df.select(*dict.fromkeys(keys + rest + order_cols))
    payload = F.struct(*[F.col(c) for c in rest])
    ordering = F.struct(*[F.col(c) for c in order_cols])
    pick = F.max_by if keep == "last" else F.min_by
    out = df.groupBy(*keys).agg(pick(payload, ordering).alias("_row"))
    out = out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return out.select(*final)


def assert_unique(df: DataFrame, keys, what: str = "table") -> None:
    """Raise if ``keys`` repeat (one aggregate, stops at the first duplicate)."""
    if duplicate_keys(df, keys).limit(1).count():
        raise ValueError(f"{what}: key {list(keys)} is not unique")
