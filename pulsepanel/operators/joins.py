"""Join helpers: validated one-to-one join and period semi-join.

Small sides (one row per period, segment or parameter) are joined plainly:
the optimizer broadcasts them by their size in bytes, and beyond its
threshold shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_one_to_one(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join that fails when a key repeats on either side (``validate='one_to_one'``).

    Both sides are reduced to one row per key by a partial aggregate that also
    counts the key's rows; a count above one raises while the join runs, so
    each side is read once and a hot key is met before the shuffle.
    """
    keys = list(keys)

    def once(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c not in keys]
        got = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("_n"),
            F.first(F.struct(F.lit(1).alias("_one"), *[F.col(c) for c in rest])).alias("_v"))
        said = F.raise_error(F.lit(f"{side} side of a one-to-one join has duplicated keys {keys}"))
        # the check is part of the value, so no column pruning skips it
        value = F.when(F.col("_n") > 1, said.cast(got.schema["_v"].dataType)).otherwise(F.col("_v"))
        return got.select(*keys, value.alias(f"_{side}"))

    joined = once(left, "left").join(once(right, "right"), keys, how)
    return joined.select(*keys, *[F.col(f"_left.{c}").alias(c) for c in left.columns if c not in keys],
                         *[F.col(f"_right.{c}").alias(c) for c in right.columns if c not in keys])


def semi_join_periods(df: DataFrame, periods_df: DataFrame, period: str = "safra") -> DataFrame:
    """Rows whose period appears in ``periods_df`` (LEFT SEMI)."""
    return df.join(periods_df.select(period).distinct(), [period], "left_semi")
