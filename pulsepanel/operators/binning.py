"""Binning: robust quantile bins, fixed-edge bins, equal-width histogram,
target rate per bin.

Bin edges are a handful of driver-side numbers computed from exact
distributed quantiles; assigning a bin is then a right-closed ``CASE`` chain
(pandas ``cut``/``qcut`` semantics - ``ml.Bucketizer`` is left-closed).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsepanel.operators.rank import quantile_positions, quantiles_from_prefix, value_prefix

# Fixed value that must equal the reference: the label of a single bin.
SINGLE_BIN_LABEL = "Faixa única"


def bin_label(ordinal: Column, n_bins: int) -> Column:
    """``Q<ordinal>``, the first bin marked as smallest, the last as largest."""
    mark = F.when(ordinal == 1, "(menor)").when(ordinal == n_bins, "(maior)").otherwise("")
    return F.concat(F.lit("Q"), ordinal.cast("string"), mark)


def quantile_edges(df: DataFrame, value: str, q: int = 5, fill=None) -> list[float]:
    """Distinct edges of ``qcut(x, q_eff, duplicates='drop')``, q_eff = min(q, nunique).

    The column is written once; the passes over it read that table."""
    from pulsepanel.sources.sinks import materialize

    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    if fill is not None:
        v = F.coalesce(v, F.lit(float(fill)))
    x = materialize(df.select(v.alias("v")).where(F.col("v").isNotNull()), "bin_input")
    q_eff = min(q, x.distinct().limit(q).count())
    if q_eff == 0:
        return []
    probs = [i / q_eff for i in range(q_eff + 1)]
    qs = quantiles_from_prefix(value_prefix(x, "v", positions=quantile_positions(probs)), probs)
    return sorted({qs[p] for p in probs})


def quantile_bin_expr(c, edges: list[float]) -> Column:
    """Right-closed bins over ``edges``, the lowest edge included."""
    v = F.col(c) if isinstance(c, str) else c
    n_bins = len(edges) - 1
    if n_bins <= 1:
        return F.lit(SINGLE_BIN_LABEL)
    ordinal = F.lit(1) + reduce(add, [(v > F.lit(e)).cast("int") for e in edges[1:-1]])
    return F.when(v.isNotNull(), bin_label(ordinal, n_bins))


def quantile_bins(df: DataFrame, value: str, q: int = 5, fill=None, out: str | None = None) -> DataFrame:
    """``safe_qcut``: robust quantile bins; a single bin is labelled ``Faixa única``."""
    out = out or f"{value}_bin"
    edges = quantile_edges(df, value, q, fill)
    src = F.coalesce(F.col(value).cast("double"), F.lit(float(fill))) if fill is not None else F.col(value)
    if len(edges) == 0:
        return df.withColumn(out, F.lit(SINGLE_BIN_LABEL))
    return df.withColumn(out, quantile_bin_expr(src, edges))


def rate_by_bin(df: DataFrame, bin_col: str, target: str) -> DataFrame:
    """Target mean and count per observed (non-NULL) bin."""
    return (df.where(F.col(bin_col).isNotNull()).groupBy(bin_col)
            .agg(F.avg(F.col(target).cast("double")).alias("churn_rate"),
                 F.count(F.lit(1)).alias("n")))


def equal_width_histogram(df: DataFrame, value: str, bins: int = 40, lo=None, hi=None) -> DataFrame:
    """numpy-style histogram: ``bins`` equal-width bins over [min, max]; the
    last bin is closed.  Only non-empty bins are returned."""
    x = df.where(F.col(value).isNotNull())
    if lo is not None:
        x = x.where(F.col(value) >= lo)
    if hi is not None:
        x = x.where(F.col(value) <= hi)
    mm = x.agg(F.min(value).alias("mn"), F.max(value).alias("mx")).first()
    if mm["mn"] is None:
        return x.sparkSession.createDataFrame(
            [], "bin int, bin_lo double, bin_hi double, n bigint")
    mn, mx = float(mm["mn"]), float(mm["mx"])
    if mx == mn:
        mn, mx = mn - 0.5, mx + 0.5
    width = (mx - mn) / bins
    v = F.col(value).cast("double")
    idx = F.least(F.floor((v - F.lit(mn)) * F.lit(bins) / F.lit(mx - mn)), F.lit(bins - 1)).cast("int")
    return (x.groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin", (F.lit(mn) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                    (F.lit(mn) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "n"))
