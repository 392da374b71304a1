"""Panel construction: raw tables -> one row per (key, period).

Plan shape at scale: each raw table is scanned with only the needed columns,
partially aggregated map-side (HashAggregate partial), shuffled once on
(key, period) and finally aggregated.  The three monthly tables share that
hash partitioning, so the LEFT joins on (key, period) are shuffle-free
sort-merge joins.  A customer hot key is harmless here: partial aggregation
collapses its rows before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.functions.periods import period_index
from pulsepanel.functions.scalar import (
    coerce_numeric, null_out_of_range, positive_flag, safe_ratio,
)

# Fixed values that must equal the reference: play-completion buckets and the
# weight of each bucket in the completion rate.
PLAY_BUCKETS = ["num_25", "num_50", "num_75", "num_985", "num_100"]
COMPLETION_WEIGHTS = {"num_25": 0.25, "num_50": 0.50, "num_75": 0.75,
                      "num_985": 0.985, "num_100": 1.0}
USAGE_MEASURES = PLAY_BUCKETS + ["num_unq", "total_secs"]
PAYMENT_MEASURES = ["actual_amount_paid", "plan_list_price", "payment_plan_days",
                    "is_auto_renew", "is_cancel"]
MEMBER_ATTRS = ["city", "bd", "gender", "registered_via"]
# The eight base columns that get lag/diff features.
LAG_BASE_COLS = ["total_secs", "num_unq", "paid_sum", "plays_total",
                 "has_usage", "has_payment", "auto_renew_rate", "cancel_txn_count"]


def _keyed(df: DataFrame, key: str, period: str) -> DataFrame:
    # pandas groupby drops NULL keys; Spark would keep a NULL group.
    return df.where(F.col(key).isNotNull() & F.col(period).isNotNull())


def _filled(df: DataFrame, measures) -> dict:
    """Coerced, zero-filled measure columns (absent column -> constant 0)."""
    out = {}
    for c in measures:
        if c in df.columns:
            out[c] = F.coalesce(coerce_numeric(F.col(c)), F.lit(0.0))
        else:
            out[c] = F.lit(0.0)
    return out


def usage_monthly(logs: DataFrame, key: str = "msno", period: str = "safra") -> DataFrame:
    """Σ of usage measures per (key, period) + completion rate and secs/play.

    completion_rate = Σ(w·bucket) / Σ plays, secs_per_play = Σ secs / Σ plays,
    both NULL unless Σ plays > 0.
    """
    m = _filled(logs, USAGE_MEASURES)
    plays = m["num_25"] + m["num_50"] + m["num_75"] + m["num_985"] + m["num_100"]
    completion = sum((F.lit(w) * m[c] for c, w in COMPLETION_WEIGHTS.items()), F.lit(0.0))
    base = _keyed(logs, key, period).select(
        F.col(key), F.col(period).cast("int").alias(period),
        *[m[c].alias(c) for c in USAGE_MEASURES],
        plays.alias("plays_total"), completion.alias("_completion_num"))
    g = base.groupBy(key, period).agg(
        F.sum("num_unq").alias("num_unq"),
        F.sum("total_secs").alias("total_secs"),
        F.sum("plays_total").alias("plays_total"),
        *[F.sum(c).alias(c) for c in PLAY_BUCKETS],
        F.sum("_completion_num").alias("_completion_num"),
    )
    return g.select(
        key, period, "num_unq", "total_secs", "plays_total", *PLAY_BUCKETS,
        safe_ratio("_completion_num", "plays_total").alias("completion_rate"),
        safe_ratio("total_secs", "plays_total").alias("secs_per_play"))


def payments_monthly(txn: DataFrame, key: str = "msno", period: str = "safra") -> DataFrame:
    """paid_sum, cancel_txn_count and zero-filled means per (key, period).

    NULL list price / plan days / auto-renew are set to 0 *before* averaging,
    so the means divide by all rows (not ``avg`` over non-NULL values).
    """
    m = _filled(txn, PAYMENT_MEASURES)
    base = _keyed(txn, key, period).select(
        F.col(key), F.col(period).cast("int").alias(period),
        *[m[c].alias(c) for c in PAYMENT_MEASURES])
    return base.groupBy(key, period).agg(
        F.sum("actual_amount_paid").alias("paid_sum"),
        F.sum("is_cancel").alias("cancel_txn_count"),
        F.avg("plan_list_price").alias("plan_price_mean"),
        F.avg("payment_plan_days").alias("plan_days_mean"),
        F.avg("is_auto_renew").alias("auto_renew_rate"),
    )


def members_monthly(members: DataFrame, key: str = "msno", period: str = "safra",
                    order_col: str = "_ord", attrs=None, status: str = "is_ativo",
                    age_col: str = "bd", age_range=(10, 90)) -> DataFrame:
    """First non-NULL attribute (by ``order_col``) and max status per (key, period).

    ``first`` in file order is made deterministic with an explicit order
    column; ``min_by`` over non-NULL values is a partial aggregate, so a hot
    key never gathers its rows in one task.
    """
    attrs = [a for a in (attrs or MEMBER_ATTRS) if a in members.columns]
    cols = {}
    for a in attrs:
        v = F.col(a)
        if a == age_col:
            v = null_out_of_range(coerce_numeric(v), *age_range)
        cols[a] = v
    base = _keyed(members, key, period).select(
        F.col(key), F.col(period).cast("int").alias(period), F.col(order_col).alias("_o"),
        *[v.alias(a) for a, v in cols.items()],
        *([coerce_numeric(F.col(status)).alias(status)] if status in members.columns else []))
    aggs = [F.min_by(F.col(a), F.when(F.col(a).isNotNull(), F.col("_o"))).alias(a)
            for a in attrs]
    if status in members.columns:
        aggs.append(F.max(status).alias(status))
    return base.groupBy(key, period).agg(*aggs)


def feature_join(base: DataFrame, others, keys=("msno", "safra"),
                 paid_col: str = "paid_sum", usage_col: str = "total_secs") -> DataFrame:
    """base ⟕ other₁ ⟕ other₂ … on the panel key, plus activity flags.

    The population is born from ``base`` (the usage table by default); pass
    a members-derived spine as ``base`` to keep customers without usage.
    """
    out = base
    for o in others:
        out = out.join(o, list(keys), "left")
    if paid_col in out.columns:
        out = out.withColumn("has_payment", positive_flag(paid_col))
    if usage_col in out.columns:
        out = out.withColumn("has_usage", positive_flag(usage_col))
    return out


def panel_window(key: str, idx: str) -> Window:
    return Window.partitionBy(key).orderBy(F.col(idx))


def lag_diff(panel: DataFrame, cols, key: str = "msno", period: str = "safra",
             idx: str | None = None, lag: int = 1) -> DataFrame:
    """``c_lag1`` / ``c_diff1`` for each column, calendar-consecutive only.

    The lag is the value at exactly ``idx - lag`` for the same key (a RANGE
    frame on the period index), NULL when that month is absent - not simply
    the previous row.  The panel is unique per (key, period), so one key
    holds at most #periods rows: partitioning the window by key cannot skew.
    All columns share one Window operator (one sort).
    """
    drop_idx = idx is None
    if idx is None:
        idx = "_pidx"
        panel = panel.withColumn(idx, period_index(period))
    w = panel_window(key, idx).rangeBetween(-lag, -lag)
    present = [c for c in cols if c in panel.columns]
    lags = {c: F.first(F.col(c)).over(w).cast("double") for c in present}
    out = panel.select("*", *[lags[c].alias(f"{c}_lag{lag}") for c in present])
    out = out.select("*", *[(F.col(c) - F.col(f"{c}_lag{lag}")).alias(f"{c}_diff{lag}")
                            for c in present])
    return out.drop(idx) if drop_idx else out
