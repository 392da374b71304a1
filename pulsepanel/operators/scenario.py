"""Retention-campaign economics: ARPU, expected net per policy, sensitivity
grid, best policy per (free months, acceptance rate).

The grid is generated by exploding literal parameter arrays onto the
campaign curve (5 rows), so no join is involved; the best policy is a
``row_number() = 1`` per group, which Spark plans as a WindowGroupLimit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.sources.tables import require_columns

# Fixed values that must equal the reference's sensitivity analysis.
TOP_FRACS = [0.01, 0.03, 0.05, 0.10, 0.20]
FREE_MONTHS = [1, 2, 3]
ACCEPT_RATES = [0.3, 0.5, 0.7]
RETENTION_MONTHS = 12


def arpu(model: DataFrame, periods_df: DataFrame | None = None, paid: str = "paid_sum",
         period: str = "safra") -> DataFrame:
    """Mean paid amount over rows with paid > 0 (in the given periods); one row."""
    from pulsepanel.operators.joins import semi_join_periods

    require_columns(model, [paid, *([] if periods_df is None else [period])], "model table")
    x = model if periods_df is None else semi_join_periods(model, periods_df, period)
    p = F.coalesce(F.col(paid).cast("double"), F.lit(0.0))
    return x.where(p > 0).agg(F.avg(p).alias("ARPU_NTD"), F.count(F.lit(1)).alias("n_paying"))


def expected_net_cols(arpu_col="ARPU_NTD", tp="TP", fp="FP", free="free_months",
                      accept="accept_rate") -> dict:
    """gain = accept·TP·max(0, 12 - free)·ARPU; cost = FP·free·ARPU; net = gain - cost."""
    paid_months = F.greatest(F.lit(0), F.lit(RETENTION_MONTHS) - F.col(free))
    gain = F.col(accept) * F.col(tp) * paid_months * F.col(arpu_col)
    cost = F.col(fp) * F.col(free) * F.col(arpu_col)
    return {"expected_gain_NTD": gain, "expected_cost_NTD": cost,
            "expected_net_NTD": gain - cost}


def scenario_grid(curve: DataFrame, arpu_value: float, base_rate: float | None,
                  free_months=FREE_MONTHS, accept_rates=ACCEPT_RATES) -> DataFrame:
    """free × accept × fraction rows with precision, lift, gain, cost, net.

    ``curve`` has top_frac, k, TP, FP (one row per fraction).  Without a
    paying customer there is no ARPU, which is an error.
    """
    require_columns(curve, ["top_frac", "k", "TP", "FP"], "campaign curve")
    if arpu_value is None:
        raise ValueError("no paying customer: ARPU is not defined")
    free = F.explode(F.array(*[F.lit(int(m)) for m in free_months])).alias("free_months")
    acc = F.array(*[F.lit(float(a)) for a in accept_rates])
    g = (curve.select("top_frac", "k", "TP", "FP", free)
         .select("*", F.explode(acc).alias("accept_rate")))
    base = F.lit(base_rate).cast("double")
    prec = F.when(F.col("k") > 0, F.col("TP") / F.col("k")).otherwise(0.0)
    g = g.select("*", F.lit(float(arpu_value)).alias("ARPU_NTD"),
                 base.alias("base_churn_rate_test"), prec.alias("precision_at_k"))
    lift = F.when(F.col("base_churn_rate_test") > 0,
                  F.col("precision_at_k") / F.col("base_churn_rate_test"))
    money = expected_net_cols()
    return g.select("free_months", "accept_rate", "top_frac", "k", "TP", "FP", "precision_at_k",
                    "base_churn_rate_test", lift.alias("lift"), "ARPU_NTD",
                    *[e.alias(n) for n, e in money.items()])


def best_policy(grid: DataFrame) -> DataFrame:
    """Highest expected net per (free_months, accept_rate); ties -> smaller fraction.

    Nets are compared at cent precision: policies whose nets are equal in
    exact arithmetic can differ in the last float bits, and that noise must
    not pick the winner.
    """
    w = Window.partitionBy("free_months", "accept_rate").orderBy(
        F.round(F.col("expected_net_NTD"), 2).desc(), F.col("top_frac").asc())
    return grid.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")
