"""Forward churn labels and the per-period label-trust verdict.

``forward_status`` reads the status at period+h with a RANGE frame over the
same (key, period-index) window as :func:`lag_diff`, so lag features and the
label come out of one Window operator with one sort.  The per-period
diagnosis is a single ``groupBy(period)`` with conditional aggregates
(partial aggregation, #periods output rows) and is joined back by period.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsepanel.functions.periods import period_index

# Fixed values that must equal the reference: a month is not trusted when the
# future-active rate is below 1 % or the churn rate above 95 %.
MIN_FUTURE_ACTIVE_RATE = 0.01
MAX_CHURN_RATE = 0.95


def trust_from_rates(far, cr, observed=None, eligible=None) -> F.Column:
    """1 when the period's label can be trusted, else 0.

    ``far`` / ``cr``: future-active and churn rates (columns or names);
    ``observed`` / ``eligible``: optional row counts - a period with none of
    either is never trusted.
    """
    far = F.col(far) if isinstance(far, str) else far
    cr = F.col(cr) if isinstance(cr, str) else cr
    empty = F.lit(False)
    for c in (observed, eligible):
        if c is not None:
            empty = empty | ((F.col(c) if isinstance(c, str) else c) == 0)
    return (F.when(empty, 0)
            .when((far < MIN_FUTURE_ACTIVE_RATE) | (cr > MAX_CHURN_RATE), 0).otherwise(1))


def forward_status(panel: DataFrame, key: str = "msno", period: str = "safra",
                   status: str = "is_ativo", horizon: int = 3, idx: str | None = None,
                   out: str | None = None) -> DataFrame:
    """Add ``<status>`` (NULL -> 0) and ``<status>_fut``: status at period+h.

    ``_fut`` is NULL when the key has no row at period+h (future not
    observed) and 0/1 otherwise - a NULL status counts as inactive both now
    and in the future.
    """
    out = out or f"{status}_fut"
    drop_idx = idx is None
    if idx is None:
        idx = "_pidx"
        panel = panel.withColumn(idx, period_index(period))
    now = F.coalesce(F.col(status).cast("int"), F.lit(0))
    w = Window.partitionBy(key).orderBy(F.col(idx)).rangeBetween(horizon, horizon)
    res = (panel.withColumn(status, now)
           .withColumn(out, F.first(F.col(status)).over(w)))
    return res.drop(idx) if drop_idx else res


def churn_label(panel: DataFrame, key: str = "msno", period: str = "safra",
                status: str = "is_ativo", horizon: int = 3, label: str = "churn_3m",
                idx: str | None = None) -> DataFrame:
    """Rows with an observed future and ``label = now==1 AND future==0``.

    Customers inactive now get 0 (not NULL); eligibility is a later filter.
    """
    return label_rows(forward_status(panel, key, period, status, horizon, idx), status, label)


def label_rows(status_panel: DataFrame, status: str = "is_ativo", label: str = "churn_3m") -> DataFrame:
    """Label of the rows of :func:`forward_status` with an observed future."""
    fut = F.col(f"{status}_fut")
    return (status_panel.where(fut.isNotNull())
            .withColumn(label, ((F.col(status) == 1) & (fut == 0)).cast("int")))


def period_counts(status_panel: DataFrame, period: str = "safra", status: str = "is_ativo",
                  idx: str | None = None, fut: str | None = None) -> DataFrame:
    """Counts of each period that its verdict rests on: ``_idx``, rows with an
    observed future, eligible ones, the sum of future status, and churners.

    Input: output of :func:`forward_status`.  The counts of one period do not
    depend on other periods, so a refresh replaces only those that changed.
    """
    fut = fut or f"{status}_fut"
    pidx = F.col(idx) if idx else period_index(period)
    observed = F.col(fut).isNotNull()
    eligible = observed & (F.col(status) == 1)
    return status_panel.groupBy(F.col(period).cast("int").alias(period)).agg(
        F.max(pidx).alias("_idx"),
        F.count(F.when(observed, 1)).alias("_obs"),
        F.count(F.when(eligible, 1)).alias("_elig"),
        F.sum(F.when(observed, F.col(fut))).alias("_fut_sum"),
        F.count(F.when(eligible & (F.col(fut) == 0), 1)).alias("_churn"),
    )


def verdicts(counts: DataFrame, period: str = "safra", horizon: int = 3) -> DataFrame:
    """Per-period diagnosis from :func:`period_counts` of all periods."""
    # #periods rows: a window over the whole (tiny) aggregate is bounded.
    last = F.max("_idx").over(Window.partitionBy())
    g = counts.withColumn("_last", last).where(F.col("_idx") + horizon <= F.col("_last"))
    far = F.when(F.col("_obs") > 0, F.col("_fut_sum").cast("double") / F.col("_obs")).otherwise(0.0)
    cr = F.when(F.col("_elig") > 0, F.col("_churn").cast("double") / F.col("_elig")).otherwise(0.0)
    rows = (F.when(F.col("_obs") == 0, F.lit(0))
            .when(F.col("_elig") == 0, F.col("_obs")).otherwise(F.col("_elig")))
    trust = trust_from_rates(far, cr, "_obs", "_elig")
    return g.select(period, rows.cast("bigint").alias("rows"), far.alias("fut_active_rate"),
                    cr.alias("churn_rate"), trust.cast("int").alias("label_trust"))


def label_trust(status_panel: DataFrame, period: str = "safra", status: str = "is_ativo",
                horizon: int = 3, idx: str | None = None,
                fut: str | None = None) -> DataFrame:
    """Per-period diagnosis: rows, fut_active_rate, churn_rate, label_trust.

    Input: output of :func:`forward_status`.  Periods whose period+h lies
    beyond the last period are absent; periods inside the range with no
    observed future give a zero row.  ``rows`` is 0 / #observed / #eligible
    by branch; ``fut_active_rate`` is over all observed rows, ``churn_rate``
    over eligible rows.
    """
    return verdicts(period_counts(status_panel, period, status, idx, fut), period, horizon)


def attach_trust(rows: DataFrame, diag: DataFrame, period: str = "safra") -> DataFrame:
    """Month verdict onto rows; a month without diagnosis gets trust 0, rates NULL."""
    d = diag.select(period, F.col("label_trust").alias("_lt"),
                    "fut_active_rate", F.col("churn_rate").alias("churn_rate_month"))
    out = rows.join(d, [period], "left")
    return (out.withColumn("label_trust", F.coalesce(F.col("_lt"), F.lit(0)).cast("int"))
            .drop("_lt"))


def model_table(panel: DataFrame, lag_cols, key: str = "msno", period: str = "safra",
                status: str = "is_ativo", horizon: int = 3, label: str = "churn_3m",
                lag: int = 1, reuse: bool = True) -> DataFrame:
    """features + lag/diff + forward label + month verdict, observed rows only.

    One Window operator computes the lags and the future status.  Rows whose
    future is observed automatically satisfy period+h <= last period.  The
    windowed panel feeds both the per-period diagnosis and the rows; with
    ``reuse`` it is written once as a table under the shared checkpoint
    folder, so the raw tables are scanned and shuffled a single time and the
    lineage is cut.
    """
    from pulsepanel.operators.panel import lag_diff

    idx = "_pidx"
    x = panel.withColumn(idx, period_index(period))
    x = lag_diff(x, lag_cols, key, period, idx=idx, lag=lag)
    x = forward_status(x, key, period, status, horizon, idx=idx)
    if reuse:
        from pulsepanel.sources.sinks import materialize
        x = materialize(x, "windowed_panel")
    diag = label_trust(x, period, status, horizon, idx=idx)
    return attach_trust(label_rows(x, status, label).drop(idx), diag, period)


def eligible_trusted(model: DataFrame, status: str = "is_ativo",
                     trust: str = "label_trust") -> DataFrame:
    """``is_ativo = 1 AND label_trust = 1`` (NULL counts as 0)."""
    return model.where((F.coalesce(F.col(status), F.lit(0)) == 1)
                       & (F.coalesce(F.col(trust), F.lit(0)) == 1))
