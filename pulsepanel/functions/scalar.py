"""Row-level expressions: coercion, guards, flags, fixed-edge bins.

Everything here is a plain ``Column`` so it stays inside whole-stage codegen.
NULL is the only missing marker: NaN is normalised to NULL on ingestion and
ratios with a non-positive denominator are NULL, never NaN or infinity.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_numeric(c, to: str = "double") -> Column:
    """Parse-or-NULL (``errors='coerce'``); NaN becomes NULL as well."""
    v = _col(c).try_cast(to)
    if to in ("double", "float"):
        v = F.when(~F.isnan(v), v)
    return v


def row_sum(cols) -> Column:
    """Horizontal sum of NULL-filled columns (``df[cols].sum(axis=1)``)."""
    return reduce(add, [F.coalesce(_col(c), F.lit(0.0)) for c in cols])


def weighted_sum(weights: dict) -> Column:
    """Σ w·x over NULL-filled columns."""
    return reduce(add, [F.lit(float(w)) * F.coalesce(_col(c), F.lit(0.0))
                        for c, w in weights.items()])


def safe_ratio(num, den) -> Column:
    """num / den when den > 0 else NULL."""
    d = _col(den)
    return F.when(d > 0, _col(num).cast("double") / d)


def positive_flag(c) -> Column:
    """1 when coalesce(x, 0) > 0 else 0 (has_payment / has_usage)."""
    return (F.coalesce(_col(c), F.lit(0)) > 0).cast("int")


def null_out_of_range(c, lo, hi) -> Column:
    """Keep lo <= x <= hi, NULL otherwise (age outliers)."""
    v = _col(c)
    return F.when(v.between(lo, hi), v)


def clip_shift(c, lower=0, shift=1) -> Column:
    """``x.clip(lower) + shift`` keeping NULL (bare greatest would skip it)."""
    v = _col(c)
    return F.when(v.isNotNull(), F.greatest(v, F.lit(lower)) + F.lit(shift))


def right_closed_cut(c, edges, labels) -> Column:
    """``pd.cut(x, bins=edges, labels)``: (e0, e1], (e1, e2], ...

    ``edges`` may start with -inf / end with +inf.  A value equal to the first
    edge or outside all bins gives NULL, like pandas.
    """
    if len(labels) != len(edges) - 1:
        raise ValueError("need len(edges) - 1 labels")
    v = _col(c)
    expr = None
    for i, label in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        cond = F.lit(True)
        if lo != float("-inf"):
            cond = cond & (v > F.lit(lo))
        if hi != float("inf"):
            cond = cond & (v <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


# Fixed values that must equal the reference's reports.
# Payment-trend bins: (-inf, -1] "Queda", (-1, 1] "Estável", (1, inf) "Alta".
TREND_EDGES = [float("-inf"), -1.0, 1.0, float("inf")]
TREND_LABELS = ["Queda", "Estável", "Alta"]
# Age groups: (10,20] (20,30] (30,40] (40,50] (50,60] (60,90].
AGE_EDGES = [10, 20, 30, 40, 50, 60, 90]
AGE_LABELS = ["10-20", "21-30", "31-40", "41-50", "51-60", "61+"]


def trend_bin(c) -> Column:
    """Payment trend of a diff column, NULL diff counted as 0."""
    return right_closed_cut(F.coalesce(_col(c), F.lit(0.0)), TREND_EDGES, TREND_LABELS)


def age_group(c) -> Column:
    return right_closed_cut(c, AGE_EDGES, AGE_LABELS)
