from pulsepanel.functions.periods import (
    add_periods, day_index, index_of_timestamp, period_from_index, period_index,
    period_of_timestamp,
)
from pulsepanel.functions.scalar import (
    age_group, clip_shift, coerce_numeric, null_out_of_range,
    positive_flag, right_closed_cut, row_sum, safe_ratio, trend_bin, weighted_sum,
)

__all__ = [
    "add_periods", "day_index", "index_of_timestamp", "period_from_index",
    "period_index", "period_of_timestamp", "age_group", "clip_shift",
    "coerce_numeric", "null_out_of_range",
    "positive_flag", "right_closed_cut", "row_sum", "safe_ratio", "trend_bin",
    "weighted_sum",
]
