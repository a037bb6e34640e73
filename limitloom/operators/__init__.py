from limitloom.operators.aggregates import (
    CUT_LEVELS,
    any_and_any,
    bucket_histogram,
    count_of_counts,
    cut_points,
    distinct_values,
    ever_flags,
    flow_edges,
    mean_then_sum,
    pivot_months,
    union_distinct,
)
from limitloom.operators.dedupe import dedupe, first_per_key, latest_per_key, top_per_key, worst_per_key
from limitloom.operators.joins import (
    asof_forward,
    attach,
    attach_history,
    attach_on_day,
    attach_on_month,
    attach_prev_month,
    compare_groups,
    exclude,
    fallback_fill,
    lookback_max,
    member_flag,
)
from limitloom.operators.split import ntile_global, tile_starts
from limitloom.operators.windows import (
    cumulative,
    first_event_month,
    group_total,
    lags,
    month_index,
    month_number,
    running_ordinal,
    since_event,
)

__all__ = [
    "CUT_LEVELS",
    "any_and_any",
    "asof_forward",
    "attach",
    "attach_history",
    "attach_on_day",
    "attach_on_month",
    "attach_prev_month",
    "bucket_histogram",
    "compare_groups",
    "count_of_counts",
    "cumulative",
    "cut_points",
    "dedupe",
    "distinct_values",
    "ever_flags",
    "exclude",
    "fallback_fill",
    "first_event_month",
    "first_per_key",
    "flow_edges",
    "group_total",
    "lags",
    "latest_per_key",
    "lookback_max",
    "mean_then_sum",
    "month_index",
    "month_number",
    "member_flag",
    "ntile_global",
    "pivot_months",
    "running_ordinal",
    "since_event",
    "tile_starts",
    "top_per_key",
    "union_distinct",
    "worst_per_key",
]
