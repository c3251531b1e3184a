"""Generic DataFrame operators, parameterised by column names."""

from .aggregate import mean_se, nested_mean_se, outer_mean_se, share_of_total, with_global_stats
from .change import period_change, size_histogram
from .join import common_columns, left_join_fill, natural_full_join, natural_join
from .quantiles import box_summary, exact_quantiles
from .recode import category_rank, distinct_pairs, label_of, recode
from .reshape import (columns_matching, columns_with_prefix, pivot_wide, rename_with,
                      unpivot_multi, unpivot_regex)

__all__ = [
    "mean_se", "nested_mean_se", "outer_mean_se", "share_of_total", "with_global_stats",
    "period_change", "size_histogram", "common_columns", "left_join_fill", "natural_full_join",
    "natural_join", "box_summary", "exact_quantiles", "category_rank", "distinct_pairs",
    "label_of", "recode", "columns_matching", "columns_with_prefix", "pivot_wide",
    "rename_with", "unpivot_multi", "unpivot_regex",
]
