"""Column-level expressions: NULL rules, rounding and text, domain formulas."""

from .forestry import (basal_area, bin_bounds, bin_index, count_volume, inverse_rescale,
                       line_intersect_volume, rescale, sampled_length)
from .nulls import fill_zero, isin_or_null, mean_strict, std_error, sum0, to_number
from .text import bin_label, join_keys, number_text, pm_text, round_half_even, sign_label

__all__ = [
    "basal_area", "bin_bounds", "bin_index", "count_volume", "inverse_rescale",
    "line_intersect_volume", "rescale", "sampled_length", "fill_zero", "isin_or_null",
    "mean_strict", "std_error", "sum0", "to_number", "bin_label", "join_keys",
    "number_text", "pm_text", "round_half_even", "sign_label",
]
