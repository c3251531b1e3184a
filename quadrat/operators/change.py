"""Period-over-period change (W3) and the histogram of a measure (M3 + A1/A2 + W1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.forestry import bin_bounds, bin_index
from .aggregate import counts_with_total


def period_change(df: DataFrame, ids: Sequence[str], period: str, value: str,
                  start, end, out: str, percent: bool = False,
                  fill_result: bool = True, keep_periods: bool = False) -> DataFrame:
    """``pivot_wider(names_from = period, values_fill = 0)`` then ``end - start``.

    A site absent in one period counts as 0 there (documented reference
    behaviour, B8), so this is a conditional aggregate over all rows of the id,
    not a ``lag``. ``percent=True`` gives ``(end - start) / start * 100`` with
    NULL for a zero start (N5) instead of Inf/NaN. ``fill_result`` applies the
    reference's final ``replace_na(0)``.
    """
    def at(p) -> Column:
        hit = F.col(period) == F.lit(p)
        return F.when(F.count(F.when(hit, F.lit(1))) == 0, F.lit(0.0)) \
            .otherwise(F.max(F.when(hit, F.col(value))).cast("double"))

    s_name, e_name = str(start), str(end)
    wide = df.groupBy(*ids).agg(at(start).alias(s_name), at(end).alias(e_name))
    diff = F.col(e_name) - F.col(s_name)
    if percent:
        res = F.try_divide(diff, F.col(s_name)) * F.lit(100.0)
    else:
        res = diff
    if fill_result:
        res = F.coalesce(res, F.lit(0.0))
    cols = [*ids, s_name, e_name] if keep_periods else list(ids)
    return wide.select(*cols, res.alias(out))


def size_histogram(df: DataFrame, total_by: Sequence[str], group_by: Sequence[str],
                   value: str, width: float, origin: float, out: str = "total_freq") -> DataFrame:
    """D1/D2 core: relative frequency of ``value`` in left-closed bins.

    ``total_freq`` of (group, bin) = rows in the bin / rows in the ``total_by``
    group, i.e. the reference's per-value ``n / sum(n)`` summed within each bin.
    Rows below ``origin`` form a NULL bin but stay in the denominator (B6).
    Counting per bin directly (instead of per distinct value first) keeps the
    shuffled data at one row per bin per map task.
    """
    b = bin_index(value, width, origin)
    within = [*[g for g in group_by if g not in total_by], "__bin"]
    counts = counts_with_total(df.withColumn("__bin", b), total_by, within, "__n", "__total")
    shares = counts.withColumn(out, F.try_divide(F.col("__n").cast("double"), F.col("__total").cast("double")))
    lo, hi = bin_bounds(F.col("__bin"), width, origin)
    keys = [*total_by, *[g for g in group_by if g not in total_by]]
    return shares.select(*keys, F.col("__bin").cast("int").alias("bin"),
                         lo.alias("bin_lo"), hi.alias("bin_hi"), out)
