"""Canopy cover from densiometer readings (D4 table, D5 chart data).

Input: the ``densiometer`` role - Site, Plot, SY and text columns
``Calc_{N,S,E,W}_{Veg,Wood,Open}`` that may hold junk such as ``'n/a'``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..fixed import CALC_PATTERN, COVER_TYPES
from ..functions.nulls import std_error, to_number
from ..functions.text import pm_text, round_half_even
from ..operators.aggregate import nested_mean_se
from ..operators.reshape import columns_with_prefix, unpivot_regex


def canopy_long(densio: DataFrame) -> DataFrame:
    """P2 + M11 + R1: one row per reading: Site, Plot, SY, Direction, Type, value."""
    calc = [c for c in columns_with_prefix(densio, "Calc") if c.startswith("Calc_")]
    nums = densio.select("Site", "Plot", "SY", *[to_number(c).alias(c) for c in calc])
    return unpivot_regex(nums, ["Site", "Plot", "SY"], calc, CALC_PATTERN,
                         ["Direction", "Type"], "value")


def canopy_cover(densio: DataFrame) -> DataFrame:
    """A10: plot mean over directions, then mean and SE across plots per
    (SY, Site, Type); missing readings are ignored at both levels. Long form."""
    return nested_mean_se(canopy_long(densio), ["SY", "Site", "Type"], ["Plot"],
                          {"perc_plot": F.avg("value")},
                          {"perc_plot": ("perc", "perc_SE")})


def canopy_cover_wide(densio: DataFrame) -> DataFrame:
    """:func:`canopy_cover` pivoted to ``{Type}_perc``, ``{Type}_perc_SE`` - computed
    without the long form: per plot, the sum and count of non-missing readings
    of each cover type are accumulated straight from the wide row (the type of
    each column comes from its name, parsed once), so the aggregate reads one
    row per reading sheet instead of one per reading. Every type with columns is
    present for every site-year, as in the long form.
    """
    rx = re.compile(CALC_PATTERN)
    by_type: dict[str, list[str]] = {}
    for c in densio.columns:
        m = rx.search(c)
        if m and c.startswith("Calc_"):
            by_type.setdefault(m.group(2), []).append(c)
    row_sum, row_cnt = {}, {}
    for t, cols in by_type.items():
        nums = [to_number(c) for c in cols]
        row_sum[t] = reduce(lambda a, b: a + b, [F.coalesce(n, F.lit(0.0)) for n in nums])
        row_cnt[t] = reduce(lambda a, b: a + b, [n.isNotNull().cast("int") for n in nums])
    plot = densio.groupBy("SY", "Site", "Plot").agg(
        *[F.sum(row_sum[t]).alias(f"__s_{t}") for t in by_type],
        *[F.sum(row_cnt[t]).alias(f"__k_{t}") for t in by_type])
    means = {t: F.try_divide(F.col(f"__s_{t}"), F.col(f"__k_{t}").cast("double")) for t in by_type}
    return plot.groupBy("SY", "Site").agg(
        *[F.avg(means[t]).alias(f"{t}_perc") for t in by_type],
        *[std_error(means[t]).alias(f"{t}_perc_SE") for t in by_type])


def canopy_table(densio: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """``mean ± SE`` of percent cover: Alive (Veg), Dead (Wood), Open.

    The wide step fills 0 only where a type is absent (N11) - a type whose
    columns are missing from the sheet; a present but missing SE (one plot)
    prints ``NA``. ``wide`` passes :func:`canopy_cover_wide` where it has been
    computed already.
    """
    d = _with_types(canopy_cover_wide(densio) if wide is None else wide, ["perc", "perc_SE"])
    num = [f"{t}_{v}" for t in COVER_TYPES for v in ("perc", "perc_SE")]
    d = d.withColumns({c: round_half_even(c, 1) for c in num})
    return d.select("SY", "Site",
                    pm_text("Veg_perc", "Veg_perc_SE").alias("Alive"),
                    pm_text("Wood_perc", "Wood_perc_SE").alias("Dead"),
                    pm_text("Open_perc", "Open_perc_SE").alias("Open"))


def canopy_series(densio: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """Chart data per (SY, Site): Veg, Wood, Open means (absent type = 0)
    and ``Wood_down`` = -Wood, the downward bar of the diverging chart."""
    d = _with_types(canopy_cover_wide(densio) if wide is None else wide, ["perc"])
    d = d.select("SY", "Site", *[F.col(f"{t}_perc").alias(t) for t in COVER_TYPES])
    return d.withColumn("Wood_down", -F.col("Wood"))


def _with_types(d: DataFrame, values) -> DataFrame:
    """Absent cover types (no columns at all) become 0 (values_fill)."""
    missing = {f"{t}_{v}": F.lit(0.0) for t in COVER_TYPES for v in values
               if f"{t}_{v}" not in d.columns}
    return d.withColumns(missing) if missing else d
