"""Domain formulas (M1, M3, M14-M18) as plain Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import ColumnOrName, _c

from ..fixed import (DECAY_DENSITY, FINE_DIAMETER_M, FINE_END_M,  # noqa: F401 (re-exported)
                     FINE_START_M, M2_PER_HA, MEDIUM_DIAMETER_M, MEDIUM_END_M, MEDIUM_START_M,
                     PLOT_AREA_HA, SMALL_DENSITY)


def basal_area(dbh_cm: ColumnOrName) -> Column:
    """M1: pi * (DBH/100/2)^2 / 0.01 - m^2 per ha for one stem in a 0.01 ha plot."""
    r = _c(dbh_cm) / F.lit(100.0) / F.lit(2.0)
    return F.lit(math.pi) * (r * r) / F.lit(PLOT_AREA_HA)


def bin_index(x: ColumnOrName, width: float, origin: float) -> Column:
    """M3: left-closed bin number k with ``origin + k*width <= x < origin + (k+1)*width``;
    x < origin -> NULL.

    Same bins as ``cut(x, seq(origin, max + width, width), right = FALSE)``:
    the estimate ``floor((x - origin) / width)`` is corrected by one where
    float division lands on the other side of the break value ``seq`` computes
    (``origin + k * width``), e.g. for a width of 0.1. The upper bound is
    implied by the data, so no extra job computes the maximum.
    """
    c = _c(x)
    o, w = F.lit(origin), F.lit(width)
    k = F.floor((c - o) / w)
    k = (F.when(c < o + k * w, k - 1)
         .when(c >= o + (k + 1) * w, k + 1)
         .otherwise(k))
    return F.when(c >= o, k)


def bin_bounds(index: ColumnOrName, width: float, origin: float) -> tuple[Column, Column]:
    """Break values below and above bin ``index``: ``origin + k*width`` and
    ``origin + (k+1)*width``, as ``seq`` computes them (NULL for a NULL index)."""
    i = _c(index)
    return F.lit(origin) + i * F.lit(width), F.lit(origin) + (i + 1) * F.lit(width)


def rescale(y: ColumnOrName, from_min: Column, from_max: Column,
            to_min: Column, to_max: Column) -> Column:
    """``(y - min_h) / (max_h - min_h) * (max_m - min_m) + min_m``.

    A zero-width source range gives NULL instead of Inf/NaN (N5).
    """
    return F.try_divide(_c(y) - from_min, from_max - from_min) * (to_max - to_min) + to_min


def inverse_rescale(v: ColumnOrName, from_min: Column, from_max: Column,
                    to_min: Column, to_max: Column) -> Column:
    """M15 inverse (the secondary axis): maps a rescaled value back."""
    return F.try_divide(_c(v) - to_min, to_max - to_min) * (from_max - from_min) + from_min


def sampled_length(transect_m: ColumnOrName, start_m: float, end_m: float) -> Column:
    """Metres actually sampled on ``[start, end]`` of a transect.

    ``if_else(L < end, L - start, end - start)``; a transect shorter than the
    start would give a negative length, which is reported as NULL (B11).
    """
    L = _c(transect_m)
    # A missing length stays missing (``if_else`` on NA is NA; a bare
    # ``otherwise`` would turn it into the full span).
    length = (F.when(L < F.lit(end_m), L - F.lit(start_m))
              .when(L >= F.lit(end_m), F.lit(end_m - start_m)))
    return F.when(length > 0, length)


def line_intersect_volume(sum_d2_m2: ColumnOrName, length_m: ColumnOrName) -> Column:
    """Van Wagner line-intersect volume pi^2 * sum(d^2) / (8 L), in m^3/ha."""
    return F.try_divide(F.lit(math.pi ** 2) * _c(sum_d2_m2),
                        F.lit(8.0) * _c(length_m)) * F.lit(M2_PER_HA)


def count_volume(count: ColumnOrName, diameter_m: float, length_m: ColumnOrName) -> Column:
    """M18 for counted pieces of one assumed diameter: n * d^2 as sum(d^2)."""
    return line_intersect_volume(F.lit(diameter_m * diameter_m) * _c(count), length_m)
