"""Rounding and report text (M2, M4, M8, M9, M13; rules N14, N15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import ColumnOrName, _c


# Decimal places kept before display rounding: far below any displayed digit,
# far above the last-bit noise of a distributed sum (order of additions varies
# with partitioning, so 2.95 may arrive as 2.9499999999999993).
SNAP_DIGITS = 9


def round_half_even(x: ColumnOrName, digits: int = 1, snap: bool = True) -> Column:
    """R-style ``round`` (ties to even on the decimal value).

    ``bround`` rounds the decimal representation half-to-even, so 12.25 -> 12.2.
    The value is first snapped to :data:`SNAP_DIGITS` decimals so that a true
    decimal tie is rounded the same way whatever order a distributed sum used;
    exact sums (:mod:`.exact`) have no order and need no snapping.
    """
    v = _c(x).cast("double")
    return F.bround(F.bround(v, SNAP_DIGITS) if snap else v, digits)


def number_text(x: ColumnOrName) -> Column:
    """How R's ``paste`` prints an already-rounded number; NULL prints ``NA``.

    Going through ``decimal(38,1)`` avoids scientific notation for large doubles
    (``1.2345678E7``); a trailing ``.0`` is dropped as R drops it (``12``).
    """
    txt = F.regexp_replace(_c(x).cast("decimal(38,1)").cast("string"), r"\.0$", "")
    return F.coalesce(txt, F.lit("NA"))


def pm_text(mean: ColumnOrName, se: ColumnOrName) -> Column:
    """``paste(mean, "±", se)`` -> ``'12.2 ± 0.5'``, ``'12 ± NA'``.

    Never ``concat_ws``: it would silently skip a missing side.
    """
    return F.concat(number_text(mean), F.lit(" ± "), number_text(se))


def bin_label(index: ColumnOrName, bin_num: int | Column, bin_size: float) -> Column:
    """M4: label ``'(i-1)*w-i*w'`` for bin index 1..bin_num+1, else NULL.

    The reference builds a label vector of ``bin_num + 1`` entries and indexes
    it; any other index is missing. ``bin_num`` may be a column (e.g. a count
    of distinct bins computed from the data).
    """
    i = _c(index)
    w = F.lit(bin_size)
    n = bin_num if isinstance(bin_num, Column) else F.lit(bin_num)
    return F.when((i >= 1) & (i <= n + 1),
                  F.concat(_plain((i - 1) * w), F.lit("-"), _plain(i * w)))


def _plain(x: Column) -> Column:
    """A number as R's ``paste`` prints it: no trailing zeros, no exponent."""
    return F.regexp_replace(x.cast("decimal(38,6)").cast("string"), r"\.?0+$", "")


def sign_label(x: ColumnOrName) -> Column:
    """``ifelse(x > 0, 'pos', 'neg')`` - zero is 'neg', NULL stays NULL."""
    c = _c(x)
    return F.when(c.isNull(), F.lit(None).cast("string")) \
        .when(c > 0, F.lit("pos")).otherwise(F.lit("neg"))


def join_keys(*cols: ColumnOrName, sep: str = " ") -> Column:
    """M9: ``paste(Site, Plot, sep=' ')`` (NULL prints as ``NA`` like R)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_c(c).cast("string"), F.lit("NA")))
    return F.concat(*parts)
