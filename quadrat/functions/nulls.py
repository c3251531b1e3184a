"""

Every helper returns a JVM-side ``Column``; none of them is a Python UDF, so
they stay inside whole-stage codegen and aggregate partially map-side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum0(x: ColumnOrName) -> Column:
    """``sum(x, na.rm=TRUE)`` - an all-missing group sums to 0, not NULL."""
    return F.coalesce(F.sum(_c(x)).cast("double"), F.lit(0.0))


def mean_strict(x: ColumnOrName) -> Column:
    """Mean that is NULL as soon as one input is missing (``mean(x)``).

    ``count(x)`` skips NULL, ``count(1)`` does not; they differ exactly when a
    missing value is present.
    """
    c = _c(x)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def std_error(x: ColumnOrName) -> Column:
    """Sample standard deviation over the non-missing values / sqrt(n).

    One value gives NULL (``stddev_samp`` of one row is NULL), as in R.
    """
    c = _c(x)
    return F.stddev_samp(c) / F.sqrt(F.count(c))


def to_number(x: ColumnOrName) -> Column:
    """Text to double; junk such as ``'n/a'`` becomes NULL."""
    return F.trim(_c(x).cast("string")).try_cast("double")


def isin_or_null(x: ColumnOrName, values: Iterable) -> Column:
    """``x %in% c(..., NA)`` - membership that also keeps missing values."""
    c = _c(x)
    return c.isin(list(values)) | c.isNull()


def fill_zero(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """``replace_na(., 0)`` on numeric columns (NULL and NaN alike).

    ``DataFrame.na.fill`` only touches numeric columns and leaves strings alone,
    which is the reference behaviour for ``across(everything(), replace_na)``.
    """
    cols = list(columns) if columns is not None else None
    return df.na.fill(0, subset=cols) if cols else df.na.fill(0)
