"""Recoding, category order and distinct values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import ColumnOrName, _c


def recode(x: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """M5/M6: replace listed values, keep every other value (and NULL) as is."""
    c = _c(x)
    lookup = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.coalesce(F.element_at(lookup, c), c) if mapping else c


def label_of(x: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """M7: ``case_when`` to labels; values not listed give NULL."""
    lookup = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in mapping.items()))
    return F.element_at(lookup, _c(x))


def category_rank(x: ColumnOrName, levels: Sequence[str]) -> Column:
    """O2: position of ``x`` in ``levels`` (1-based), NULL for unknown levels,
    as ``factor(x, levels)`` orders values. A literal map, no join."""
    lookup = F.create_map(*chain.from_iterable((F.lit(v), F.lit(i + 1)) for i, v in enumerate(levels)))
    return F.element_at(lookup, _c(x))


def distinct_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``group_by(a) reframe(unique(b))`` - distinct combinations.

    ``distinct`` is a partial aggregate: duplicates collapse in every map task.
    """
    return df.select(*cols).distinct()
