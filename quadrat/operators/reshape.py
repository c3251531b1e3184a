"""Wide/long reshaping.

Pivots always take their values explicitly: the output schema is fixed and no
extra job has to find the distinct values. A pivot is a single grouped
aggregate with one conditional aggregate per output cell (what Spark's own
``pivot`` expands to), which makes rule N11 - fill only *absent* cells - a
presence count per cell.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    """``starts_with(prefix)`` - case-insensitive, schema order kept."""
    p = prefix.lower()
    return [c for c in df.columns if c.lower().startswith(p)]


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose whole name matches ``pattern``."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.fullmatch(c)]


def unpivot_regex(df: DataFrame, ids: Sequence[str], cols: Sequence[str], pattern: str,
                  names_to: Sequence[str], values_to: str = "value",
                  value_type: str | None = None) -> DataFrame:
    """``pivot_longer(cols, names_to=c(a, b), names_pattern=pattern)``.

    Each capture group of ``pattern`` becomes one column; a name that does not
    match gives NULL parts (N12). Missing values are kept (N13).

    The pattern is applied to the column *names* once, while the plan is built:
    each source column becomes one struct of literal name parts and its value,
    and a single ``inline`` emits the rows. No per-row regular expression runs.
    """
    rx = re.compile(pattern)
    structs = []
    for c in cols:
        m = rx.search(c)
        parts = [m.group(i + 1) if m else None for i in range(len(names_to))]
        val = F.col(c).cast(value_type) if value_type else F.col(c)
        structs.append(F.struct(*[F.lit(p).cast("string").alias(n) for n, p in zip(names_to, parts)],
                                val.alias(values_to)))
    return df.select(*ids, F.inline(F.array(*structs)))


def unpivot_list(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name_to: str,
                 values_to: str = "value") -> DataFrame:
    """R2: ``pivot_longer(c(a, b, ...))`` - listed columns, the name in one column.
    Missing values are kept."""
    return df.unpivot(list(ids), list(cols), name_to, values_to)


def unpivot_multi(df: DataFrame, ids: Sequence[str], pattern: str,
                  value_group: int, name_to: str, cols: Sequence[str] | None = None) -> DataFrame:
    """``pivot_longer(names_to = c(".value", name_to), names_pattern = ...)``.

    Capture group ``value_group`` (1-based) names the output value column, the
    other group fills ``name_to``. One output row per distinct other-group value,
    built with a single ``inline`` (no self-union, one pass).
    """
    rx = re.compile(pattern)
    cols = list(cols) if cols is not None else [c for c in df.columns if rx.fullmatch(c)]
    other = 2 if value_group == 1 else 1
    names: list[str] = []
    rows: dict[str, dict[str, str]] = {}
    for c in cols:
        m = rx.fullmatch(c)
        if not m:
            continue
        v, o = m.group(value_group), m.group(other)
        if v not in names:
            names.append(v)
        rows.setdefault(o, {})[v] = c
    # A combination absent from the columns is a typed NULL (pivot_longer
    # fills it with NA).
    types = {}
    for mapping in rows.values():
        for v, c in mapping.items():
            types.setdefault(v, df.schema[c].dataType)
    structs = []
    for o, mapping in rows.items():
        fields = [F.lit(o).alias(name_to)]
        for v in names:
            src = F.col(mapping[v]) if v in mapping else F.lit(None).cast(types[v])
            fields.append(src.alias(v))
        structs.append(F.struct(*fields))
    return df.select(*ids, F.inline(F.array(*structs)))


def pivot_wide(df: DataFrame, ids: Sequence[str], names_from: str, pivot_values: Sequence,
               values: Sequence[str], fill: float | None = None,
               glue: str | None = None) -> DataFrame:
    """``pivot_wider(names_from, values_from, values_fill)``.

    Output names: the pivot value alone for one value column, else
    ``glue.format(name=value_of_pivot, value=value_column)`` (default
    ``'{name}_{value}'``, R's ``names_glue = "{Type}_{.value}"``).
    ``fill`` replaces only cells with no input row; a present NULL stays NULL.
    """
    glue = glue or "{name}_{value}"
    key = F.col(names_from)
    aggs: list[Column] = []
    for p in pivot_values:
        hit = key == F.lit(p)
        present = F.count(F.when(hit, F.lit(1)))
        for v in values:
            cell = F.max(F.when(hit, F.col(v)))
            if fill is not None:
                cell = F.when(present == 0, F.lit(fill)).otherwise(cell)
            name = str(p) if len(values) == 1 else glue.format(name=p, value=v)
            aggs.append(cell.alias(name))
    return df.groupBy(*ids).agg(*aggs)


def rename_with(df: DataFrame, fn, cols: Sequence[str] | None = None) -> DataFrame:
    """``rename_with(fn, cols)``."""
    targets = cols if cols is not None else df.columns
    return df.withColumnsRenamed({c: fn(c) for c in targets if fn(c) != c})
