"""Grouped statistics.

All aggregates here are algebraic (count, sum, avg, stddev) so Spark computes
them as partial (map-side) then final aggregates: a hot site or plot holding a
third of all rows is reduced inside every map task before the shuffle and
never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exact import COMPLETE, Exact, aggregate, exact_mean, exact_std_error
from ..functions.nulls import mean_strict, std_error
from .join import natural_join


def mean_se(x: str, strict: bool = False, exact: bool = False) -> tuple[Column | Exact, Column | Exact]:
    """A3/A4 + A5: mean (ignoring or propagating missing) and its standard error."""
    if exact:
        m = exact_mean(x)
        return m.within(COMPLETE) if strict else m, exact_std_error(x)
    m = mean_strict(x) if strict else F.avg(x)
    return m, std_error(x)


def nested_mean_se(df: DataFrame, outer: Sequence[str], inner: Sequence[str],
                   inner_aggs: Mapping[str, Column | Exact],
                   names: Mapping[str, tuple[str, str | None]],
                   strict: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """A10: aggregate within ``outer + inner`` groups, then mean and SE across them.

    ``inner_aggs`` maps an inner-level column name to its aggregate (e.g. the
    plot's summed basal area). ``names`` maps that column to the output names of
    its mean and SE (SE name ``None`` = no SE). Columns listed in ``strict`` use
    the NA-propagating mean (N3) at the outer level. With ``exact`` the bits of the
    results do not depend on the order of addition (:mod:`..functions.exact`);
    ``inner_aggs`` should then be exact too.

    Plan: two HashAggregates with partial aggregation each. The default keeps
    two Exchanges because the map-side combine shrinks the inner level first;
    pre-partitioning raw rows on ``outer`` would save one Exchange but shuffle
    every raw row.
    """
    lvl1 = aggregate(df, [*outer, *inner], *[a.alias(n) for n, a in inner_aggs.items()])
    return outer_mean_se(lvl1, outer, names, strict, exact)


def outer_mean_se(df: DataFrame, outer: Sequence[str],
                  names: Mapping[str, tuple[str, str | None]],
                  strict: Sequence[str] = (), exact: bool = False) -> DataFrame:
    """Second level of A10/A11 on an already aggregated table."""
    out = []
    for col, (mean_name, se_name) in names.items():
        m, se = mean_se(col, col in strict, exact)
        out.append(m.alias(mean_name))
        if se_name:
            out.append(se.alias(se_name))
    return aggregate(df, outer, *out)


def share_of_total(df: DataFrame, by: Sequence[str], value: str, out: str,
                   scale: float = 1.0) -> DataFrame:
    """``value / sum(value)`` within ``by`` (times ``scale``, e.g. 100).

    The group totals are a partial aggregate joined back on ``by`` rather than a
    window: a window would put every row of a group (e.g. one sampling year)
    into one task. The totals table has one row per group, so AQE turns the
    join into a broadcast when its measured size is small and keeps a
    skew-split sort-merge join otherwise.
    """
    tot = df.groupBy(*by).agg(F.sum(value).alias("__total"))
    j = natural_join(df, tot, "inner", on=by) if by else df.join(tot)
    share = F.try_divide(F.col(value).cast("double"), F.col("__total").cast("double"))
    if scale != 1.0:
        share = share * F.lit(float(scale))
    return j.withColumn(out, share).drop("__total")


def counts_with_total(df: DataFrame, by: Sequence[str], within: Sequence[str], count: str,
                      total: str) -> DataFrame:
    """Rows per ``by + within`` and, beside each, rows per ``by``, from one
    pass: no totals join and no window over the rows of a group.

    Partial counts per ``by + within`` are one row per group and map task; Spark
    then gathers each ``by`` group's few counts in one map of count per ``within``
    (its keys are those that occur), adds them up and takes the map apart again. One
    aggregate over the rows and one over their counts; a group's map has one entry
    for each ``within``, such as a size class, however many rows the group has.
    """
    cells = df.groupBy(*by, *within).agg(F.count(F.lit(1)).alias(count))
    groups = cells.groupBy(*by).agg(F.sum(count).alias(total),
                                    F.collect_list(F.struct(*within, count)).alias("__cells"))
    return groups.select(*by, total, F.inline("__cells")).select(*by, *within, count, total)


def totals_by_level(df: DataFrame, levels: Sequence[Sequence[str]], aggs: Sequence[Column]) -> DataFrame:
    """The same aggregates for several groupings of one table by GROUPING
    SETS: one scan, one Expand and one partial aggregate, in place of an aggregate for
    each level. Columns: all grouping columns (NULL where a level does not group by
    them), ``level`` (its place in ``levels``) and the aggregates.
    """
    columns = list(dict.fromkeys(c for level in levels for c in level))
    sets = [[F.col(c) for c in level] for level in levels]
    # grouping_id has a bit for each column that a set leaves out, the first highest.
    ids = [sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in level) for level in levels]
    out = df.groupingSets(sets, *columns).agg(F.grouping_id().alias("__set"), *aggs)
    place = F.lit(None).cast("int")
    for k, i in enumerate(ids):
        place = F.when(F.col("__set") == i, k).otherwise(place)
    return out.withColumn("level", place).drop("__set")


def with_global_stats(df: DataFrame, stats: Sequence[Column]) -> DataFrame:
    """Attach one-row global aggregates (min/max ...) to every row.

    The joined side is a global aggregate, exactly one row by construction,
    so broadcasting it is safe at any data size; the plan is a broadcast
    nested-loop join against a single row, i.e. a projection. Both sides sit
    in one plan, so the upstream shuffle is computed once and reused. (A
    scalar subquery, ``DataFrame.scalar()``, runs the upstream plan a second
    time: measured 1.5x slower on the seedling/sapling charts.)
    """
    one = df.agg(*stats)
    return df.join(F.broadcast(one), how="inner")
