"""Exact per-group quantiles and box-plot statistics.

``percentile`` (exact) keeps a value->count map per group and merges it in one
task, so a hot group with many distinct values would sit whole in one task.
Here the exact order statistics come from a global sort instead:

1. range-partition all values on ``(group, value, row key)`` - a hot group is
   spread over many partitions, ties included where a row key is given;
2. that layout is checkpointed once, with the partition of each row. A group that
   lies in one partition, as all do but those at the ends of ranges, is no longer
   than a range: one window gives its places and quantiles; for the others:
3. per (group, partition): number of rows, and from these the rows of the group
   in earlier partitions and in all (one row per group and partition);
4. rows get their place in (group, partition) by a window on just that, and with
   the numbers of step 3, joined on the same key, their place in the group; the
   few places that the quantiles need (two per probability, R type 7 /
   ``quantile_cont``) are kept;
5. box-plot whiskers join the fences to the values on (group, partition) too.

The values move twice, to their range and to their (group, partition) or group, and the
largest bucket of any is one range: no group is hot. Nothing collects a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions


def _sorted_checkpoint(df: DataFrame, keys: Sequence[str], value: str,
                       num_partitions: int | None, row_key: Sequence[str]) -> DataFrame:
    """Non-missing values with their range partition on (keys, value, row key),
    materialised once. The group is a struct: it is never NULL, and structs with
    equal fields, NULL ones included, are equal in joins."""
    spark = df.sparkSession
    n = num_partitions or shuffle_partitions(spark)
    v = (df.select(F.struct(*keys).alias("__g"), F.col(value).cast("double").alias("__v"),
                   F.xxhash64(*keys, value, *row_key).alias("__tie"))
         .where(F.col("__v").isNotNull() & ~F.isnan("__v")))
    ranged = v.repartitionByRange(n, "__g", "__v", "__tie").withColumn("__pid", F.spark_partition_id())
    # The numbers per partition and the rows must come from one and the same
    # layout: checkpoint it in the shared folder (that also cuts the lineage, so
    # a lost executor does not draw the range bounds again).
    ensure_checkpoint_dir(spark)
    return ranged.checkpoint(eager=True)


def _whole_and_split(ranked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the groups of one partition, with ``n`` and their place in the group,
    and those of the groups that lie in several. Such a group is the last of one range
    and the first of another, so they are fewer than the ranges and may be broadcast."""
    ends = ranked.groupBy("__pid").agg(F.min("__g").alias("__first"), F.max("__g").alias("__last"))
    several = (ends.select("__pid", F.explode(F.array("__first", "__last")).alias("__g"))
               .groupBy("__g").agg(F.min("__pid").alias("__from"), F.max("__pid").alias("__to"))
               .where(F.col("__from") != F.col("__to")).select("__g"))
    group = Window.partitionBy("__g")
    one = ranked.select("__g", "__v").join(F.broadcast(several), "__g", "left_anti")
    whole = one.select("__g", "__v", (F.row_number().over(group.orderBy("__v")) - 1).cast("long").alias("__at"),
                       F.count(F.lit(1)).over(group).alias("n"))
    return whole, ranked.join(F.broadcast(several), "__g", "left_semi")


def _starts(ranked: DataFrame) -> DataFrame:
    """Per (group, partition): rows of the group before it, and in all."""
    counts = ranked.groupBy("__g", "__pid").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy("__g")
    before = w.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per partition in each window.
    return counts.select("__g", "__pid", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"),
                         F.sum("__c").over(w).alias("n"))


def _quantiles(ranked: DataFrame, probs: dict[str, float]) -> DataFrame:
    """__g, n and a column per probability."""
    w = Window.partitionBy("__g", "__pid").orderBy("__v", "__tie")
    placed = ranked.withColumn("__row", F.row_number().over(w))
    at = placed.join(_starts(ranked), ["__g", "__pid"]).select(
        "__g", "n", "__v", (F.col("__before") + F.col("__row") - 1).alias("__at"))
    return _at_places(at, probs)


def _interpolated(probs: dict[str, float], over=None) -> list[Column]:
    """A column per probability from the two places beside it, as an aggregate or over
    a window."""
    out = []
    for q, p in probs.items():
        x = (F.col("n") - 1).cast("double") * F.lit(float(p))
        lo, hi = (F.max(F.when(F.col("__at") == f(x), F.col("__v"))) for f in (F.floor, F.ceil))
        if over is not None:
            lo, hi = lo.over(over), hi.over(over)
        out.append((lo + (x - F.floor(x)) * (hi - lo)).alias(q))
    return out


def _at_places(at: DataFrame, probs: dict[str, float]) -> DataFrame:
    """__g, n and a column per probability from rows with their place in the group."""
    h = [(F.col("n") - 1).cast("double") * F.lit(float(p)) for p in probs.values()]
    sides = [f(x) for x in h for f in (F.floor, F.ceil)]
    few = at.where(F.col("__at").isin(*sides))       # two rows per probability and group
    return few.groupBy("__g", "n").agg(*_interpolated(probs))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: dict[str, float], num_partitions: int | None = None,
                    row_key: Sequence[str] = ()) -> DataFrame:
    """Per-group quantiles with linear interpolation (R type 7, DuckDB
    ``quantile_cont``, Spark ``percentile``). Missing values are ignored.

    Returns ``keys + [n] + list(probs)``; groups with no non-missing value are
    absent. ``row_key`` names columns that tell rows of a group apart, so that
    equal values can lie in several ranges. The layout is computed when this is
    called; the rest is lazy.
    """
    ranked = _sorted_checkpoint(df, keys, value, num_partitions, row_key)
    whole, split = _whole_and_split(ranked)
    qs = _quantiles(split, probs).unionByName(_at_places(whole, probs))
    return qs.select(*[F.col("__g")[k].alias(k) for k in keys], "n", *probs)


def box_summary(df: DataFrame, keys: Sequence[str], value: str, coef: float = 1.5,
                num_partitions: int | None = None, row_key: Sequence[str] = ()) -> DataFrame:
    """Box-plot statistics per group, as a box plot computes them.

    Quartiles by R type 7; whiskers reach the most extreme values within
    ``coef * IQR`` of the box (and never inside it); values beyond are outliers.
    Columns: keys, n, ymin, lower, middle, upper, ymax, n_outliers. The input
    is computed once: the whisker pass reads the checkpointed values.
    """
    ranked = _sorted_checkpoint(df, keys, value, num_partitions, row_key)
    whole, split = _whole_and_split(ranked)
    probs = {"lower": 0.25, "middle": 0.5, "upper": 0.75}
    reach = F.lit(coef) * (F.col("upper") - F.col("lower"))
    low, high = F.col("lower") - reach, F.col("upper") + reach
    inside = (F.col("__v") >= F.col("__flo")) & (F.col("__v") <= F.col("__fhi"))
    ends = [F.min(F.when(inside, F.col("__v"))).alias("__wlo"), F.max(F.when(inside, F.col("__v"))).alias("__whi"),
            F.count(F.when(~inside, F.lit(1))).alias("n_outliers")]
    boxes = (whole.select("__g", "__v", "n", *_interpolated(probs, Window.partitionBy("__g")))
             .withColumns({"__flo": low, "__fhi": high}).groupBy("__g", "n", *probs).agg(*ends))
    fences = _quantiles(split, probs).select("__g", "n", *probs, low.alias("__flo"), high.alias("__fhi"))
    near = _starts(split).select("__g", "__pid").join(fences.select("__g", "__flo", "__fhi"), "__g")
    w = split.join(near, ["__g", "__pid"]).groupBy("__g").agg(*ends)
    both = fences.drop("__flo", "__fhi").join(w, "__g").unionByName(boxes)
    return both.select(
        *[F.col("__g")[k].alias(k) for k in keys], "n",
        F.least(F.col("lower"), F.col("__wlo")).alias("ymin"),
        "lower", "middle", "upper",
        F.greatest(F.col("upper"), F.col("__whi")).alias("ymax"),
        "n_outliers")
