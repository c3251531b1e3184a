"""Presentation order (O1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def with_place(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Every row's place, from 1, in the order of ``keys`` (nulls first), without
    all rows in one task: rows are sorted by range partitions, numbered inside each,
    and the number of rows in the partitions before it is added. Only these counts, one
    row a partition, meet in one window. Rows with equal keys share no place; which of
    them comes first is left open. The ranges are written to the shared checkpoint
    folder when this is called, so that rows and counts are of one layout.
    """
    order = [F.col(k).asc_nulls_first() for k in keys]
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.orderBy(*order).withColumn("__part", F.spark_partition_id()).checkpoint(eager=True)
    inside = ranged.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    counts = inside.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return inside.join(starts, "__part").select(
        *df.columns, (F.col("__before") + F.col("__row")).cast("int").alias(name))
