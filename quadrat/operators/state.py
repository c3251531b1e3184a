"""A10 kept up to date: a table of mergeable sums per period, to which a new period is
added without reading the old ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..functions.exact import exact_state, merge_states, state_stats
from ..sources.catalog import write_table


def update_state(path: str, rows: DataFrame, period: str, keys: Sequence[str], value: str) -> None:
    """Write the states of the periods that ``rows`` has, per period and ``keys``, into
    the table at ``path``, one folder a period. A period given again replaces its old
    states; all others' files stay as they are."""
    write_table(exact_state(rows, [period, *keys], value), path, partition_by=[period], only_touched=True)


def kept_stats(spark: SparkSession, path: str, keys: Sequence[str], mean: str, error: str) -> DataFrame:
    """Mean and standard error per ``keys`` over all periods kept (``keys`` may hold the
    period), bit for bit what one aggregate of all rows would give."""
    return state_stats(merge_states(spark.read.parquet(path), keys), keys, mean, error)
