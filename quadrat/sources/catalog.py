"""Sources and sinks.

S1 reads a delimited file the way R's ``read_csv`` does: header row, cells
trimmed, missing-value texts missing, doubled quotes unescaped. S2 maps the
workbook's worksheet names onto one table each, stored as Parquet or CSV under
a root folder of any file system. S3/S4 write report datasets; per-site output
is one partitioned write, not a loop of jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed import MISSING_CSV, MISSING_SHEET
from .schemas import ALIASES, REQUIRED, SCHEMAS

CSV_OPTIONS = {
    "header": "true",
    # Readers trim cells; without this "Great Pond " and "Great Pond" are
    # two sites.
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
    "quote": '"',
    "escape": '"',
    # A record that does not fit the header is an error, not a row of NULLs;
    # without column pruning every record is checked in full.
    "mode": "FAILFAST",
    "columnPruning": "false",
}


def missing_text(name: str) -> tuple[str, ...]:
    """Cell texts that mean "missing" in a table: the two exported sheets
    (read by ``read_csv``) also use NA; in the worksheets NA is a text."""
    return MISSING_CSV if name in ("wood", "coarse_wood") else MISSING_SHEET


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
             name: str = "table", na: Sequence[str] | None = None,
             multi_line: bool = False) -> DataFrame:
    """Scan a delimited file with a header, trimmed cells and declared types.

    With a schema, cells are read as text and the declared columns are picked
    by header name and cast (:func:`conform`): sheets with reordered or extra
    columns read correctly, and a cell that does not parse becomes NULL, as
    R's readers give NA. (Spark's own CSV schema maps columns by position.)
    Without a schema the types are inferred, as R's reader does; that costs an
    extra pass over the file, so the survey tables declare theirs.

    ``na``: the cell texts that are missing (default: those of the table
    ``name``). ``multi_line`` reads quoted cells that hold line breaks; such a
    file cannot be split over tasks, so it is off by default and a broken
    record is then an error.
    """
    na = tuple(missing_text(name) if na is None else na)
    reader = spark.read.options(**CSV_OPTIONS).option("multiLine", str(multi_line).lower())
    if schema is None:
        # One text can be given to the reader; empty cells are missing besides.
        given = [x for x in na if x]
        if len(given) > 1:
            raise ValueError(f"without a schema only one missing-value text is possible, not {given}")
        return reader.option("nullValue", given[0] if given else "").option("inferSchema", "true").csv(path)
    raw = reader.csv(path)
    cells = []
    for f in raw.schema.fields:
        c = F.trim(_column(f.name))
        cells.append(F.when(~c.isin(*na), c).alias(f.name) if na else c.alias(f.name))
    return conform(raw.select(*cells), schema, name)


def find_table(spark: SparkSession, root: str, name: str, fmt: str | None = None) -> DataFrame | None:
    """One named table under ``root``, or None if there is none.

    ``fmt`` defaults to Parquet when ``root/name.parquet`` exists, else CSV.
    Whether it exists is asked of the file system that the path names, by
    opening it through the session.
    """
    schema = SCHEMAS.get(name)
    if fmt in (None, "parquet"):
        try:
            df = spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")
            return conform(df, schema, name) if schema is not None else df
        except AnalysisException as e:
            if not _not_found(e):
                raise
    if fmt in (None, "csv"):
        try:
            return read_csv(spark, f"{root.rstrip('/')}/{name}.csv", schema, name)
        except AnalysisException as e:
            if not _not_found(e):
                raise
    return None


def read_table(spark: SparkSession, root: str, name: str, fmt: str | None = None) -> DataFrame:
    """:func:`find_table`, but a table that is not there is an error."""
    df = find_table(spark, root, name, fmt)
    if df is None:
        raise FileNotFoundError(f"no table {name} under {root}")
    return df


def _not_found(e: AnalysisException) -> bool:
    return e.getCondition() == "PATH_NOT_FOUND"


def _column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def conform(df: DataFrame, schema: T.StructType, name: str = "table") -> DataFrame:
    """Fail fast when a column the analyses need is missing; cast the declared
    columns that are present to their types (text that does not parse becomes
    NULL, as R's readers give NA). Headers of the field sheets are mapped to the
    declared names. Other columns are kept after them."""
    alias = {old: new for old, new in ALIASES.get(name, {}).items()
             if old in df.columns and new not in df.columns}
    if alias:
        df = df.withColumnsRenamed(alias)
    required = REQUIRED.get(name, tuple(f.name for f in schema.fields))
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name}: missing column(s) {missing}")
    present = [f for f in schema.fields if f.name in df.columns]
    declared = {f.name for f in present}
    return df.select(*[_column(f.name).try_cast(f.dataType).alias(f.name) for f in present],
                     *[_column(c) for c in df.columns if c not in declared])


def write_table(df: DataFrame, path: str, fmt: str = "parquet",
                partition_by: list[str] | None = None, mode: str = "overwrite",
                only_touched: bool = False) -> None:
    """Write one report dataset; ``partition_by=['Site']`` gives one
    folder per site in a single distributed job.
    Rows are gathered by those columns first, so that a folder gets few files;
    AQE splits a gathered partition that is large. With ``only_touched`` the folders of
    partition values that ``df`` does not have stay as they are; the new files are
    staged and moved when all tasks have ended, so a failed write leaves the old ones."""
    if only_touched and not partition_by:
        raise ValueError("only_touched needs partition columns")
    w = (df.hint("rebalance", *partition_by) if partition_by else df).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if only_touched:
        w = w.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)
