"""Shared-folder tables, package shipping and Arrow batch helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Text bytes worked on at once inside a task (one longer text is one slice).
SLICE_BYTES = 2 << 20


def ship(spark: SparkSession) -> None:
    """In local mode, let the Python workers import this package wherever they were
    started. On a cluster it is installed or passed with ``--py-files``."""
    sc = spark.sparkContext
    if not (sc.master or "").startswith("local[") or getattr(sc, "_quadrat_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="quadrat-src-"), "quadrat_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._quadrat_shipped = True


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/quadrat-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts
    the lineage, survives lost executors, and later reads prune columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, limit: int) -> Iterator[None]:
    """Actions inside hand Python workers record batches of at most about ``limit``
    bytes; the session's own setting is put back afterwards."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key, None)
    spark.conf.set(key, f"{limit}b")
    try:
        yield
    finally:
        spark.conf.set(key, old) if old is not None else spark.conf.unset(key)


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except (TypeError, ValueError):
        return spark.sparkContext.defaultParallelism


def text_bytes(docs: DataFrame, col: str = "text") -> int:
    """Bytes of all texts (one light aggregate over the column)."""
    return int(docs.agg(F.sum(F.octet_length(F.col(col)))).first()[0] or 0)


def parts_for(spark: SparkSession, total_bytes: int, per_part: int) -> int:
    """Partitions so that each gets about ``per_part`` bytes, and at least the
    session's shuffle partitions."""
    return max(shuffle_parts(spark), -(-total_bytes // per_part))


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_binary(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], col: str = "text",
           limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches cut so that each holds at most ``limit`` text bytes or one
    row, with the text column's bytes and offsets."""
    for b in batches:
        raw, off = text_buffers(b.column(b.schema.get_field_index(col)))
        i, n = 0, b.num_rows
        while i < n:
            j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), n)
            yield b.slice(i, j - i), raw[off[i]:off[j]], off[i:j + 1] - off[i]
            i = j


def bounded_sample(df: DataFrame, n: int, *key: str) -> list:
    """At most ``n`` rows, those with the smallest hash of ``key``, as a list.
    A cut on the hash, drawn from the number of rows, keeps what every task sends
    near its share of ``n``."""
    total = df.count()
    h = F.xxhash64(*key, F.lit(11))
    if total > 2 * n:
        df = df.where(F.pmod(h, F.lit(1 << 30)) < int((1 << 30) * min(1.0, (1.2 * n + 200) / total)))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), *key).limit(n).collect()
