"""SparkSession helpers.

The library never creates a session behind the caller's back: every plan takes
the caller's DataFrames. These helpers exist for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; all are standard Spark SQL options.
SCALE_CONF = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, and demote sort-merge joins to broadcast joins when the
    # *measured* size of one side is small (the size check behind every lookup
    # join in this library; no unconditional broadcast hints are used).
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Survey years come from timestamp_ntz or ints; keep any timestamp logic UTC.
    "spark.sql.session.timeZone": "UTC",
    # Checkpoints (exact quantiles, report inputs) are removed from the shared
    # folder once nothing references them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "quadrat", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with :data:`SCALE_CONF` applied.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster leave
    them ``None`` so the cluster's own settings apply.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(SCALE_CONF)
    conf["spark.ui.enabled"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the checkpoint folder, setting one only where none is configured.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is; a cluster without one is an error, since executors cannot read what
    others write to their own disks. In local mode a scratch folder is created.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(configured)
        return configured
    if not re.fullmatch(r"local(\[.*\])?", sc.master or ""):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    path = fallback or tempfile.mkdtemp(prefix="quadrat-ckpt-")
    os.makedirs(path, exist_ok=True)
    sc.setCheckpointDir(path)
    return path


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle partition count, Spark's own default where none is set
    (some platforms set "auto")."""
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except ValueError:
        return spark.sparkContext.defaultParallelism


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` over all shuffle partitions. An explicit number is
    not coalesced by adaptive execution, so what a task holds is set by the session."""
    return df.repartition(shuffle_partitions(df.sparkSession), *keys)
