"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "siftwell", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution and UTC time; sizes come from the cluster unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


SMALL_TASK_BYTES = 16 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out to all cores.

    A small table may be one row group, which one task would read and process
    alone. The size comes from the plan's statistics; a scan large enough to fill
    the cluster is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_TASK_BYTES else df


def tasks_for(df: DataFrame, task_bytes: int) -> int:
    """Tasks of about ``task_bytes`` of a table's files each, by the plan's statistics; no fewer than the session's."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // task_bytes, 100_000))


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Where the cluster names none and the master is local, a folder of this
    machine is set, as in tests. On a cluster without the setting this fails:
    a machine-local folder would be lost with its executor.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    jvm_dir = spark.sparkContext.getCheckpointDir()
    if jvm_dir:
        return jvm_dir
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = os.path.join(tempfile.gettempdir(), f"siftwell-{os.getuid()}")
    os.makedirs(root, exist_ok=True)
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor costs no recompute of the whole chain."""
    scratch_root(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint(eager=True)
