"""SparkSession construction and lineage cutting.

Cluster deployments bring their own session; ``get_spark`` is what tests, the
bench and the CLI use. It only sets what the jobs depend on semantically (UTC
session zone) plus the planner knobs the jobs are designed around (AQE with
partition coalescing and skew-join splitting, a stated broadcast bound).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Joins are never hinted for inputs that grow with the data. Spark broadcasts a
# side only below these bounds: the planning-time estimate (compressed Parquet
# size, which can understate the in-memory size several-fold) gets the smaller
# bound; AQE's runtime decision, made on the measured shuffle output, the larger.
STATIC_BROADCAST_BYTES = 16 * 1024 * 1024
BROADCAST_BOUND_BYTES = 64 * 1024 * 1024


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "sendwatch") -> SparkSession:
    """The active session if there is one (a cluster's, with its own master and
    partitions); else, for tests and the bench, a local one."""
    active = SparkSession.getActiveSession()
    if active is not None and master is None:
        return active
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    shuffle_partitions = shuffle_partitions or max(2 * cpus, 8)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.autoBroadcastJoinThreshold", str(STATIC_BROADCAST_BYTES))
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold", str(BROADCAST_BOUND_BYTES))
        # a selective join side (e.g. one month of one list's messages) builds a
        # bloom filter that prunes the other side's scan before the shuffle
        .config("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SENDWATCH_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, honouring the cluster's setting.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that is used
    as is. Only a local-mode session (tests, the bench) without a setting gets
    a scratch folder; on a cluster a missing setting is an error, because a
    machine-local folder would not survive the loss of the executor that
    wrote it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on the cluster's "
                               "distributed file system) before running jobs that checkpoint")
        configured = tempfile.mkdtemp(prefix="sendwatch-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a
    local session, or nodes with the same installation; elsewhere the path is
    idle and the package comes by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written under the session's checkpoint folder
    (shared storage on a cluster): computed once, read back as Parquet, and a
    lost executor recomputes from these files rather than from the inputs.
    (``DataFrame.checkpoint`` would compute an uncached input twice: once for
    its eager count and once more to write the checkpoint files.)"""
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)
