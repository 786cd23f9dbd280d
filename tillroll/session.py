"""Session construction and the few settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the jobs depend on for their semantics (dates, overflow, division by zero)
# and for their plans (adaptive re-planning, skew splitting, partition coalescing).
JOB_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a refresh runs several tables' jobs at a time, which then share the executors evenly
    "spark.scheduler.mode": "FAIR",
}


def build_session(app: str = "tillroll", master: str | None = None,
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with the job settings applied.

    On a cluster, ``master`` stays None and the launcher decides; tests and the bench
    pass ``local[N]``.  The web UI stays off: jobs are batch and need no server.
    """
    builder = (SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints and intermediate tables."""
    d = spark.sparkContext.getCheckpointDir()
    if d:
        return d
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """Use the session's checkpoint folder, or the shared one that the caller or the environment
    names. There is no machine-local default: without either, none is set."""
    d = checkpoint_dir(spark) or fallback or os.environ.get("TILLROLL_CHECKPOINT_DIR")
    if d and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for state and intermediate tables. Only a session whose tasks run in the driver's own
    process gets a folder of its own where none is named: elsewhere executors would not see it."""
    folder = checkpoint_dir(spark)
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set")
        folder = tempfile.mkdtemp(prefix="tillroll-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")
