"""Session settings for local runs, and lineage cutting that survives lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "trialspark", memory: str | None = None) -> SparkSession:
    """A session for tests and the bench. On a cluster, pass the cluster's own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # keep local cores busy
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory or os.environ.get("TRIALSPARK_MEMORY", "8g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, shared by all executors.

    Only a local master without that setting falls back to a temporary folder. On a cluster a ``file:`` folder has to
    be mounted on every machine, which nothing here can see, so it is warned of.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="trialspark-shared-")
    if str(folder).startswith("file:") and not sc.master.startswith("local"):
        warnings.warn(f"{folder} is on local disks: it must be mounted on every executor", stacklevel=2)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage, so branches read it instead of redoing it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def packed(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df``, which is best checkpointed, in one partition for so many of its rows, so that steps over few rows are few
    tasks whatever the number of shuffle partitions. Counts the rows; never adds partitions."""
    return df.coalesce(max(1, -(-df.count() // rows)))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Arrow batches hold fewer texts, which are long, unless the session says how many rows they hold."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(rows))


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back, so that readers prune its columns.

    Unlike a checkpoint the files stay until the folder is cleared; a run of ``stored`` is a Spark job.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
