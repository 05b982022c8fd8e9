"""Session helpers shared by jobs, tests and the benchmark."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "leadloom", cpus: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings every job assumes (UTC, AQE with skew handling).

    A master given by spark-submit or the environment stays; without one the session is local.
    """
    builder = SparkSession.builder
    if not (os.environ.get("PYSPARK_GATEWAY_PORT") or os.environ.get("SPARK_REMOTE") or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "")):
        builder = builder.master(f"local[{cpus}]")
    builder = (
        builder.appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session without one gets a folder of this machine; on a cluster that would scatter a table over the
    executors' disks, so a missing or machine-local folder is refused there.
    """
    context = spark.sparkContext
    local = context.master == "local" or context.master.startswith("local[")
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None and local:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="leadloom-ckpt-"))
        folder = context.getCheckpointDir()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


def cut_lineage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as a Parquet table in ``folder`` (default: the shared checkpoint folder).

    The table stays until its folder is cleaned, as later plans read it; give a folder per run to remove it at once.

    Like a reliable checkpoint it survives the loss of executors; unlike one it keeps column
    pruning and gives later joins the real size of the table.
    """
    spark = df.sparkSession
    path = f"{folder or ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
