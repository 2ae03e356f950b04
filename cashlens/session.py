"""Session settings shared by tests, the bench and command-line use."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def get_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "cashlens") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Keep all cores busy on small local data; a cluster keeps its own setting.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.sql.files.maxPartitionBytes", "4MB")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Long generated expressions: skip the per-expression call-site capture.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CASHLENS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session.

    A cluster names it in ``spark.checkpoint.dir``.  Only where none is set (tests) a folder is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        configured = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a reduced frame in the shared checkpoint folder.

    Used where several branches read one aggregate of a large table: the large table is scanned once,
    and a lost executor re-reads the checkpoint instead of replaying the scan.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)
