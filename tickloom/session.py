"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(app: str = "tickloom", cores: str = "*", **conf: str) -> SparkSession:
    """Local session with the settings the jobs rely on; a cluster passes its own.

    A cluster also names the folder its executors share (``spark.checkpoint.dir``); in
    local mode a folder below the working folder stands in where nothing names it.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        .config("spark.ui.enabled", "false")
        # Call-site capture costs more than building the plans of the long chains.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    if not spark.conf.get("spark.checkpoint.dir", None):
        # Local mode only: driver and executors are one process.
        spark.stop()
        spark = builder.config("spark.checkpoint.dir", f"file://{os.path.abspath('spark-checkpoints')}").getOrCreate()
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        raise ValueError("spark.checkpoint.dir is not set; name a folder that all executors share")
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own part of the shared folder.

    What an application stores there lies below one folder, named by its id, so it can be
    removed as a whole when the application has ended (``drop_scratch``).
    """
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    return f"{own}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Remove all that this application stored. Results that still read from it are lost."""
    remove_path(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of any file system that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none if it is not there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write a result that several branches read, and continue from the files.

    Parquet in the shared folder survives executor loss and is column-pruned by
    every reader, which a checkpointed row store is not.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

