"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "evq", master: str | None = None, cores: int | None = None) -> SparkSession:
    """A session for local work. On a cluster use the session that is given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # Small inputs with costly rows should still use every core.
            builder = builder.config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
            builder = builder.config("spark.driver.memory", os.environ.get("EVQ_DRIVER_MEMORY", "8g"))
    if cores:
        builder = builder.config("spark.sql.shuffle.partitions", str(cores))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``, else the runtime setting ``evq.scratch.dir``.

    Only a local-mode session without these settings gets a folder of its own;
    a cluster session without them is an error, because a machine-local folder
    would be lost with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("evq.scratch.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="spark-evq-")
    return _LOCAL_DIRS[sc.applicationId]


def scratch_dir(spark: SparkSession) -> str:
    """Where this application writes its intermediate tables."""
    return f"{shared_dir(spark)}/evq/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; runs never share one."""
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once their results have been written or read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df, name: str):
    """Write a frame to the shared folder and read it back.

    Cuts lineage durably: a lost executor re-reads the written files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
