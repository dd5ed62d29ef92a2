"""Written intermediate tables and the folder that the driver and all executors see."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only in local mode, where the session names no folder, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/gridloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else the one set by setCheckpointDir; a local one is set
    in local mode only, since on a cluster each executor would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    spark.sparkContext.setCheckpointDir(LOCAL_SHARED)
    return spark.sparkContext.getCheckpointDir() or LOCAL_SHARED


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, in the application's own part of it."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, and a lost executor
    costs only its unfinished tasks. Each call has a folder of its own."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean_up(spark: SparkSession) -> bool:
    """Removes all that this application has written so, whose results must have been used or saved
    by then. True if there was something."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
