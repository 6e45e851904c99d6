"""Tables kept for the length of a job in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a temporary one, which only a local session can use."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back: computed once for the steps that read it,
    with its lineage cut.  It does so under any configuration and at any size.  Shuffle files of earlier
    steps go first (those of the last one or two may stay): they lie on disk until the driver collects its garbage."""
    df.sparkSession.sparkContext._jvm.System.gc()
    path = f"{shared_dir(df.sparkSession, 'settled')}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
