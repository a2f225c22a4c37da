"""Cuts lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _root(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexiloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df read back from a checkpoint in the folder that spark.checkpoint.dir names.

    Where that is unset, a folder of our own serves a local master, as in tests; on a cluster it's an error, as executors don't
    see each other's folders.
    """
    _root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoints' one; Hadoop deletes it when the application ends."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{_root(spark)}/{name}-{uuid.uuid4().hex}")
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()
