"""Small helpers for Spark jobs of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.checkpoints import checkpointed, shared_folder
from lexiloom.joins import HEAVY, join_spread


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df read back from compressed Parquet files in the shared folder: smaller than a checkpoint, and columns can be left out."""
    path = path or shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more; until then it's there for tasks that must run again."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame) -> str:
    """The beginning of names that no column of df has: one underscore more than any of them begins with, two at least."""
    return "_" * max([2, *(len(c) - len(c.lstrip("_")) + 1 for c in df.columns)])


__all__ = ["HEAVY", "checkpointed", "discard", "fresh", "join_spread", "shared_folder", "written"]
