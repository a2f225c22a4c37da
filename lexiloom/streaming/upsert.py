"""Tables that micro-batches are merged into, published version by version.

A table is a folder. Rows lie in ``data/<version>/bucket=<k>`` by a hash of their key, and ``versions/<number>.json`` says for each
bucket which folder holds it. A version writes the buckets that a batch touches and no other, and is there once its file is: the
file is written beside its place and renamed, so readers see all of a batch or nothing. The newest version also names the last batch
of every stream that was merged, so a batch that runs again changes nothing; the version before it stays, for readers and for
batches that must be computed again from what was there before them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..files import Files as _Files

BUCKETS, VERSIONS = 16, 2
#: The source of batches that no stream brought.
DIRECT = "direct"


@dataclass
class Version:
    number: int
    schema: str
    keys: list[str]
    buckets: int
    folders: dict[str, int]
    batches: dict[str, int]


def _versions(files: _Files) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in files.names("versions") if n.endswith(".json") and not n.startswith("."))


def _version(files: _Files, number: int) -> Version:
    return Version(**json.loads(files.read("versions", f"{number}.json")))


def _rows(spark: SparkSession, path: str, version: Version, buckets: list[str] | None = None) -> DataFrame:
    wanted = [b for b in version.folders if buckets is None or b in buckets]
    schema = StructType.fromJson(json.loads(version.schema))
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{version.folders[b]}/bucket={b}" for b in wanted])


def latest(path: str, spark: SparkSession) -> DataFrame | None:
    """The newest version of the table, or None before the first one."""
    return before(path, spark, None, 0)


def before(path: str, spark: SparkSession, source: str | None, batch: int) -> DataFrame | None:
    """The table as it is for a batch of a stream: the newest version that doesn't hold the batch. None before the first one."""
    files = _Files(spark, path)
    for number in reversed(_versions(files)):
        version = _version(files, number)
        if source is None or version.batches.get(source, -1) < batch:
            return _rows(spark, path, version)
    return None


def batch_source(spark: SparkSession) -> str:
    """The id of the stream whose foreachBatch runs; it stays the same as long as the stream keeps its checkpoint folder."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or DIRECT


def upsert(path: str, rows: DataFrame, keys: list[str], order: str, source: str = DIRECT, batch: int | None = None, gone: DataFrame | None = None, buckets: int = BUCKETS) -> bool:
    """Merges rows into the table by key and publishes a version; False if the source's batch is in it already.

    Of a key's rows, the table's among them, the one with the greatest ``order`` stays; of equal ones that of the batch (of
    several in it, always the same one). A null order is the least. Null keys are keys, equal to each other. ``gone`` names keys
    that go, whatever their order. A batch's rows meet by key before they are dealt by bucket; so a key that fills the batch is
    one row then. Buckets without a row of the batch are neither read nor written. ``buckets`` counts for a new table; it should
    grow with the table's size, a bucket being the least that a version rewrites. One writer at a time: a second one that
    publishes the same version fails.
    """
    spark = rows.sparkSession
    files = _Files(spark, path)
    numbers = _versions(files)
    now = _version(files, numbers[-1]) if numbers else Version(-1, rows.schema.json(), keys, buckets, {}, {})
    if batch is not None and now.batches.get(source, -1) >= batch:
        return False
    if now.keys != keys:
        raise ValueError(f"the table's keys are {now.keys}")
    names = [f.name for f in StructType.fromJson(json.loads(now.schema)).fields]
    bucket = F.pmod(F.xxhash64(*keys), F.lit(now.buckets)).cast("int").alias("__bucket")

    def newest(df: DataFrame) -> DataFrame:
        row = F.struct(*[c for c in df.columns if c not in ("__bucket", "__new", "__gone")])
        rank = F.struct("__gone", F.col(order), "__new", F.xxhash64(row))
        return df.groupBy("__bucket", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.max_by(F.struct(row.alias("row"), "__new", "__gone"), rank).alias("one")).select("__bucket", "one.row.*", "one.__new", "one.__gone")

    fresh = rows.select(*names, bucket, F.lit(True).alias("__new"), F.lit(False).alias("__gone"))
    if gone is not None:
        empty = [gone[n].alias(n) if n in keys else F.lit(None).cast(dict(rows.dtypes)[n]).alias(n) for n in names]
        fresh = fresh.unionByName(gone.select(*empty, bucket, F.lit(True).alias("__new"), F.lit(True).alias("__gone")))
    fresh = newest(fresh)
    touched = [str(r[0]) for r in fresh.select("__bucket").distinct().collect()]  # as many as buckets at most
    if touched:
        old = _rows(spark, path, now, touched).select("*", bucket, F.lit(False).alias("__new"), F.lit(False).alias("__gone"))
        merged = newest(old.unionByName(fresh).repartition("__bucket")).filter(~F.col("__gone"))
        merged.select(*names, F.col("__bucket").alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/{now.number + 1}")
    written = {n.removeprefix("bucket=") for n in files.names(f"data/{now.number + 1}") if n.startswith("bucket=")} if touched else set()
    folders = {b: v for b, v in now.folders.items() if b not in touched} | dict.fromkeys(sorted(written), now.number + 1)
    batches = now.batches | ({source: batch} if batch is not None else {})
    files.publish(json.dumps(vars(Version(now.number + 1, now.schema, keys, now.buckets, folders, batches))), "versions", f"{now.number + 1}.json")
    clear(path, spark)
    return True


def clear(path: str, spark: SparkSession, versions: int = VERSIONS) -> None:
    """Deletes what only versions before the last ``versions`` ones hold."""
    files = _Files(spark, path)
    numbers = _versions(files)
    used = {str(v) for n in numbers[-versions:] for v in _version(files, n).folders.values()}
    for number in numbers[:-versions]:
        files.delete("versions", f"{number}.json")
    for folder in files.names("data"):
        if folder not in used and int(folder) <= numbers[-1]:
            files.delete("data", folder)


def upsert_into(path: str, keys: list[str], order: str, buckets: int = BUCKETS):
    """A function for foreachBatch: ``upsert`` of each batch of the stream, once."""

    def write(batch: DataFrame, number: int) -> None:
        upsert(path, batch, keys, order, batch_source(batch.sparkSession), number, buckets=buckets)

    return write
