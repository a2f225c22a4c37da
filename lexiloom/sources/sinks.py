"""Writers: partitioned tables, CSV manifests, JSON lines with a summary, Markdown and YAML reports of small results."""

from __future__ import annotations

from pathlib import Path

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import ordered_fields

#: Rows that a report or a YAML file holds at most; more is an error, not cut.
REPORT_ROWS = 10_000


def append(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("append").partitionBy(*by).parquet(path)


def replace_partitions(rows: DataFrame, path: str, *by: str) -> None:
    """Overwrites only the partitions that rows has: an idempotent recompute."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def manifest(rows: DataFrame, path: str, fields: list[str]) -> None:
    ordered_fields(rows, fields).write.mode("overwrite").csv(path, header=True)


def jsonl(rows: DataFrame, path: str, *counted: str) -> None:
    """JSON lines, and beside them one row of counts by each of the columns."""
    rows.write.mode("overwrite").json(path)
    counts = [rows.groupBy(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")) for c in counted]
    meta = rows.agg(F.count("*").alias("n")).select(F.lit("all").alias("field"), F.lit(None).cast("string").alias("value"), "n")
    for part in counts:
        meta = meta.unionByName(part)
    meta.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}.meta")


def _few(rows: DataFrame) -> list:
    found = rows.limit(REPORT_ROWS + 1).collect()
    if len(found) > REPORT_ROWS:
        raise ValueError(f"a report holds {REPORT_ROWS} rows at most")
    return found


def markdown(rows: DataFrame) -> str:
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in _few(rows))


def benchmark_yaml(rows: DataFrame, path: str, name: str, language: str) -> None:
    """A benchmark file that reads back as the same rows."""
    sets = [r.asDict(recursive=True) for r in _few(rows)]
    Path(path).write_text(yaml.safe_dump({"name": name, "language": language, "constraint_sets": sets}, allow_unicode=True, sort_keys=False))
    if yaml.safe_load(Path(path).read_text())["constraint_sets"] != sets:
        raise ValueError("the file doesn't read back as it was written")
