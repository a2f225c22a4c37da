"""Ranks of whole tables and statistics on them, without a window over all rows.

Rows are counted by value first. The counts are dealt into sorted ranges; a range's running totals are its own, and the ranges'
sums, one row for each, give where it starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def average_ranks(rows: DataFrame, column: str) -> DataFrame:
    """(column, rows, avg_rank): each value's number of rows and the mean of the ranks (from 1) that they take; nulls have none."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))
    ordered = checkpointed(counts.repartitionByRange(column).sortWithinPartitions(column).withColumn("__id", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__id", 33))
    sums = ordered.groupBy("__part").agg(F.sum("rows").alias("__sum"))
    # one row for each range: as few as there are partitions
    starts = sums.select("__part", (F.sum("__sum").over(Window.orderBy("__part")) - F.col("__sum")).alias("__start"))
    upto = F.sum("rows").over(Window.partitionBy("__part").orderBy("__id"))
    placed = ordered.join(F.broadcast(starts), "__part").withColumn("__before", F.col("__start") + upto - F.col("rows"))
    return placed.select(column, "rows", (F.col("__before") + (F.col("rows") + 1) / 2).alias("avg_rank"))


def with_average_rank(rows: DataFrame, column: str, name: str = "avg_rank") -> DataFrame:
    return rows.join(average_ranks(rows, column).select(column, F.col("avg_rank").alias(name)), column, "left")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(rho): the correlation of the average ranks of rows that have both values."""
    both = rows.select(x, y).dropna()
    return with_average_rank(with_average_rank(both, x, "__rx"), y, "__ry").agg(F.round(F.corr("__rx", "__ry"), 6).alias("rho"))


def two_samples(rows: DataFrame, value: str, group: Column) -> DataFrame:
    """(n1, n0, u, point_biserial): Mann-Whitney's U of the rows in the group, and the correlation of the group with the value.

    Null values and rows with an unknown group take no part.
    """
    known = rows.select(F.col(value).alias("v"), group.cast("int").alias("g")).dropna()
    ranked = with_average_rank(known, "v")
    one = F.col("g") == 1
    n1 = F.count_if(one)
    return ranked.agg(n1.alias("n1"), F.count_if(~one).alias("n0"), (F.sum(F.when(one, F.col("avg_rank"))) - n1 * (n1 + 1) / 2).alias("u"), F.round(F.corr("g", "v"), 6).alias("point_biserial"))
