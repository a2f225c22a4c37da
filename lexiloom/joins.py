"""Joins that no key is too frequent for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checkpoints import checkpointed

#: Keys with more than one row in so many are heavy; there can't be more heavy keys than this.
HEAVY = 4096


def join_spread(rows: DataFrame, table: DataFrame, on: list[str], most: int = HEAVY) -> DataFrame:
    """The inner join of rows with a table that has one row for each key.

    A key with more than 1/most of all rows is one of ``most`` keys at most, whatever the size of the input: the table's rows
    of these are broadcast, so that theirs stay where they are. The other keys are exchanged, none of them with more than
    1/most of the rows. ``rows`` and ``table`` are read more than once; give what is cheap to read, as a checkpoint is. Nulls
    in keys join nothing.
    """
    n = "_" * max(map(len, on)) + "n"  # longer than the keys' names, so none of them
    counts = rows.groupBy(*on).agg(F.count("*").alias(n))
    heavy = F.broadcast(checkpointed(counts.filter(F.col(n) > rows.count() / most).select(*on)))
    few = F.broadcast(table.join(heavy, on, "left_semi"))
    return rows.join(few, on).unionByName(rows.join(heavy, on, "left_anti").join(table.join(heavy, on, "left_anti"), on))
