"""Connected components of a graph whose links exceed one machine: local forests, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import checkpointed

_CHUNK = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as links from each node to its component's least node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _CHUNK):
            part = batch.slice(at, _CHUNK)
            a, b = forest(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't the least of its component; links have the long columns a and b, in any order.

    No links: no rows. Repeated links, loops and nulls change nothing. The number of rounds is about the logarithm of the
    longest path that the local forests leave; each is checkpointed. A centre's links are pre-aggregated to their least node
    and joined by a join that Spark can split.
    """
    now = checkpointed(links.dropna(subset=["a", "b"]).filter("a <> b").select("a", "b").mapInArrow(_forests, "a long, b long").distinct())
    mark = _mark(now)
    while mark[0]:
        now = checkpointed(_small_star(_large_star(now)))
        was, mark = mark, _mark(now)
        if was == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
