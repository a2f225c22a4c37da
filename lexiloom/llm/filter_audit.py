"""What each order of a set of filters keeps, removes and costs, for every part of a corpus.

Method: incidence matrix product. A document is one of 2**5 outcomes (a bit for each filter that it fails), so a part is three
histograms over 32 outcomes: all documents, good ones, toxic ones. They are stacked as rows and multiplied by whole-number matrices
of 32 x 600, a column for each of 120 orders and five steps: what is kept, removed, redundant and unique there. Spark makes the
histograms; their size is that of the outcomes, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_tools import checkpointed
from .words import slices, string_bytes

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
OUTCOMES = 1 << len(FILTERS)
STEPS = len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

#: The filters' limits.
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT, SYMBOLS = 200, 50, 2, b"#$%&*|"
_CAPITALS, _CONTINUATION = bytes(range(0x41, 0x5B)), bytes(range(0x80, 0xC0))
_CHUNK = 1 << 20


def matrices() -> dict[str, np.ndarray]:
    """The 32 x 600 matrices; column 5 * i + s is step s of order i, row m the outcome whose failed filters are the bits of m."""
    masks = np.arange(OUTCOMES)
    out = {name: np.zeros((OUTCOMES, len(ORDERS) * STEPS), np.int64) for name in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    for i, order in enumerate(ORDERS):
        before = 0
        for s, letter in enumerate(order):
            bit = 1 << FILTERS.index(letter)
            fails, gone = (masks & bit) > 0, (masks & before) > 0
            column = STEPS * i + s
            out["kept"][:, column] = ~fails & ~gone
            out["removed"][:, column] = fails & ~gone
            out["redundant"][:, column] = fails & gone
            out["unique_fails"][:, column] = masks == bit
            before |= bit
    own = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    for k in range(STEPS):
        out["shapley"][:, own == k] = out["removed"][:, own == k].sum(1, keepdims=True)
    return out


def failures(raw: bytes) -> int:
    """The bits of filters A to D that the text fails; memory is that of its distinct words, as its words are counted in chunks."""
    n, seen, at = 0, set(), 0
    while at < len(raw):
        end = at + _CHUNK
        while end < len(raw) and raw[end] != 0x20 and not 0x09 <= raw[end] <= 0x0D:
            end += 1
        words = raw[at:end].split()  # bytes split at 0x20 and 0x09 to 0x0D, and nowhere else
        n += len(words)
        seen.update(words)
        at = end
    points = len(raw.translate(None, _CONTINUATION))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    symbols = len(raw.translate(None, SYMBOLS)) < len(raw)
    return (n < MIN_WORDS) | (100 * len(seen) < MIN_DISTINCT_PERCENT * n) << 1 | (100 * capitals > MAX_CAPITALS_PERCENT * points) << 2 | symbols << 3


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            data, offsets = string_bytes(part.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            texts = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            fails = pa.array([failures(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), fails, digests], ["doc_id", "part", "fails", "digest"])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = matrices()
    orders = pa.array(np.repeat(ORDERS, STEPS))
    steps = pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS)))
    for batch in batches:
        for i in range(batch.num_rows):
            rows = np.zeros((3, OUTCOMES), np.int64)
            for cell in batch.column("cells")[i].as_py():
                rows[:, cell["fails"]] = cell["n"], cell["good"], cell["toxic"]
            lost = rows @ m["removed"]
            found = {"kept": rows[0] @ m["kept"], "removed": lost[0], "good_lost": lost[1], "toxic_lost": lost[2]}
            found |= {name: rows[0] @ m[name] for name in ("redundant", "unique_fails", "shapley")}
            part = pa.array([batch.column("part")[i].as_py()] * len(orders), pa.string())
            yield pa.RecordBatch.from_arrays([part, orders, steps, *[pa.array(found[c]) for c in COUNTS]], ["part", "filter_order", "step", *COUNTS])


def outcomes(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, fails, n, good, toxic): the histograms, at most 32 rows a part."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    read = texts.mapInArrow(_read, "doc_id long, part string, fails int, digest binary")
    # rows that are alike meet once, with a count; a large group of copies has one key for each of its documents
    met = checkpointed(read.groupBy("digest", "doc_id", "part", "fails").agg(F.count("*").alias("n")))
    first = met.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.groupBy("doc_id").agg(F.coalesce(F.max("good"), F.lit(False)).alias("good"), F.coalesce(F.max("toxic"), F.lit(False)).alias("toxic"))
    known = met.join(first.withColumn("first", F.lit(True)), ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    fails = F.col("fails").bitwiseOR(F.when(copy, 1 << FILTERS.index("E")).otherwise(0))
    good, toxic = (F.sum(F.when(F.col(c), F.col("n")).otherwise(0)) for c in ("good", "toxic"))
    return known.groupBy("part", fails.alias("fails")).agg(F.sum("n").alias("n"), good.alias("good"), toxic.alias("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of five filters in all 120 orders, for each value of the column ``part``.

    The filters fail a text for: A, under 200 words; B, under half of its words distinct; C, over 2 % capitals A-Z; D, a symbol of
    ``#$%&*|``; E, a smaller doc_id with the same text anywhere in the table. Counts: kept after the step; removed by it; redundant
    (fails its filter, removed before); unique_fails (fails no other filter); good_lost and toxic_lost (removed, labelled so);
    shapley (removed by the step's filter, summed over all orders).

    A null text is an empty one, a null part the part ''. Rows that repeat count each; rows of one doc_id and text are no copies
    of each other. A row without a doc_id has no label, is no copy and makes none. Several labels of a doc_id are joined by "any".
    An empty table gives no rows. Other columns are ignored.
    """
    cells = F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return outcomes(docs, labels, part).groupBy("part").agg(cells).mapInArrow(_products, f"part string, filter_order string, step int, {counts}")
