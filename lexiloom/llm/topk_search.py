"""Exact top-k search by inner product over integer vectors.

Method: no-random-access aggregation. Candidates are dealt into blocks and tiles, and each tile has a sorted list for every
dimension. A query reads the lists from the end that its weight's sign favours. Its upper bound for a candidate takes what was
read, and for the rest the list's last value read; its lower bound takes the smaller loss of the lists' far ends and of the
product of the unread parts' norms. A candidate whose upper bound is under the bar can't qualify; the bar is the k-th lower
bound, or the k-th score of another tile or block if that is higher. A query stops reading when few can qualify, and their
scores are resolved. The upper bounds of many queries at one depth are one matrix product: positive weights meet
max(value, last value), negative ones min(value, last value).

Spark deals query blocks against candidate blocks. The cells of the first block run before the others and give each query its
bar; within a cell, a tile's scores raise the bar of the next. A cell returns k rows a query, and a window picks the k best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark_tools import checkpointed

K = 5
SCALE = 256
CANDIDATE_BLOCK = 16384
QUERY_BLOCK = 16384
#: Candidates whose lists are sorted and read together, and queries that read them together.
TILE, QUERY_TILE = 4096, 256
#: Depths of the rounds as shares of a list: bounds are looked at after each sixteenth. At the last, all is read and the upper
#: bound is the score.
ROUNDS = (0.5, 0.5625, 0.625, 0.6875, 0.75, 0.8125, 1.0)
#: The share of candidates at which their scores are resolved.
_FEW = 0.05
#: Pairs whose scores are resolved at a time.
_PAIRS = 1 << 15
_LONG = (-(1 << 63), (1 << 63) - 1)


def _best(query: np.ndarray, candidate: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of each query's k best pairs, in order of queries, ties to the smaller id."""
    order = np.lexsort((ids[candidate], ~score, query))
    q = query[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    size = np.diff(np.append(first, len(q)))
    return order[np.arange(len(q)) - np.repeat(first, size) < k]


class _Lists:
    """A tile's sorted lists, and what bounds need at each depth."""

    def __init__(self, x: np.ndarray):
        self.x, self.sorted, self.depths = x, np.sort(x, axis=0), {}

    def at(self, depth: float) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Entries read of each list, the last values from the upper and the lower end, and the candidates' values as bounds see them."""
        if depth not in self.depths:
            n = len(self.x)
            read = int(np.ceil(n * depth))
            up, down = self.sorted[n - read], self.sorted[read - 1]
            self.depths[depth] = read, up, down, np.hstack([np.maximum(self.x, up), np.minimum(self.x, down)])
        return self.depths[depth]

    def lower(self, q: np.ndarray, candidates: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
        """Lower bounds of some candidates of each query: (queries, candidates)."""
        x, q = self.x[candidates], q[:, None, :]
        seen = np.where(q > 0, x >= up, x <= down)
        known, rest = np.where(seen, x * q, 0.0).sum(axis=2), ~seen
        norms = np.sqrt(np.where(rest, x * x, 0.0).sum(axis=2) * np.where(rest, q * q, 0.0).sum(axis=2))
        far = np.where(rest, q * np.where(q > 0, self.sorted[0], self.sorted[-1]), 0.0).sum(axis=2)
        return known + np.maximum(far, -norms * (1 + 1e-9) - 1e-3 * (norms > 0))

    def search(self, q: np.ndarray, own: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Pairs of queries and candidates that can qualify, and the number of list entries read; raises missing bars in place."""
        n, dims = self.x.shape
        both = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
        open_, barless, found, entries = np.arange(len(q)), np.isneginf(bars), [], 0
        for depth in ROUNDS:
            read, up, down, values = self.at(depth)
            upper = both[open_] @ values.T
            mine = np.flatnonzero(own[open_] >= 0)
            upper[mine, own[open_[mine]]] = -np.inf
            fresh = np.flatnonzero(barless[open_])
            if len(fresh) and n > k:  # one of n may be the query's own row
                likely = np.argpartition(upper[fresh], n - k, axis=1)[:, n - k :]
                at = open_[fresh]
                bars[at] = np.maximum(bars[at], self.lower(q[at], likely, up, down).min(axis=1))
            can = upper >= bars[open_, None]
            can[mine, own[open_[mine]]] = False
            stops = (can.sum(axis=1) <= max(k, _FEW * n)) | (depth == ROUNDS[-1])
            a, c = np.nonzero(can[stops])
            found.append((open_[stops][a], c))
            entries += int(stops.sum()) * dims * read
            open_ = open_[~stops]
            if not len(open_):
                break
        a, c = (np.concatenate(x) for x in zip(*found, strict=True))
        return a, c, entries


def search_block(queries: np.ndarray, query_rows: np.ndarray, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int = K, bars: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Each query's k best candidates of one block that reach its bar: positions of queries and candidates, scores, entries read.

    Vectors too large for exact floating point take the plain product in whole numbers; scores beyond a long are its ends.
    """
    dims = max(1, vectors.shape[1])
    bars = np.full(len(queries), -np.inf) if bars is None else bars.astype(np.float64)  # a copy
    large = [np.abs(m.astype(np.float64)).max(axis=1, initial=0) * np.sqrt(dims) >= 2.0**26 for m in (queries, vectors)]
    best = [np.empty(0, np.int64)] * 3
    read = 0

    def merge(a: np.ndarray, c: np.ndarray, score: np.ndarray) -> None:
        merged = [np.concatenate(x) for x in zip(best, (a, c, score), strict=True)]
        keep = _best(*merged, ids, k)
        best[:] = [x[keep] for x in merged]
        last = np.flatnonzero(np.append(best[0][1:] != best[0][:-1], True)) if len(best[0]) else np.empty(0, np.int64)
        full = last[np.diff(np.append(-1, last)) == k]
        bars[best[0][full]] = np.maximum(bars[best[0][full]], best[2][full])

    if large[0].any() or large[1].any():
        whole = vectors.astype(object)
        for i, query in enumerate(queries):
            slow = np.flatnonzero((large[0][i] | large[1]) & (rows != query_rows[i]))
            product = whole[slow] @ query.astype(object) if len(slow) else np.empty(0, object)
            merge(np.full(len(slow), i), slow, np.array([min(max(int(s), _LONG[0]), _LONG[1]) for s in product], np.int64))
    small, asking = np.flatnonzero(~large[1]), np.flatnonzero(~large[0])
    for start in range(0, len(small), TILE):
        tile = small[start : start + TILE]
        lists, place = _Lists(vectors[tile].astype(np.float64)), {row: i for i, row in enumerate(rows[tile].tolist())}
        for first in range(0, len(asking), QUERY_TILE):
            part = asking[first : first + QUERY_TILE]
            q, bar = queries[part].astype(np.float64), bars[part]
            a, c, entries = lists.search(q, np.array([place.get(row, -1) for row in query_rows[part].tolist()], np.int64), bar, k)
            read += entries
            for at in range(0, len(a), _PAIRS):
                i, j = a[at : at + _PAIRS], c[at : at + _PAIRS]
                score = np.einsum("ij,ij->i", q[i], lists.x[j])
                good = score >= bar[i]
                merge(part[i[good]], tile[j[good]], score[good].astype(np.int64))
    return best[0], best[1], best[2], read


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table.column("x").combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


_FOUND = "query_row long, query_id long, vec_id long, score long"


def _cell(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        if not queries.num_rows or not candidates.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_row", "query_id", "vec_id", "score")})
        query_rows, query_ids, rows, ids = (t.column(c).to_numpy() for t in (queries, candidates) for c in ("row", "vec_id"))
        bars = queries.column("bar").to_numpy()
        a, c, score, _ = search_block(_matrix(queries), query_rows, _matrix(candidates), rows, ids, k, bars)
        return pa.table({"query_row": query_rows[a], "query_id": query_ids[a], "vec_id": ids[c], "score": score})

    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row, vec_id, size, x): components floor(scale * x) of the vectors that are not null, not empty and finite.

    Rows are numbered once and written down, so that equal rows stay apart however often a task runs. A component beyond a
    long is the long's end.
    """
    parts = F.transform("embedding", lambda v: v.cast("double"))
    good = F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall(parts, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = checkpointed(vectors.filter(F.coalesce(good, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), "embedding"))
    return rows.select("row", "vec_id", F.size("embedding").alias("size"), F.transform(parts, lambda v: F.floor(v * scale)).alias("x"))


def topk_search(vectors: DataFrame, every: int = 50, k: int = K, scale: int = SCALE, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the query's own, so a row that
    repeats a query's vec_id is a candidate too, and a repeated query is answered once for each row. Vectors that are null,
    empty, or hold null or non-finite components take no part, as do those without a vec_id; vectors of different lengths
    don't meet. A query with fewer than k candidates gets all of them; an empty table gives no rows; components and scores
    beyond a long are the long's ends; extra columns are ignored.
    """
    base = quantised(vectors, scale)
    is_query = F.col("vec_id") % every == 0
    n = base.agg(F.count("*").alias("all"), F.count_if(is_query).alias("queries")).first()
    blocks, query_blocks = -(-n["all"] // candidate_block) or 1, -(-n["queries"] // QUERY_BLOCK) or 1
    block, query_block = F.pmod(F.xxhash64("row"), F.lit(blocks)), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks))
    upto = lambda first, n: F.explode(F.sequence(F.lit(first).cast("long"), F.lit(n - 1).cast("long")))
    candidates = base.select("row", "vec_id", "x", "size", block.alias("block"), upto(0, query_blocks).alias("query_block"))
    queries = base.filter(is_query).select("row", "vec_id", "x", "size", query_block.alias("query_block"))
    cell = ("size", "query_block", "block")

    def search(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        return queries.groupBy(*cell).cogroup(candidates.groupBy(*cell)).applyInArrow(_cell(k), _FOUND)

    none = F.lit(float("-inf"))
    found = search(queries.withColumns({"bar": none, "block": F.lit(0).cast("long")}), candidates.filter("block = 0"))
    if blocks > 1:
        found = checkpointed(found)
        bars = found.groupBy("query_row").agg(F.min("score").cast("double").alias("bar"), F.count("*").alias("n")).filter(F.col("n") == k)
        barred = queries.join(bars, F.col("row") == F.col("query_row"), "left").select(*[F.col(c).alias(c) for c in queries.columns], F.coalesce("bar", none).alias("bar"), upto(1, blocks).alias("block"))
        found = found.union(search(barred, candidates.filter("block > 0")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
