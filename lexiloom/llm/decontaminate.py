"""Benchmark decontamination: the words of documents that lie in passages of benchmark items.

Method: prefix-filtered set join. An item's windows of ``WINDOW`` words are sets of shingles (``SHINGLE`` words). A window
occurs in a document only if all its shingles do, so one of them is prefix enough: the rarest by its count over all documents.
Documents join on prefix shingles only; the shingle's position gives the one place where the window can start, the ends of the
text bound it, and the whole window is verified there: by a hash of all its words, then word by word.

While the item side is small (its windows are counted first, ``BROADCAST_WINDOWS``), it is broadcast and documents are read in
place, without an exchange. Beyond that the same join runs as a Spark join on the shingle hash; maps of fixed size, broadcast
before it, keep shingles that no item has from the counts, and shingles that are no window's prefix from the exchange. Both
ways return the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .spark_tools import checkpointed, fresh
from .words import Spans, Words, slices

WINDOW = 10
SHINGLE = 3
#: About 200 bytes each on the driver and in each Python worker.
BROADCAST_WINDOWS = 200_000
#: Bits (as a power of two) of the map of shingles; 4 MB on the driver and in each Python worker, whatever the benchmark's size.
MAP_BITS = 25


def _window_rows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"), symbols=True)
                spans = Spans(words.hashes())
                out = []
                for i, item in enumerate(part.column("item_id").to_pylist()):
                    n, first, own = int(words.counts[i]), int(words.first[i]), words.words(i)
                    size = min(n, window)
                    for at in range(n - size + 1 if n else 0):
                        start = first + at
                        inner = np.arange(start, start + size - min(shingle, size) + 1)
                        parts = spans.hash(inner, inner + min(shingle, size)).view(np.int64).tolist()
                        both = [int(spans.hash(np.array([start]), np.array([start + size]), k).view(np.int64)[0]) for k in (0, 1)]
                        out.append((item, size, b" ".join(own[at : at + size]).decode(), *both, parts))
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                columns = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["item", "size", "words", "hash", "other", "shingles"])

    return run


def windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """The distinct windows: size, words, hash, other (a second hash), shingles (hashes by offset), items (ids as strings, sorted)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = items.mapInArrow(_window_rows(window, shingle), "item string, size int, words string, hash long, other long, shingles array<long>")
    return rows.groupBy("size", "words", "hash", "other", "shingles").agg(F.array_sort(F.collect_set("item")).alias("items"))


class _Index:
    """The windows by prefix shingle, for lookups of many hashes at once."""

    def __init__(self, size, words, both, prefix, offset, items, shingle):
        order = np.argsort(prefix, kind="stable")
        self.prefix, self.offset, self.size = prefix[order], offset[order], size[order]
        self.both = [b[order] for b in both]
        self.words, self.items = [words[i].encode().split(b" ") for i in order], [items[i] for i in order]
        self.width = np.minimum(self.size, shingle)
        self.some = np.zeros(1 << 16, bool)
        self.some[self.prefix >> np.uint64(48)] = True

    def candidates(self, words: Words, spans: Spans) -> tuple[np.ndarray, np.ndarray]:
        """The start (a word's index) and the window of each place where a prefix shingle stands."""
        places, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for width in np.unique(self.width):
            at = np.arange(len(words.starts) - width + 1)
            hashes = spans.hash(at, at + width)
            at = at[self.some[hashes >> np.uint64(48)]]
            low, high = (np.searchsorted(self.prefix, hashes[at], side) for side in ("left", "right"))
            n = high - low
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = self.width[which] == width
            places.append(np.repeat(at, n)[own] - self.offset[which[own]])
            found.append(which[own])
        return np.concatenate(places), np.concatenate(found)


def _verified(words: Words, spans: Spans, start: np.ndarray, size: np.ndarray, both: list[np.ndarray], expected) -> np.ndarray:
    """Which candidates are occurrences; ``expected`` gives the words of one by its position."""
    text = np.clip(np.searchsorted(words.first, start, "right") - 1, 0, len(words.counts) - 1)
    # a start before the text or an end beyond it can't hold the window
    ok = (start >= 0) & (start >= words.first[text]) & (start + size <= words.first[text + 1])
    at = np.flatnonzero(ok)
    for k in (0, 1):
        at = at[spans.hash(start[at], start[at] + size[at], k) == both[k][at]]
    ok = np.zeros(len(start), bool)
    data = words.data
    for i in at.tolist():
        a = int(start[i])
        wanted = expected(i)
        ok[i] = all(data[words.starts[a + k] : words.ends[a + k]].tobytes() == w for k, w in enumerate(wanted))
    return ok


def _result(part: pa.RecordBatch, words: Words, start: np.ndarray, size: np.ndarray, items: list) -> pa.RecordBatch:
    """A row for each text, from the verified occurrences."""
    marks = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, start + size, -1)
    hit = np.append(np.cumsum(marks)[:-1] > 0, False).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(hit)])
    n_hit = sums[words.first[1:]] - sums[words.first[:-1]]
    own: dict[int, set] = {}
    for t, names in zip((np.searchsorted(words.first, start, "right") - 1).tolist(), items, strict=True):
        own.setdefault(t, set()).update(names)
    lists = [sorted(own.get(t, ())) for t in range(part.num_rows)]
    edge = np.diff(np.concatenate([[0], hit[:-1], [0]]))
    opens, closes = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    spans: dict[int, list] = {}
    for a, b in zip(opens.tolist(), closes.tolist(), strict=True):
        while a < b:  # spans that meet at the end of a text are of two texts
            t = int(np.searchsorted(words.first, a, "right")) - 1
            end = min(b, int(words.first[t + 1]))
            spans.setdefault(t, []).append({"start": a - int(words.first[t]), "end": end - int(words.first[t])})
            a = end
    more = [c for c in ("doc_id", "passed") if c in part.schema.names]
    return pa.RecordBatch.from_arrays(
        [*(part.column(c) for c in more), pa.array(words.counts.astype(np.int64)), pa.array(n_hit), pa.array(lists, pa.list_(pa.string())), pa.array([spans.get(t, []) for t in range(part.num_rows)], _ARROW.field("spans").type)],
        [*more, "n_words", "n_hit", "items", "spans"],
    )


_FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def _occurrences(own: _Index, part: pa.RecordBatch) -> pa.RecordBatch:
    words = Words(part.column("text"), symbols=True)
    spans = Spans(words.hashes())
    start, which = own.candidates(words, spans)
    ok = _verified(words, spans, start, own.size[which], [b[which] for b in own.both], lambda i: own.words[which[i]])
    start, which = start[ok], which[ok]
    return _result(part, words, start, own.size[which], [own.items[w] for w in which.tolist()])


def _scan(index):
    """A column function of the text; not deterministic for the optimiser, so that no plan runs it twice for a row."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = index.value
        for texts in batches:
            found = [_occurrences(own, part).to_struct_array() for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]))]
            yield pa.concat_arrays(found) if found else pa.array([], _ARROW)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, _FOUND).asNondeterministic()


def _shingle_hashes(part: pa.RecordBatch, widths: list[int], some: np.ndarray) -> Iterator[tuple[Words, int, np.ndarray, np.ndarray]]:
    """The places and hashes of the shingles of each width that the map ``some`` lets through."""
    words = Words(part.column("text"), symbols=True)
    spans = Spans(words.hashes())
    for width in widths:
        at = np.arange(len(words.starts) - width + 1)
        hashes = spans.hash(at, at + width)
        bit = hashes >> np.uint64(64 - MAP_BITS)
        keep = ((some[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)) != 0
        yield words, width, at[keep], hashes[keep]


def _count_rows(widths: list[int], wanted):
    """Counts of shingle hashes in documents, a row for each hash and batch, of the shingles in a map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes for part in slices(batch) for _, _, _, hashes in _shingle_hashes(part, widths, wanted.value)]
            hashes, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], ["shingle", "n"])

    return run


def _place_rows(widths: list[int], wanted):
    """Places of the shingles in a map: shingle, width, doc, at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                docs = part.column("doc").to_numpy(zero_copy_only=False)
                for words, width, at, hashes in _shingle_hashes(part, widths, wanted.value):
                    own = words.text_of()[at]
                    columns = [pa.array(hashes.view(np.int64)), pa.array(np.full(len(at), width, np.int32)), pa.array(docs[own]), pa.array(at - words.first[own])]
                    yield pa.RecordBatch.from_arrays(columns, ["shingle", "width", "doc", "at"])

    return run


def _map(shingles: DataFrame):
    """A broadcast map with a bit for each value of the long column shingle: 2**MAP_BITS bits at any number of rows."""
    bit = F.shiftrightunsigned("shingle", 64 - MAP_BITS)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    words = shingles.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    some = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    some[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return shingles.sparkSession.sparkContext.broadcast(some)


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words = Words(part.column("text"), symbols=True)
            spans = Spans(words.hashes())
            rows = [(int(words.first[t]) + c["start"], c) for t, own in enumerate(part.column("found").to_pylist()) for c in own or () if 0 <= c["start"] <= words.counts[t] - c["size"]]
            start = np.array([r[0] for r in rows], np.int64)
            size = np.array([r[1]["size"] for r in rows], np.int64)
            both = [np.array([r[1][k] for r in rows], np.int64).view(np.uint64) for k in ("hash", "other")]
            ok = _verified(words, spans, start, size, both, lambda i, r=rows: r[i][1]["words"].encode().split(b" "))
            yield _result(part, words, start[ok], size[ok], [r[1]["items"] for r, x in zip(rows, ok, strict=True) if x])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, broadcast_windows: int = BROADCAST_WINDOWS, passed: Sequence[str] = ()) -> DataFrame:
    """Documents with the benchmark passages they hold: doc_id, n_words, n_hit, items (ids as strings, sorted), spans (of words).

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. A window is ``window`` consecutive words
    of an item; an item of fewer words, but not none, is one window. A word inside any occurrence of a window is hit.

    Null, empty and wordless texts have no words and no hits; such items have no windows. Items that repeat count once by id;
    a null item_id counts as "null". Every document row is returned, with a null or repeated doc_id too; extra columns are
    ignored, but the ``passed`` ones come as the struct passed.
    """
    index = _small_index(docs, benchmark, window, shingle, broadcast_windows)
    if index is not None:
        name = f"{fresh(docs)}found"
        found = docs.withColumn(name, _scan(index)(F.coalesce("text", F.lit(""))))
        more = [F.struct(*passed).alias("passed")] if passed else []
        return found.select(F.col("doc_id").cast("long"), *(F.col(f"{name}.{c}") for c in ("n_words", "n_hit", "items", "spans")), *more)
    return _by_join(docs, benchmark, window, shingle, passed)


def _counts(texts: DataFrame, widths: list[int], shingles: DataFrame) -> DataFrame:
    """(shingle, n) over all documents, of the given shingles and of few others that share a bit with one."""
    return texts.mapInArrow(_count_rows(widths, _map(shingles)), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _small_index(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, most: int):
    """A broadcast index of the benchmark's windows; None if there are more than ``most``."""
    found = windows(benchmark, window, shingle)
    rows = found.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return None
    lists = rows["shingles"].to_pylist()
    sizes = sorted({min(s, shingle) for s in rows["size"].to_pylist()})
    # from Arrow: rows of Python would come by a second pool of Python workers in each executor
    own = docs.sparkSession.createDataFrame(pa.table({"shingle": pa.array(sorted({x for one in lists for x in one}), pa.int64())}))
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    # of the shingles of at most ``most`` windows
    counted = _counts(texts, sizes, own).join(F.broadcast(own), "shingle").toArrow()
    count = dict(zip(counted["shingle"].to_pylist(), counted["n"].to_pylist(), strict=True))
    rarest = [min(range(len(one)), key=lambda i, o=one: (count.get(o[i], 0), o[i], i)) for one in lists]
    prefix = np.array([one[i] for one, i in zip(lists, rarest, strict=True)], np.int64).view(np.uint64)
    both = [rows[c].to_numpy().astype(np.int64).view(np.uint64) for c in ("hash", "other")]
    index = _Index(rows["size"].to_numpy().astype(np.int64), rows["words"].to_pylist(), both, prefix, np.array(rarest, np.int64), rows["items"].to_pylist(), shingle)
    return docs.sparkSession.sparkContext.broadcast(index)


def _by_join(docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, passed: Sequence[str]) -> DataFrame:
    more = [F.struct(*passed).alias("passed")] if passed else []
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *more)
    schema = StructType([StructField("doc_id", LongType()), *(f for f in texts.schema if passed and f.name == "passed"), *StructType.fromDDL(_FOUND)])
    widths = list(range(1, min(window, shingle) + 1))
    each = checkpointed(windows(benchmark, window, shingle).select("size", "words", "hash", "other", "items", F.posexplode("shingles").alias("offset", "shingle")))
    counts = _counts(texts, widths, each.select("shingle"))
    ranked = each.join(counts, "shingle", "left").groupBy("size", "words").agg(
        F.min_by(F.struct("shingle", "offset", "hash", "other", "items"), F.struct(F.coalesce("n", F.lit(0)), "shingle", "offset")).alias("x")
    )
    table = checkpointed(ranked.select("size", "words", "x.*", F.least("size", F.lit(shingle)).alias("width")))
    # rows join by what they hold, so any doc_id will do; rows that are equal, or whose hashes are, share candidates, each verified in each
    keyed = texts.withColumn("doc", F.xxhash64("doc_id", "text"))
    places = keyed.select("doc", "text").mapInArrow(_place_rows(widths, _map(table.select("shingle"))), "shingle long, width int, doc long, at long")
    candidates = places.join(table, ["shingle", "width"]).withColumn("start", F.col("at") - F.col("offset")).filter("start >= 0")
    by_doc = candidates.groupBy("doc").agg(F.collect_set(F.struct("start", "size", "words", "hash", "other", "items")).alias("found"))
    return keyed.join(by_doc, "doc", "left").select(*texts.columns, "found").mapInArrow(_verify_rows, schema).select("doc_id", "n_words", "n_hit", "items", "spans", *["passed"] * bool(passed))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents without a hit; the columns are those of docs.

    With a broadcast index rows are decided where they are read. Else they go by doc_id and two hashes of the text, so that a
    null or repeated doc_id does no harm: equal texts have equal hits.
    """
    index, p = _small_index(docs, benchmark, WINDOW, SHINGLE, broadcast_windows), fresh(docs)
    if index is not None:
        return docs.withColumn(f"{p}found", _scan(index)(F.coalesce("text", F.lit("")))).filter(f"{p}found.n_hit = 0").select(*docs.columns)
    a, b = f"{p}text_a", f"{p}text_b"
    named = docs.withColumns({a: F.xxhash64("text"), b: F.xxhash64(F.lit(1), "text")})
    found = _by_join(named, benchmark, WINDOW, SHINGLE, [a, b])
    hit = found.filter("n_hit > 0").select(F.col("doc_id").alias(f"{p}doc"), F.col(f"passed.{a}").alias(f"{p}a"), F.col(f"passed.{b}").alias(f"{p}b"))
    same = named["doc_id"].cast("long").eqNullSafe(hit[f"{p}doc"]) & (named[a] == hit[f"{p}a"]) & (named[b] == hit[f"{p}b"])
    return named.join(hit, same, "left_anti").select(*docs.columns)
