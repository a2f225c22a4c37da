"""Removal of word passages that occur more than once in a corpus.

Method: recompression. Words are symbols; rounds replace runs of one symbol and then pairs (x, y) with x of the left and y of
the right class by a new symbol. A class and a new name are functions of the symbols' content alone, so the naming is global:
every task gives equal substrings equal interior symbols, and no exchange is needed to agree on names. Each symbol carries its
context, the words that decided it. A window is anchored at a symbol whose context lies inside the window, chosen by content
only; equal windows so have equal anchors at equal offsets.

Spark counts the anchors of the whole corpus. Only windows at anchors that occur twice are candidates; these are hashed whole
(96 bits) and counted in the same way, which verifies each of them. Copies of one text are verified as one. So no exchange
names the symbols, and hashes of whole windows, not shared symbols, are what verifies a repeat.

Rows are told apart by doc_id and a hash of the text. A key that occurs twice in a batch is known to repeat: its places don't go
to the key's task but are dealt out, and the key's task gets an empty mark from that batch. So a key with a third of all places
brings its task one small row for each batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark_tools import checkpointed, join_spread
from .words import Spans, Words, mix, slices

WINDOW = 35
#: Rounds, the longest symbol (words) and the widest context of an anchor (share of the window).
ROUNDS = ("runs", *["pairs"] * 5)
_SHIFT = 26
#: Longer texts (bytes) are parsed in pieces that overlap by a window.
PIECE = 1 << 22
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


class _Level:
    """Symbols of one level in text order: name, words [start, end), context [left, right), text."""

    __slots__ = ("end", "left", "name", "right", "start", "text")

    def __init__(self, name, start, end, left, right, text):
        self.name, self.start, self.end, self.left, self.right, self.text = name, start, end, left, right, text


def _neighbours(level: _Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether the next symbol is of the same text; the contexts' limits if a symbol's fate hangs on its left or right neighbour.

    A neighbour that doesn't exist might exist at another place: the limit then lies outside the text.
    """
    n = len(level.name)
    same = np.zeros(n, bool)
    same[:-1] = level.text[:-1] == level.text[1:]
    left, right = level.start - 1, level.end + 1
    left[1:] = np.where(same[:-1], level.left[:-1], left[1:])
    right[:-1] = np.where(same[:-1], level.right[1:], right[:-1])
    return same, left, right


def _runs(level: _Level, number: int) -> _Level:
    same, left, right = _neighbours(level)
    joined = same.copy()
    joined[:-1] &= level.name[:-1] == level.name[1:]
    head = np.ones(len(joined), bool)
    head[1:] = ~joined[:-1]
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(head)) - 1
    times = (last - first + 1).astype(np.uint64)
    name = level.name[first]
    name = np.where(times > 1, mix(name * np.uint64(31) + times, number), name)
    return _Level(name, level.start[first], level.end[last], left[first], right[last], level.text[first])


def _pairs(level: _Level, number: int, longest: int) -> _Level:
    same, left, right = _neighbours(level)
    is_left = (mix(level.name, 1000 + number) & np.uint64(1)) == 0
    pair = same.copy()
    pair[:-1] &= is_left[:-1] & ~is_left[1:] & (level.end[1:] - level.start[:-1] <= longest)
    second = np.zeros(len(pair), bool)
    second[1:] = pair[:-1]
    keep = np.flatnonzero(~second)
    paired = pair[keep]
    other = np.minimum(keep + 1, len(pair) - 1)
    name = level.name[keep]
    name = np.where(paired, mix(name * np.uint64(0x8CB92BA72F3D8DD7) + level.name[other], number), name)
    alone_left = np.where(is_left[keep], level.left[keep], left[keep])
    alone_right = np.where(is_left[keep], right[keep], level.right[keep])
    return _Level(
        name,
        level.start[keep],
        np.where(paired, level.end[other], level.end[keep]),
        np.where(paired, level.left[keep], alone_left),
        np.where(paired, level.right[other], alone_right),
        level.text[keep],
    )


def _levels(hashes: np.ndarray, text: np.ndarray, window: int) -> list[_Level]:
    at = np.arange(len(hashes))
    levels = [_Level(hashes, at, at + 1, at.copy(), at + 1, text)]
    for number, kind in enumerate(ROUNDS, 1):
        below = levels[-1]
        levels.append(_runs(below, number) if kind == "runs" else _pairs(below, number, max(2, window // 2)))
    return levels


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The index of the least of values[low:high] for each range (none empty), by doubling."""
    table = [np.arange(len(values))]
    width = high - low
    while 2 << (len(table) - 1) <= int(width.max()):
        below, half = table[-1], 1 << (len(table) - 1)
        a, b = below[:-half], below[half:]
        table.append(np.where(values[b] < values[a], b, a))
    out = np.empty(len(low), np.int64)
    step = np.frexp(width.astype(np.float64))[1] - 1
    for k, row in enumerate(table):
        own = np.flatnonzero(step == k)
        a, b = row[low[own]], row[high[own] - (1 << k)]
        out[own] = np.where(values[b] < values[a], b, a)
    return out


def anchors(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For runs of windows with one anchor: the anchor's key, the first window (a word's index) and the number of windows.

    Each window of each text is in one run. The anchor is taken from the highest level that has a symbol with its context in
    the window and of half the window's length at most, the longest symbol first.
    """
    if not len(words.starts):
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    hashes = words.hashes()
    spans = Spans(hashes)
    ok = np.zeros(len(hashes), bool)
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        ok[a : max(a, b - window + 1)] = True
    todo = np.flatnonzero(ok)
    chosen = np.zeros(len(hashes), np.uint64)
    place = np.full(len(hashes), -1, np.int64)
    for number, level in reversed(list(enumerate(_levels(hashes, words.text_of(), window)))):
        if not len(todo):
            break
        fit = (level.right - level.left <= max(1, (window * 3) // 5)) & (level.left >= words.first[level.text]) & (level.right <= words.first[level.text + 1])
        left, right = level.left[fit], level.right[fit]
        if not len(left):
            continue
        keys = spans.hash(left, right)
        length = np.minimum(level.end[fit] - level.start[fit], 255).astype(np.uint64)
        rank = ((np.uint64(255) - length) << np.uint64(56)) | (keys >> np.uint64(8))
        low, high = np.searchsorted(left, todo), np.searchsorted(right, todo + window, "right")
        found = low < high
        got = todo[found]
        if len(got):
            best = _least(rank, low[found], high[found])
            chosen[got] = mix(keys[best], 500 + number)
            place[got] = left[best]
        todo = todo[~found]
    at = np.flatnonzero(ok)
    if not len(at):
        return np.empty(0, np.uint64), at, at
    where = place[at]  # an anchor's place names it; windows at one place are of one text
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (where[1:] != where[:-1]) | (chosen[at[1:]] != chosen[at[:-1]])
    key = chosen[at]
    first = np.flatnonzero(new)
    return key[first], at[first], np.diff(np.append(first, len(at)))


def _pieces(batch: pa.RecordBatch, window: int, most: int) -> Iterator[tuple[Words, np.ndarray, int]]:
    """Words of slices of the batch, the batch's row for each text of the slice, and the place of its first word in its text.

    Texts of over ``most`` bytes come in pieces: every window lies in one, and in one only.
    """
    row = 0
    for part in slices(batch):
        texts = part.column("text")
        if part.num_rows > 1 or texts.nbytes <= most:
            yield Words(texts), np.arange(row, row + part.num_rows), 0
        else:
            raw, at, base = texts[0].as_buffer().to_pybytes(), 0, 0
            while at < len(raw):
                space = _SPACE.search(raw, at + most)
                end = space.start() if space else len(raw)
                words = Words(pa.array([raw[at:end].decode()]))
                yield words, np.array([row]), base
                if end == len(raw):
                    break
                # the next piece begins with the words that windows of this one don't start at
                on = max(0, len(words.starts) - window + 1)
                at, base = (at + int(words.starts[on]), base + on) if on else (at, base)
                if not on:  # few, very long words: a larger piece
                    most *= 2
        row += part.num_rows


def _combined(keys: list[np.ndarray], entries: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """A row for each key with its entries (rows of ``entries``) one after another, dealt by key and salt.

    A key with one entry has salt 0, where entries of other batches meet it. One with more is known to repeat: its entries take
    a salt of their own, and a row without entries stands for them at salt 0.
    """
    order = np.lexsort(keys[::-1])
    keys, entries = [k[order] for k in keys], entries[order]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(order)))
    again = np.flatnonzero(size > 1)
    own = (mix(entries[first[again]].view(np.uint64).sum(axis=1)) >> np.uint64(34)).astype(np.int32) + 1
    salt = np.zeros(len(first) + len(again), np.int32)
    salt[again] = own
    which = np.concatenate([first, first[again]])
    width = entries.shape[1]
    offsets = np.concatenate([np.append(first, len(order)) * width, np.full(len(again), len(order) * width)])
    columns = [pa.array(k[which].view(np.int64 if k.dtype.itemsize == 8 else np.int32)) for k in keys]
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(entries.reshape(-1)))
    return pa.RecordBatch.from_arrays([*columns, pa.array(salt), lists], [*names, "salt", "entries"])


def _identity(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return batch.column("doc").to_numpy(zero_copy_only=False), batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)


def _anchor_rows(window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, mark = _identity(batch)
            keys, entries = [np.empty(0, np.uint64)], [np.empty((0, 3), np.int64)]
            for words, row, base in _pieces(batch, window, most):
                key, first, count = anchors(words, window)
                if len(key):
                    text = words.text_of()[first]
                    own = row[text]
                    keys.append(key)
                    entries.append(np.stack([doc[own], mark[own], ((base + first - words.first[text]) << _SHIFT) | count], axis=1))
            key = np.concatenate(keys)
            if len(key):
                yield _combined([key], np.concatenate(entries), ["key"])

    return run


def _window_rows(window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("places").is_valid())
            if not batch.num_rows:
                continue
            doc, mark = _identity(batch)
            lists = batch.column("places")
            runs = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.int64)
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            runs, owner = (x[0] for x in np.split(np.unique(np.stack([runs, owner]), axis=1), 2))  # equal rows list their places twice
            count = runs & ((1 << _SHIFT) - 1)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            owner, place = np.repeat(owner, count), np.repeat(runs >> _SHIFT, count) + inner
            keys, others, entries = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)], [np.empty((0, 2), np.int64)]
            order = np.lexsort((place, owner))
            owner, place = owner[order], place[order]
            for words, row, base in _pieces(batch, window, most):
                mine = slice(*np.searchsorted(owner, [row[0], row[-1] + 1]))
                own, at = owner[mine] - row[0], place[mine] - base
                # windows of this piece; none reaches beyond its text
                inside = (at >= 0) & (at + window <= words.counts[own])
                own, at = own[inside], at[inside]
                spans = Spans(words.hashes())
                start = words.first[own] + at
                keys.append(spans.hash(start, start + window))
                others.append((spans.hash(start, start + window, 1) >> np.uint64(32)).astype(np.uint32))
                rows = row[own]
                entries.append(np.stack([doc[rows], (mark[rows] << 32) | (at + base)], axis=1))
            key = np.concatenate(keys)
            if len(key):
                yield _combined([key, np.concatenate(others)], np.concatenate(entries), ["key", "other"])

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, whole, places in zip(*(batch.column(c) for c in ("doc_id", "text", "whole", "places")), strict=True):
                words = text.as_py().encode().split()
                hit = np.zeros(len(words) + 1, np.int64)
                if whole.as_py() and len(words) >= window:
                    hit[0] += 1
                elif places.is_valid:
                    place = np.asarray(places.values.to_numpy(zero_copy_only=False))
                    place = place[place + window <= len(words)]
                    np.add.at(hit, place, 1)
                    np.add.at(hit, place + window, -1)
                gone = np.cumsum(hit[:-1]) > 0
                kept = [w for w, x in zip(words, gone.tolist(), strict=True) if not x] if gone.any() else words
                out.append((doc.as_py(), len(words), len(words) - len(kept), b" ".join(kept)))
            doc, n, removed, kept = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _repeated(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The entries (columns of the array x) whose key has two or more; a row without entries stands for two at least."""
    n = F.when(F.size("entries") > 0, F.size("entries") / width).otherwise(2)
    found = rows.withColumn("total", F.sum(n).over(Window.partitionBy(*keys, "salt"))).filter((F.col("total") > 1) & (F.size("entries") > 0))
    starts = F.sequence(F.lit(1), F.size("entries"), F.lit(width))
    return found.select(F.explode(F.transform(starts, lambda i: F.slice("entries", i, F.lit(width)))).alias("x"))


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, and doc and mark, which tell rows apart: the id and a hash of the text; two hashes of it where the id is null."""
    text, none = F.coalesce("text", F.lit("")), F.col("doc_id").isNull()
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("doc"), F.hash(text, none).alias("mark"), text.alias("text"))


def repeated_windows(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(doc, mark, places): starts of windows that occur again; and (doc, mark, spare) of texts that occur again as a whole.

    Windows of the latter aren't among the former, but for those of one text of each group, which isn't spare.
    """
    texts = _texts(docs)
    named = checkpointed(texts.select("doc", "mark", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"), F.length("text").alias("c")))
    groups = checkpointed(named.groupBy("a", "b", "c").agg(F.min(F.struct("doc", "mark")).alias("one"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    copies = join_spread(named, groups, ["a", "b", "c"]).select("doc", "mark", (F.struct("doc", "mark") != F.col("one")).alias("spare"))
    whole = copies.groupBy("doc", "mark").agg(F.max("spare").alias("spare"))
    found = _repeated(texts.mapInArrow(_anchor_rows(window, piece), "key long, salt int, entries array<long>"), ["key"], 3)
    found = found.select(F.col("x")[0].alias("doc"), F.col("x")[1].cast("int").alias("mark"), F.col("x")[2].alias("place"))
    listed = found.groupBy("doc", "mark").agg(F.collect_list("place").alias("places")).join(whole.filter("spare").select("doc", "mark"), ["doc", "mark"], "left_anti")
    # a left join, as the last one is, over all columns: so the exchange of the texts is made once for both
    rows = by_doc(texts).join(listed, ["doc", "mark"], "left").mapInArrow(_window_rows(window, piece), "key long, other int, salt int, entries array<long>")
    again = _repeated(rows, ["key", "other"], 2)
    again = again.select(F.col("x")[0].alias("doc"), F.shiftright(F.col("x")[1], 32).cast("int").alias("mark"), F.col("x")[1].bitwiseAND((1 << 32) - 1).cast("int").alias("place"))
    return again.groupBy("doc", "mark").agg(F.collect_list("place").alias("places")), whole


def by_doc(texts: DataFrame) -> DataFrame:
    """The texts dealt by row; the same exchange serves both joins with them."""
    return texts.repartition("doc", "mark")


def substring_dedup(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """Texts without the words of passages that occur again: doc_id, n_words, n_removed, kept (words joined by one space).

    Words are ``[^\\x20\\x09-\\x0D]+``. A word goes if a window of ``window`` consecutive words that covers it has its word
    sequence start anywhere else in the input, in the same text or another; windows are judged on the input.

    Null and empty texts have no words and keep nothing (kept is ""). Texts of fewer words than a window lose nothing. Equal
    texts all lose all their windows: no copy stays, and that holds for equal rows too. Rows are returned one for one, with a
    null or repeated doc_id too. An empty table gives no rows; extra columns are ignored. A text of over ``piece`` bytes is
    parsed in pieces, which take about 100 times their bytes in a task.
    """
    places, whole = repeated_windows(docs, window, piece)
    marks = places.join(whole.withColumn("whole", F.lit(True)).drop("spare"), ["doc", "mark"], "full")
    rows = by_doc(_texts(docs)).join(marks, ["doc", "mark"], "left").withColumn("whole", F.coalesce("whole", F.lit(False)))
    return rows.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept string")


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["anchors", "digest", "repeated_windows", "substring_dedup"]
