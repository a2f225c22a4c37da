"""Vectorised words and content hashes over Arrow string batches.

All functions work on the UTF-8 bytes of many texts at once. A hash is a polynomial in uint64 arithmetic over random byte
(or word) values, so that the hash of any span comes from two prefix sums; it depends on the content only, never on the task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTE_STEP = 0x9E3779B97F4A7C15
_WORD_STEPS = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased.
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of uint64 that spreads every input bit over all output bits."""
    x = x ^ np.uint64((seed * 0xA24BAED4963EE407 + 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64), 17)


def powers(step: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """step**i and step**-i modulo 2**64 for i below n at least."""
    have = _powers.get(step)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for base in (step, pow(step, -1, 1 << 64)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        have = (both[0], both[1])
        if size <= 4 * SLICE_BYTES:  # the powers for one very long text aren't kept
            _powers[step] = have
    return have


def prefix(values: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(step, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int, seed: int = 0) -> np.ndarray:
    """Content hashes of values[starts:ends], from ``prefix``."""
    return mix((sums[ends] - sums[starts]) * powers(step, len(sums))[1][starts], seed)


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives the system back what a batch took; a Python worker lives as long as its executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of about ``most`` bytes of text; a longer text is a part of its own."""
    column_at = batch.schema.get_field_index(column)
    texts = batch.column(column_at)
    _, offsets = string_bytes(texts)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = max(start + 1, min(end, batch.num_rows))
        yield batch.slice(start, end - start)
        start = end
    release()


class Words:
    """Words of many texts: byte spans, the first word of each text, and a content hash for each word."""

    def __init__(self, texts: pa.Array, symbols: bool = False):
        data, offsets = string_bytes(texts)
        if symbols:
            data = _LOWER[data]
        inside = ~(_SYMBOLS if symbols else _SPACE)[data]
        full = offsets[:-1] < offsets[1:]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[offsets[:-1][full]] = False
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[offsets[1:][full] - 1] = False
        self.data = data
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        sums = prefix(_BYTE_VALUES[self.data], _BYTE_STEP)
        return span_hash(sums, self.starts, self.ends, _BYTE_STEP)

    def text_of(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def words(self, i: int) -> list[bytes]:
        """The words of text i."""
        raw = self.data
        return [raw[a:b].tobytes() for a, b in zip(*(x[self.first[i] : self.first[i + 1]] for x in (self.starts, self.ends)), strict=True)]


class Spans:
    """Content hashes of runs of words; two independent hashes are there for exact grouping."""

    def __init__(self, hashes: np.ndarray):
        self.sums = [prefix(hashes, step) for step in _WORD_STEPS[:1]]
        self.values = hashes

    def hash(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        while len(self.sums) <= which:
            self.sums.append(prefix(mix(self.values, 91), _WORD_STEPS[len(self.sums)]))
        return span_hash(self.sums[which], starts, ends, _WORD_STEPS[which], which)
