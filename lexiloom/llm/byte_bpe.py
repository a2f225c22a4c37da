"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Method: backtracking over longest matches. Bytes are mapped to Latin-1 characters for a pyahocorasick automaton, which gives
the longest token at each place of a piece. Tokens are taken longest first; a token may follow another only if BPE would never
merge across their border, a test that undoes their merges in turn and is memoised for each pair. Where no token fits, the last
one is replaced by its next shorter prefix; places without a way on are marked, so the time is linear in the piece. The result
is the one that merging by rank gives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, string_bytes

#: Pieces and pairs that a Python worker keeps at most, and the longest piece (characters) that it keeps; the memory is emptied
#: when full. Together they take about 60 MB at most.
MEMO, LONGEST_KEPT = 150_000, 64
_LONG = 1 << 20


class _Memo(dict):
    def __init__(self, make, most: int | None = None):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.clear()
        value = self.make(key)
        if self.most is None or len(key) <= self.most:
            self[key] = value
        return value


class ByteBpe:
    """Encodes as tiktoken's encode_ordinary does with these ranks and this pattern, and decodes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        names = {raw.decode("latin-1"): rank for raw, rank in ranks.items()}
        self.rank_of = names
        self.bytes_of = {rank: raw for raw, rank in ranks.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int] = {}
        self.fits = _Memo(lambda pair: self._fits(*pair))
        self._learn_merges(sorted(names.items(), key=lambda x: x[1]))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for name, rank in names.items():
            if rank in self.parts:
                self.automaton.add_word(name, len(name))
        self.automaton.make_automaton()
        self.packed = _Memo(self._packed, LONGEST_KEPT)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def _learn_merges(self, ordered: list[tuple[str, int]]) -> None:
        """The last merge of each token. A token of many bytes that no merge yields only ever stands for a whole piece."""
        for name, rank in ordered:
            if len(name) == 1:
                self.parts[rank] = (rank, rank)
                continue
            for cut in range(len(name) - 1, 0, -1):
                left, right = self.rank_of.get(name[:cut]), self.rank_of.get(name[cut:])
                if left is None or right is None or left not in self.parts or right not in self.parts or left >= rank and len(name[:cut]) > 1 or right >= rank and len(name[cut:]) > 1:
                    continue
                if self._fits(left, right):
                    self.parts[rank] = (left, right)
                    self.merged[left, right] = rank
                    break
        for name, rank in ordered:
            for cut in range(len(name) - 1, 0, -1):
                if (left := self.rank_of.get(name[:cut])) in self.parts and left is not None:
                    self.shorter[rank] = left
                    break

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the border between these tokens: no merge across it comes before the merges that made them."""
        bound = 1 << 60
        while True:
            if (across := self.merged.get((left, right))) is not None and across < bound:
                return False
            # undo the later of the two merges; equal tokens merge from the left
            a, b = self.parts[left], self.parts[right]
            whole_left, whole_right = a[0] == left, b[0] == right
            if whole_left and whole_right:
                return True
            if whole_right or not whole_left and left > right:
                bound, left = left, a[1]
            else:
                bound, right = right + 1, b[0]

    def _packed(self, piece: str) -> bytes:
        name = piece.encode().decode("latin-1")
        rank = self.rank_of.get(name)
        ids = [rank] if rank is not None else self._backtrack(name)
        return np.array(ids, "<u4").tobytes()

    def _backtrack(self, name: str) -> list[int]:
        size = len(name)
        longest = [0] * size
        for end, length in self.automaton.iter(name):
            if length > longest[end - length + 1]:
                longest[end - length + 1] = length
        rank_of, bytes_of, shorter, fits = self.rank_of, self.bytes_of, self.shorter, self.fits
        ids: list[int] = []
        dead = bytearray(size + 1)
        at = 0
        token = rank_of[name[: longest[0]]]
        while True:
            end = at + len(bytes_of[token])
            if not dead[end] and (not ids or fits[ids[-1], token]):
                ids.append(token)
                at = end
                if at == size:
                    return ids
                token = rank_of[name[at : at + longest[at]]]
            elif (less := shorter.get(token)) is not None:
                token = less
            else:
                dead[at] = 1
                token = ids.pop()
                at -= len(bytes_of[token])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(text) <= _LONG:
            return b"".join(map(self.packed.__getitem__, self.pattern.findall(text)))
        found = (m.group() for m in self.pattern.finditer(text))  # one list of all pieces would take many times the text
        parts = []
        while some := list(islice(found, 1 << 16)):
            parts.append(b"".join(map(self.packed.__getitem__, some)))
        return b"".join(parts)

    def decode(self, packed: bytes) -> bytes:
        ids, look = np.frombuffer(packed, "<u4"), self.bytes_of.__getitem__
        return b"".join(b"".join(map(look, ids[at : at + (1 << 16)].tolist())) for at in range(0, len(ids), 1 << 16))


_loaded: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    """The encoder of a file, once for each Python process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe.from_file(path, pattern)
    return _loaded[path, pattern]


def _rows(path: str, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for part in slices(batch):
                data, offsets = string_bytes(part.column("text"))
                raw, at, out, ids = data.tobytes(), offsets.tolist(), [], []
                for a, b in zip(at[:-1], at[1:], strict=True):
                    packed = bpe.encode(raw[a:b].decode())
                    out.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(packed)).hexdigest()))
                    if with_ids:
                        ids.append(np.frombuffer(packed, "<i4"))
                n, own, back = zip(*out, strict=True)
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(own), pa.array(back)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return run


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Token ids of whole texts: doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 (of the bytes that the ids decode to) and ids.

    Each match of ``pattern`` is encoded by itself, as tiktoken does; no special tokens. Null is empty: 0 tokens and the digest
    of nothing. One row for each input row, equal rows alike; extra columns are ignored. ``path`` is a file of ranks that every
    executor can open, as installed packages are.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_rows(path, pattern, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def _decoded(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            raw = [bpe.decode(np.asarray(x or (), "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return run


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of the column ids; null and empty ids are no bytes; an id outside the vocabulary is an error."""
    return ids.select(F.col("doc_id").cast("long"), "ids").mapInArrow(_decoded(path, pattern), "doc_id long, bytes binary")
