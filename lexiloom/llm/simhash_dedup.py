"""Near-duplicate texts by SimHash fingerprints that differ in few bits.

Method: fuzzy hashing with the perfect binary Golay code (23, 12). A fingerprint has three segments of 22, 21 and 21 bits. If
two fingerprints differ in 4 bits or fewer, some two of the segments differ in 2 bits or fewer together (else each two have 3
or more, and all three 4.5). Two words at distance 2 or less have a common point within 1 bit of both; so each fingerprint
takes as keys, for each two segments, the pairs of codeword indices that its two segments, and these with one bit flipped,
decode to: about 10 keys of 24 bits for each two segments. Fingerprints that link share a key; links are verified.

Equal fingerprints are joined first. In a key's group of up to ``DENSE`` fingerprints one task links each to its neighbours
and returns a forest, never all pairs. The members of larger groups are linked by a way whose cost is linear in their number:
each takes all points within 2 bits of it as keys; fingerprints that share such a point link without a look at pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .spark_tools import checkpointed, join_spread
from .words import slices, string_bytes

SHINGLE = 4
MOST_BITS = 4
SEED = 42
#: Groups of more members take the linear way.
DENSE = 1024
_FEW = 12
_SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x**11 + x**10 + x**6 + x**5 + x**4 + x**2 + 1, a generator of the Golay code.
_GENERATOR = 0xC75
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _syndromes(values: np.ndarray) -> np.ndarray:
    """The remainders of 23-bit polynomials."""
    out = values.copy()
    for bit in range(22, 10, -1):
        out ^= ((out >> bit) & 1) * (_GENERATOR << (bit - 11))
    return out


class _Golay:
    def __init__(self):
        one = 1 << np.arange(23)
        errors = [np.zeros(1, np.int64), one]
        for n in (2, 3):
            errors.append(np.array([sum(x) for x in combinations(one.tolist(), n)]))
        errors = np.concatenate(errors)
        self.error = np.empty(2048, np.int64)
        self.error[_syndromes(errors)] = errors
        self.low = _syndromes(np.arange(1 << 12))
        self.high = _syndromes(np.arange(1 << 11) << 12)

    def index(self, values: np.ndarray) -> np.ndarray:
        """The 12-bit indices of the codewords next to 23-bit words."""
        syndrome = self.low[values & 0xFFF] ^ self.high[values >> 12]
        return (values ^ self.error[syndrome]) >> 11


_golay: list[_Golay] = []


@cache
def codewords() -> np.ndarray:
    """The code as columns of 23 signs: -1 for a bit that is 1; complements lie 2,048 columns apart."""
    words = (np.arange(4096) << 11) ^ _syndromes(np.arange(4096) << 11)
    words = words[words < 1 << 22]
    return (1 - 2 * ((np.append(words, words ^ ((1 << 23) - 1)) >> np.arange(23)[:, None]) & 1)).astype(np.float32)


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of uint64 fingerprints, and the fingerprint's position for each key; no key twice for one fingerprint."""
    if not _golay:
        _golay.append(_Golay())
    near = []
    for start, width in _SEGMENTS:
        segment = ((prints >> np.uint64(start)) & np.uint64((1 << width) - 1)).astype(np.int64)
        near.append(_golay[0].index(segment[:, None] ^ np.concatenate([[0], 1 << np.arange(width)])))
    rows = []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        own = [(k << 24) | (near[i] << 12) | near[j][:, :1], (k << 24) | (near[i][:, :1] << 12) | near[j][:, 1:]]
        keys = np.sort(np.concatenate(own, axis=1), axis=1)
        new = np.ones(keys.shape, bool)
        new[:, 1:] = keys[:, 1:] != keys[:, :-1]
        at = np.nonzero(new)
        rows.append((keys[at], at[0]))
    return np.concatenate([r[0] for r in rows]).astype(np.int32), np.concatenate([r[1] for r in rows])


def fingerprint(text: str | bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of one text (see ``fingerprints``)."""
    raw = text.encode() if isinstance(text, str) else text
    joined = b" ".join(raw.lower().split())  # both for ASCII only, as they are bytes
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(joined))
    if len(starts) > shingle:
        starts, ends = starts[: len(starts) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, len(starts), 1 << 16):
        a, b = starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, map(slice, a, b)), repeat(SEED)), np.uint64, len(a))
        for byte, column in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
            counts[byte] += np.bincount(column, minlength=256) @ _BITS
    return int.from_bytes(np.packbits((2 * counts > len(starts)).reshape(-1), bitorder="little").tobytes(), "little")


def _fingerprint_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                data, offsets = string_bytes(part.column("text"))
                raw, at = data.tobytes(), offsets.tolist()
                found = np.fromiter((fingerprint(raw[a:b], shingle) for a, b in zip(at[:-1], at[1:], strict=True)), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print long): SimHash over word shingles, repeats included, of the text with A-Z lower-cased.

    Words are ``[^\\x20\\x09-\\x0D]+``; a shingle's hash is XXH64 (seed 42) of its words joined by a space; a bit is 1 if over
    half the hashes have it. Texts of fewer words than a shingle are one shingle; null and wordless texts have 0.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_fingerprint_rows(shingle), "doc_id long, print long")


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 1 << 15):
            part = prints[at : at + (1 << 15)]
            keys, own = golay_keys(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[own])], ["key", "print"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _dense(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    near = _apart(prints[:, None], prints[None, :]) <= most
    label = np.arange(len(prints))
    while True:
        new = np.where(near, label[None, :], len(prints)).min(axis=1)
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(prints))
    return prints[own], prints[label[own]]


def _link_rows(most: int, dense: int):
    """Links within the groups of one key, of rows sorted by key. Members of a group over ``dense`` come alone (b null)."""

    def groups(keys: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(first, len(keys)))
        few = np.repeat((size <= _FEW) & (size > 1), size)
        k, p = keys[few], prints[few]
        for lag in range(1, _FEW):
            i = np.flatnonzero(k[:-lag] == k[lag:])
            if not len(i):
                break
            i = i[_apart(p[i], p[i + lag]) <= most]
            yield p[i], p[i + lag]
        for at, n in zip(first[size > _FEW], size[size > _FEW], strict=True):
            yield _dense(prints[at : at + n], most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "b"]
        hot = None
        held_k, held_p = np.empty(0, np.int32), np.empty(0, np.int64)
        for batch in _and_end(batches):
            if batch is not None:
                held_k = np.concatenate([held_k, batch.column("key").to_numpy(zero_copy_only=False)])
                held_p = np.concatenate([held_p, batch.column("print").to_numpy(zero_copy_only=False)])
            if not len(held_k):
                continue
            # the last group may go on in the next batch
            last = int(np.searchsorted(held_k, held_k[-1])) if batch is not None else len(held_k)
            k, p = held_k[:last], held_p[:last]
            held_k, held_p = held_k[last:], held_p[last:]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
            size = np.diff(np.append(first, len(k)))
            large = np.repeat((size > dense) | (k[first] == hot if hot is not None else np.zeros(len(first), bool)), size)
            alone = [p[large]]
            if len(held_k) > dense or (len(held_k) and held_k[0] == hot):
                hot = held_k[0]
                alone.append(held_p)
                held_k, held_p = held_k[:0], held_p[:0]
            pairs = list(groups(k[~large], p[~large])) if not large.all() else []
            if pairs:
                a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names)
            one = np.concatenate(alone)
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.nulls(len(one), pa.int64())], names)

    return run


def _and_end(batches):
    yield from batches
    yield None


def _ball_rows(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.uint64(1 << i) for i in range(64)]
        masks = [np.zeros(1, np.uint64)]
        for n in range(1, radius + 1):
            masks.append(np.array([np.bitwise_or.reduce(x) for x in combinations(bits, n)], np.uint64))
        masks = np.concatenate(masks)
        for batch in batches:
            prints = batch.column("print").to_numpy(zero_copy_only=False)
            for at in range(0, len(prints), 64):
                part = prints[at : at + 64]
                points = (part.view(np.uint64)[:, None] ^ masks).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(points.reshape(-1)), pa.array(np.repeat(part, len(masks)))], ["point", "print"])

    return run


def links(prints: DataFrame, most: int = MOST_BITS, dense: int = DENSE) -> DataFrame:
    """(a, b): links that join all fingerprints (column print, distinct) which differ in ``most`` bits or fewer into their components."""
    if most not in (2, 4):
        raise ValueError("the keys and the linear way hold for 2 or 4 differing bits")
    keys = prints.mapInArrow(_key_rows, "key int, print long").repartition("key").sortWithinPartitions("key")
    rows = checkpointed(keys.mapInArrow(_link_rows(most, dense), "a long, b long"))
    found, crowd = rows.dropna(), rows.filter("b is null").select(F.col("a").alias("print")).distinct()
    if crowd.isEmpty():
        return found
    # a point has the members within most/2 bits of it only: 2,081 at most, as the members are distinct
    near = crowd.repartition("print").mapInArrow(_ball_rows(most // 2), "point long, print long")
    least = near.withColumn("least", F.min("print").over(Window.partitionBy("point"))).filter("least <> print")
    return found.union(least.select(F.col("print").alias("a"), F.col("least").alias("b")).distinct())


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_BITS, dense: int = DENSE) -> DataFrame:
    """(doc_id, print, component_id): texts whose fingerprints link directly or over others share a component, named by its least doc_id.

    Null, empty and wordless texts have fingerprint 0 and link like any other. Every row is returned; a doc_id that occurs
    twice is one row each. Rows with a null doc_id are returned with the component of their fingerprint. An empty table gives
    no rows; extra columns are ignored.
    """
    marked = checkpointed(fingerprints(docs, shingle))
    distinct = checkpointed(marked.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("print"), most, dense))
    rooted = distinct.join(roots, distinct["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    rooted = checkpointed(rooted)
    named = checkpointed(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    by_print = checkpointed(join_spread(rooted, named, ["root"]).select("print", "component_id"))
    return join_spread(marked, by_print, ["print"]).select("doc_id", "print", "component_id")
