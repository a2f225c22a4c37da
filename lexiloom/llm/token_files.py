"""Token ids of a corpus as compact binary files that many readers decode at once.

Method: static range asymmetric numeral system (rANS). The ids of all documents, in ascending order of doc_id, are cut into blocks
of 2**18. One table of frequencies, counted over the whole corpus, serves all blocks, so a block is decoded without any other. In a
block id i belongs to lane i mod 256; the lanes are coders of their own that share one stream of 32-bit words, so that numpy steps
all lanes of several blocks at once. Every 2**16 ids the lanes' states and the place in the stream are noted: a reader may begin at
such a checkpoint. Each block has the checksum of its ids, and that of the table that it was written with.

A folder of ``write_tokens`` has two Parquet tables: ``table`` (id, frequency) and ``blocks`` (start, n, block, pieces): the number of
ids before the block, its ids, its bytes, and which part of which document they are.

    block: "RANS", version, log2 of lanes, log2 of the frequencies' sum, 0 (one byte each); n, words, checkpoints, checksum of the
    ids, checksum of the table (32 bits each); the lanes' states (64 bits each); the place of each checkpoint in the stream (32
    bits each) and its lanes' states; the words. All are little-endian.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from .spark_tools import written
from .words import mix, release, string_bytes

BLOCK, LANES, CHECKPOINT = 1 << 18, 1 << 8, 1 << 16
END = 0
_HEAD = struct.Struct("<4s4B5I")
_MAGIC, _VERSION = b"RANS", 1
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_PIECE = "struct<doc_id: long, doc: long, size: long, at: long, n: long>"

# tokens ----------------------------------------------------------------------------------------------------------------------
#: Bytes of ASCII white space, of marks, and of letters and digits; white space beyond ASCII, as the byte-level pattern has it.
_PLAIN_SPACE, _MARK, _LETTER = (np.zeros(256, bool) for _ in range(3))
_PLAIN_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MARK[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = True
_LETTER[[c for c in range(0x21, 0x7F) if chr(c).isalnum()]] = True
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SHORT, _KNOWN = 16, 1 << 20


class TokenEncoder:
    """Ids as the tokenizers library gives them, for a byte-level model with the usual pattern.

    A text falls apart where ASCII white space follows another character, and where a mark follows an ASCII letter or digit: the
    pattern has no match across such places, and none looks back, so each unit has the same ids alone as in its text. Units are
    told apart by their bytes, at once for a batch of texts; each is encoded by the library once and known from then on, up to a
    bound. Strings of added tokens hold marks: batches that have one fall apart at white space only.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        if any(_PLAIN_SPACE[list(a)].any() for a in self.added):
            raise ValueError("an added token has white space inside")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.ends = np.empty(1 << 16, np.uint32), np.zeros(1, np.int64)

    def _learn(self, units: list[bytes]) -> None:
        found = [x.ids for x in self.library.encode_batch_fast([u.decode() for u in units], add_special_tokens=False)]
        ends = self.ends[-1] + np.cumsum([len(x) for x in found])
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), int(ends[-1]) - len(self.ids)), np.uint32)])
        self.ids[self.ends[-1] : ends[-1]] = np.fromiter((i for x in found for i in x), np.uint32, int(ends[-1] - self.ends[-1]))
        at = len(self.ends) - 1
        self.known.update((u, at + i) for i, u in enumerate(units))
        self.ends = np.concatenate([self.ends, ends])

    def _numbers(self, units: list[bytes]) -> np.ndarray:
        """The places of units in what is known; new ones are learned."""
        if len(self.known) > _KNOWN:
            self._forget()
        found = [*map(self.known.get, units)]
        if None in found:
            self._learn([*dict.fromkeys(u for u, n in zip(units, found, strict=True) if n is None)])
            found = map(self.known.__getitem__, units)
        return np.fromiter(found, np.int64, len(units))

    def encode(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie one after the other in ``raw`` and end at ``ends``, and the ends of theirs."""
        data = np.frombuffer(raw + bytes(_SHORT), np.uint8)
        own = data[:-_SHORT]
        space = _PLAIN_SPACE[own]
        blank = space.copy()
        if any(lead in raw for lead in (b"\xc2", b"\xe1", b"\xe2", b"\xe3")):
            for m in _WIDE_SPACE.finditer(raw):
                blank[m.start() : m.end()] = True
        cut = np.zeros(len(own), bool)
        cut[1:] = space[1:] & ~blank[:-1]
        if not any(a in raw for a in self.added):
            cut[1:] |= _MARK[own[1:]] & _LETTER[own[:-1]]
        firsts = np.concatenate([[0], ends[:-1]])
        cut[firsts[firsts < ends]] = True
        at = np.flatnonzero(cut)
        sizes = np.diff(np.append(at, len(own)))
        number = np.empty(len(at), np.int64)

        # units of up to 16 bytes are two whole numbers; equal ones meet by a hash and are compared in full
        short = np.flatnonzero(sizes <= _SHORT)
        eight = np.ndarray((len(own) + _SHORT - 7,), "<u8", data, 0, (1,))
        low = eight[at[short]] & _MASKS[np.minimum(sizes[short], 8)]
        high = eight[np.minimum(at[short] + 8, len(eight) - 1)] & _MASKS[np.maximum(sizes[short] - 8, 0)]
        hashes = mix(low ^ mix(high, 3), 4)
        of, each = pd.factorize(hashes)
        one = np.empty(len(each), np.int64)
        one[of[::-1]] = np.arange(len(of) - 1, -1, -1)
        same = (low == low[one][of]) & (high == high[one][of]) & (sizes[short] == sizes[short][one][of])
        slices_ = lambda rows: [raw[a : a + n] for a, n in zip(at[rows].tolist(), sizes[rows].tolist(), strict=True)]
        rest = np.concatenate([np.flatnonzero(sizes > _SHORT), short[~same]])
        numbers = self._numbers(slices_(np.concatenate([short[one], rest])))
        number[short], number[rest] = numbers[: len(one)][of], numbers[len(one) :]

        starts, many = self.ends[number], self.ends[number + 1] - self.ends[number]
        done = np.cumsum(many)
        ids = self.ids[np.repeat(starts - (done - many), many) + np.arange(done[-1] if len(done) else 0)]
        return ids, np.append(0, done)[np.searchsorted(at, ends)]

    def encode_all(self, texts: Iterator[bytes], most: int = 1 << 21) -> Iterator[np.ndarray]:
        """The ids of UTF-8 texts, about ``most`` bytes of them at once; a longer text goes by parts that end at white space."""
        held: list[bytes] = []
        size = 0

        def flush() -> Iterator[np.ndarray]:
            ids, ends = self.encode(b"".join(held), np.cumsum([len(t) for t in held], dtype=np.int64))
            yield from np.split(ids, ends[:-1]) if held else []
            held.clear()

        for text in texts:
            if len(text) > 2 * most:
                yield from flush()
                size = 0
                yield np.concatenate([ids for part in _parts(text, most) for ids in self.encode_all(iter([part]), len(part))])
                continue
            held.append(text)
            size += len(text)
            if size >= most:
                yield from flush()
                size = 0
        yield from flush()


_CUT = re.compile(rb"(?<=[!-~])[\t-\r ]")


def _parts(text: bytes, most: int) -> Iterator[bytes]:
    """A text in parts of ``most`` bytes and what follows up to white space after a printable ASCII character."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + most) if len(text) - at > most else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


_encoders: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    """The encoder of a file, once for each Python process."""
    if path not in _encoders:
        _encoders[path] = TokenEncoder(path)
    return _encoders[path]


# coder -----------------------------------------------------------------------------------------------------------------------
class Table:
    """Frequencies of ids that add up to 2**scale, each id that occurs with 1 at least."""

    def __init__(self, ids: np.ndarray, frequencies: np.ndarray):
        order = np.argsort(ids)
        self.ids, self.each = ids[order].astype(np.uint32), frequencies[order].astype(np.uint64)
        self.scale = int(self.each.sum()).bit_length() - 1 if len(ids) else 0
        top = int(self.ids[-1]) + 1 if len(ids) else 0
        self.frequency, self.before = np.zeros(top, np.uint64), np.zeros(top, np.uint64)
        self.frequency[self.ids] = self.each
        self.before[self.ids] = np.cumsum(self.each) - self.each
        self.of_slot = np.repeat(self.ids, self.each.astype(np.int64))
        self.crc = zlib.crc32(self.each.tobytes(), zlib.crc32(self.ids.tobytes()))

    @staticmethod
    def counted(ids: list[int], counts: list[int]) -> Table:
        """Of the counts of a corpus: in proportion to them, up to what the least frequency of 1 takes."""
        scale = max(16, len(ids).bit_length() + 4)
        total, full = sum(counts), 1 << scale
        each = np.array([max(1, c * full // total) for c in counts], np.int64)
        rest = full - int(each.sum())
        order = np.argsort(-each, kind="stable")
        at = 0
        while rest:  # the largest ones give or take what is left, in turn
            k = order[at % len(order)]
            step = max(rest, (1 - int(each[k])) // 2) if rest < 0 else rest
            each[k] += step
            rest -= step
            at += 1
        return Table(np.array(ids, np.int64), each)


def encode_blocks(ids: np.ndarray, table: Table) -> list[bytes]:
    """Blocks, a row of ids each, as bytes."""
    many, n = ids.shape
    steps, shift = -(-n // LANES), np.uint64(63 - table.scale)
    scale = np.uint64(table.scale)
    state = np.full((many, LANES), _LOW)
    words, out = np.zeros((steps, many, LANES), np.uint32), np.zeros((steps, many, LANES), bool)
    every, noted = CHECKPOINT // LANES, []
    for t in range(steps - 1, -1, -1):
        part = ids[:, t * LANES : (t + 1) * LANES]
        k = part.shape[1]
        x, f = state[:, :k], table.frequency[part]
        over = x >= (f << shift)
        words[t, :, :k], out[t, :, :k] = x & np.uint64(0xFFFFFFFF), over
        x = np.where(over, x >> _WORD, x)
        q = x // f
        state[:, :k] = (q << scale) + (x - q * f) + table.before[part]
        if t and t % every == 0:
            noted.append((t, state.copy()))
    noted.reverse()
    blocks = []
    for b in range(many):
        stream = words[:, b][out[:, b]].astype("<u4")
        ends = np.cumsum(out[:, b].sum(1))
        head = _HEAD.pack(_MAGIC, _VERSION, LANES.bit_length() - 1, table.scale, 0, n, len(stream), len(noted), zlib.crc32(ids[b].astype("<u4").tobytes()), table.crc)
        places = np.array([ends[t - 1] for t, _ in noted], "<u4").tobytes()
        blocks.append(b"".join([head, state[b].astype("<u8").tobytes(), places, *(s[b].astype("<u8").tobytes() for _, s in noted), stream.tobytes()]))
    return blocks


class _Block:
    def __init__(self, raw: bytes, table: Table):
        magic, version, lanes, scale, _, self.n, words, self.noted, self.crc, crc = _HEAD.unpack_from(raw)
        if magic != _MAGIC or version != _VERSION or lanes != LANES.bit_length() - 1:
            raise ValueError("not a block of this format")
        if crc != table.crc or scale != table.scale:
            raise ValueError("the block was written with another table")
        at = _HEAD.size
        self.state = np.frombuffer(raw, "<u8", LANES, at)
        at += 8 * LANES
        self.places = np.frombuffer(raw, "<u4", self.noted, at)
        at += 4 * self.noted
        self.states = np.frombuffer(raw, "<u8", LANES * self.noted, at).reshape(-1, LANES)
        self.words = np.frombuffer(raw, "<u4", words, at + 8 * LANES * self.noted)


def _decoded(states: np.ndarray, streams: list[np.ndarray], n: int, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """n ids of each of several streams from their states on, and the states after them."""
    many = len(states)
    state, stream = states.astype(np.uint64), np.concatenate([*streams, np.zeros(1, np.uint32)])
    place = (np.cumsum([len(s) for s in streams]) - [len(s) for s in streams])[:, None]
    out = np.empty((many, n), np.uint32)
    mask, scale = np.uint64((1 << table.scale) - 1), np.uint64(table.scale)
    for t in range(-(-n // LANES)):
        k = min(LANES, n - t * LANES)
        x = state[:, :k]
        slot = x & mask
        found = table.of_slot[slot]
        out[:, t * LANES : t * LANES + k] = found
        x = table.frequency[found] * (x >> scale) + slot - table.before[found]
        low = x < _LOW
        taken = np.cumsum(low, 1)
        word = stream[np.minimum(place + taken - 1, len(stream) - 1)]
        state[:, :k] = np.where(low, x << _WORD | word, x)
        place = place + taken[:, -1:]
    return out, state


def decode_blocks(raws: list[bytes], table: Table) -> list[np.ndarray]:
    """The ids of blocks, those of one length together; a checksum that differs is an error."""
    blocks = [_Block(r, table) for r in raws]
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(blocks)
    for n in {b.n for b in blocks}:
        same = [i for i, b in enumerate(blocks) if b.n == n]
        for i, ids, state in zip(same, *_decoded(np.stack([blocks[i].state for i in same]), [blocks[i].words for i in same], n, table), strict=True):
            if zlib.crc32(ids.astype("<u4").tobytes()) != blocks[i].crc or (state != _LOW).any():
                raise ValueError("a block's checksum differs, or its words don't end where they should")
            out[i] = ids
    return out


def decode_between(raw: bytes, start: int, end: int, table: Table) -> np.ndarray:
    """The ids from start to end of one block, read from the last checkpoint before them on."""
    block = _Block(raw, table)
    end = min(end, block.n)
    if start >= end:
        return np.empty(0, np.uint32)
    at = min(start // CHECKPOINT, block.noted)
    state, words = (block.states[at - 1], block.words[block.places[at - 1] :]) if at else (block.state, block.words)
    return _decoded(state[None], [words], end - at * CHECKPOINT, table)[0][0, start - at * CHECKPOINT :]


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """The product of two polynomials modulo that of crc32; the highest bit is the constant term."""
    out = 0
    while a:
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def crc_joined(left: int, right: int, size: int) -> int:
    """The crc32 of two byte strings one after the other, from their own and the second one's size."""
    power, square, bits = 0x80000000, 0x40000000, 8 * size
    while bits:
        if bits & 1:
            power = _times(power, square)
        square = _times(square, square)
        bits >>= 1
    return _times(left, power) ^ right


# files -----------------------------------------------------------------------------------------------------------------------
def _packed(ids: np.ndarray) -> bytes:
    """Ids in two bytes each if these do, else in four."""
    return ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else "<u4").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.uint32)


def _cut(path: str, end: int, block: int):
    """Rows of ``block`` ids of a partition's documents, in their order."""

    def row(part: int, number: int, ids: np.ndarray, pieces: list[tuple]) -> pa.RecordBatch:
        names = ("doc_id", "doc", "size", "at", "n")
        made = pa.StructArray.from_arrays([pa.array([p[i] for p in pieces], pa.int64()) for i in range(len(names))], names)
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([number * block]), pa.array([len(ids)], pa.int64()), pa.array([_packed(ids)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), made)],
            ["part", "first", "n", "ids", "pieces"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, part = encoder(path), TaskContext.get().partitionId()
        number, held, open_, doc = 0, [], block, 0
        pieces: list[tuple] = []
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            texts = (data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), library.encode_all(texts), strict=True):
                ids = np.append(ids, np.uint32(end))
                at = 0
                while at < len(ids):
                    some = ids[at : at + open_]
                    held.append(some)
                    pieces.append((doc_id, doc, len(ids), at, len(some)))
                    at, open_ = at + len(some), open_ - len(some)
                    if not open_:
                        yield row(part, number, np.concatenate(held), pieces)
                        number, held, open_, pieces = number + 1, [], block, []
                doc += len(ids)
            release()
        if held:
            yield row(part, number, np.concatenate(held), pieces)

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw, n in zip(batch.column("ids"), batch.column("n").to_pylist(), strict=True):
            own = np.bincount(_unpacked(raw.as_py(), n))
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])


def _table(ids: bytes, frequencies: bytes) -> Table:
    return Table(np.frombuffer(ids, np.int64), np.frombuffer(frequencies, np.int64))


def _coded(ids: bytes, frequencies: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(ids, frequencies)
        for batch in batches:
            each = [_unpacked(x.as_py(), n) for x, n in zip(batch.column("ids"), batch.column("n").to_pylist(), strict=True)]
            raw: list[bytes] = [b""] * len(each)
            for n in {len(x) for x in each}:
                same = [i for i, x in enumerate(each) if len(x) == n]
                for i, block in zip(same, encode_blocks(np.stack([each[i] for i in same]), table), strict=True):
                    raw[i] = block
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("start", "n")), pa.array(raw, pa.binary()), batch.column("pieces")], ["start", "n", "block", "pieces"])
            release()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int = END, block: int = BLOCK) -> None:
    """Writes the ids of all texts, each followed by ``end``, in ascending order of doc_id to the folder ``path``.

    Null texts are empty: the end id only. Null doc_ids come first; rows of one doc_id are in the order of a hash of their texts, and
    equal ones follow one another. An empty table gives a folder without blocks. Other columns are ignored.

    Texts are dealt by ranges of (doc_id, hash, row), so no key is too large for a task. The table of frequencies has at most a
    row for each id of the vocabulary; only it meets on the driver. Two numbers of each partition are broadcast.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    mark = [F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")]
    order = ["doc_id", "hash", "row"]
    dealt = texts.select("doc_id", "text", *mark).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = written(dealt.mapInArrow(_cut(tokenizer, end, block), f"part int, first long, n long, ids binary, pieces array<{_PIECE}>"), "ids")

    counts = blocks.select("ids", "n").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy("id").collect()
    table = Table.counted([r["id"] for r in counts], [r["n"] for r in counts]) if counts else Table(np.empty(0, np.int64), np.empty(0, np.int64))
    ids, each = table.ids.astype(np.int64), table.each.astype(np.int64)
    spark.createDataFrame(list(zip(ids.tolist(), each.tolist(), strict=True)), "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")

    # one row of two numbers for each partition
    parts = blocks.groupBy("part").agg(F.sum("n").alias("own"))
    parts = parts.withColumn("before", F.sum("own").over(Window.orderBy("part")) - F.col("own")).drop("own")
    moved = F.transform("pieces", lambda p: p.withField("doc", p["doc"] + F.col("before")))
    placed = blocks.join(F.broadcast(parts), "part").select((F.col("first") + F.col("before")).alias("start"), "n", "ids", moved.alias("pieces"))
    coded = placed.mapInArrow(_coded(ids.tobytes(), each.tobytes()), f"start long, n long, block binary, pieces array<{_PIECE}>")
    coded.write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_table(spark: SparkSession, path: str) -> tuple[bytes, bytes]:
    """The ids and frequencies of a folder's table."""
    rows = spark.read.schema("id long, frequency long").parquet(f"{path}/table").collect()
    return tuple(np.array([r[c] for r in rows], np.int64).tobytes() for c in ("id", "frequency"))


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"start long, n long, block binary, pieces array<{_PIECE}>").parquet(f"{path}/blocks")


def _pieces(table_of: tuple[bytes, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(*table_of)
        for batch in batches:
            for ids, pieces in zip(decode_blocks([x.as_py() for x in batch.column("block")], table), batch.column("pieces"), strict=True):
                pieces = pieces.values
                raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(pieces.field("n").to_numpy())
                parts = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(pieces.field(c) for c in ("doc_id", "doc", "size", "at")), pa.array(parts, pa.binary())], ["doc_id", "doc", "size", "at", "ids"])
            release()

    return run


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """The decoded documents, a row for each block that one is in: doc_id, doc (ids before the document), size (its ids), at (its ids before the piece), ids (32-bit little-endian)."""
    return _blocks(spark, path).select("block", "pieces").mapInArrow(_pieces(read_table(spark, path)), "doc_id long, doc long, size long, at long, ids binary")


def read_between(spark: SparkSession, path: str, start: int, end: int, block: int = BLOCK) -> DataFrame:
    """(start, ids): the corpus's ids from start to end, by block; other blocks are not read, nor these before their checkpoint. block: that of the writer."""
    table_of = read_table(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(*table_of)
        for batch in batches:
            for first, raw in zip(batch.column("start").to_pylist(), batch.column("block"), strict=True):
                low = max(start, first)
                ids = decode_between(raw.as_py(), low - first, end - first, table)
                yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([ids.astype("<u4").tobytes()], pa.binary())], ["start", "ids"])

    # both bounds of the start reach the files' statistics
    wanted = _blocks(spark, path).filter((F.col("start") < end) & (F.col("start") > start - block) & (F.col("start") + F.col("n") > start))
    return wanted.select("start", "block").mapInArrow(run, "start long, ids binary")


def _sums(table_of: tuple[bytes, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(table_of)(batches):
            each = [x.as_buffer() for x in batch.column("ids")]
            crc, n = pa.array([zlib.crc32(x) for x in each], pa.int64()), pa.array([len(x) // 4 for x in each], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "doc", "size", "at")), crc, n], ["doc_id", "doc", "size", "at", "crc", "n"])

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for pieces in batch.column("pieces").to_pylist():
            crc = 0
            for p in pieces:
                crc = crc_joined(crc, p["crc"], 4 * p["n"])
            sums.append(crc)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a folder; only documents of several blocks meet again, by their checksums."""
    sums = _blocks(spark, path).select("block", "pieces").mapInArrow(_sums(read_table(spark, path)), "doc_id long, doc long, size long, at long, crc long, n long")
    sums = written(sums, "sums")
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    pieces = F.array_sort(F.collect_list(F.when(F.col("n") < F.col("size"), F.struct("at", "n", "crc"))))
    several = sums.filter("n < size").groupBy("doc_id", F.col("doc").alias("start"), F.col("size").alias("n_tokens")).agg(pieces.alias("pieces"))
    whole = sums.filter("n = size").select("doc_id", F.col("doc").alias("start"), F.col("size").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    return whole.unionByName(several.mapInArrow(_joined, schema))
