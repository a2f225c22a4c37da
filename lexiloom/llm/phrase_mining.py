"""Word pairs and longer phrases that occur together more often than their words would by chance.

Method: SPAM-style position bitmaps. A shard numbers the words of some millions of words of text one after the other, with a free
place between pieces. A word is the bitmap of its places, kept as its non-zero blocks of 16 bits. A phrase followed by a word is
the phrase's bitmap shifted by one place, AND the word's; its popcount is the number of times that it occurs in the shard, and the
free places stop it at the borders of pieces. Counts of shards add up.

Spark does this in three rounds: counts of words; counts of pairs of frequent words; then each shard goes depth first from its
frequent pairs to phrases of five words, by steps that are frequent pairs themselves. A phrase is as frequent as its rarest pair at
most, so nothing is lost. In each round a shard deals what it has counted into as many buckets as there are shards, by a hash, as
packed columns: a bucket holds about as much as a shard, sums up, and tells each shard which of its words or pairs are frequent.
Scores, containment and ranks are joins and aggregates over the frequent phrases.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spark_tools import discard, join_spread, shared_folder, written
from .words import mix, release, slices, string_bytes

MIN_COUNT, LONGEST, MOST, SHARE = 100, 5, 2000, 100
#: Places of a shard; it ends with the text that reaches this.
SHARD = 1 << 22
_BITS = 16
_CHUNK = 1 << 19
_HELD = 1 << 20
_SALTS = 64

#: A-Z in lower case, tabs as spaces, the separators of pieces as line feeds.
_TABLE = bytearray(range(256))
_TABLE[0x41:0x5B] = range(0x61, 0x7B)
_TABLE[0x09] = 0x20
for _c in (*b".,;:!?", *range(0x0A, 0x0E)):
    _TABLE[_c] = 0x0A
_TABLE = bytes(_TABLE)
_GAP = 0


class _Numbers(dict):
    """Numbers words as they come; the line feed is the free place, 0, and an empty word is 1."""

    def __init__(self):
        super().__init__({b"\n": _GAP, b"": 1})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Stream:
    """The places of a shard's words of one language."""

    def __init__(self):
        self.numbers, self.parts, self.size = _Numbers(), [], 0

    def add(self, raw: bytes) -> None:
        words = raw.translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
        places = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        places = places[places != 1]
        self.parts += [places, np.zeros(1, np.int32)]
        self.size += len(places) + 1

    def row(self, shard: int, lang: str) -> pa.RecordBatch:
        seq = np.concatenate(self.parts)
        at = np.flatnonzero(seq != _GAP)
        word = seq[at] - 2
        order = np.argsort(word, kind="stable")
        word, at = word[order], at[order]
        blocks, bits, sizes, counts = _packed(word, at, len(self.numbers) - 2)
        words = b"\n".join(list(self.numbers)[2:])
        return pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([lang], pa.string()), pa.array([len(at)], pa.int64()), *(pa.array([x], pa.binary()) for x in (_zip(words), _pack(counts), *map(_planes, (sizes, blocks, bits))))],
            ["shard", "lang", "n", "words", "counts", "sizes", "blocks", "bits"],
        )


def _zip(raw: bytes) -> bytes:
    return struct.pack("<I", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(raw: bytes) -> bytes:
    return pa.decompress(raw[4:], struct.unpack_from("<I", raw)[0], codec="zstd", asbytes=True)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as planes of bytes, compressed; the first one by its differences, so sorted rows take little."""
    first, *rest = (c.astype(np.int64) for c in columns)
    return _zip(b"".join(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in (np.diff(first, prepend=0), *rest)))


def _unpack(raw: bytes, many: int) -> list[np.ndarray]:
    planes = np.frombuffer(_unzip(raw), np.uint8).reshape(many, 8, -1)
    columns = [np.ascontiguousarray(x.T).view(np.int64).ravel() for x in planes]
    return [np.cumsum(columns[0]), *columns[1:]]


def _planes(x: np.ndarray) -> bytes:
    """The bytes of the differences of x, lowest bytes first of all: what is small compresses well."""
    step = np.diff(x, prepend=x.dtype.type(0)) if x.dtype != np.uint16 else x
    return step.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def _unplaned(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    step = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()
    return step if kind == np.uint16 else np.cumsum(step, dtype=kind)


def _packed(word: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
    """Non-zero blocks of n words: block numbers and bits, the number of blocks of each word and of its places."""
    if not len(at):
        return np.empty(0, np.uint32), np.empty(0, np.uint16), np.zeros(n, np.uint32), np.zeros(n, np.int64)
    block = (at // _BITS).astype(np.uint32)
    new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (block[1:] != block[:-1])]))
    bits = np.bitwise_or.reduceat(np.left_shift(1, at % _BITS).astype(np.uint16), new)
    return block[new], bits, np.bincount(word[new], minlength=n).astype(np.uint32), np.bincount(word, minlength=n)


def _shards(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, streams = TaskContext.get().partitionId() << 32, {}
        for batch in batches:
            for part in slices(batch):
                data, offsets = string_bytes(part.column("text"))
                raw, at = data.tobytes(), offsets.tolist()
                for lang, a, b in zip(part.column("lang").to_pylist(), at[:-1], at[1:], strict=True):
                    streams.setdefault(lang, _Stream()).add(raw[a:b])
                if sum(s.size for s in streams.values()) >= most:
                    yield from (s.row(number + i, lang) for i, (lang, s) in enumerate(streams.items()))
                    number, streams = number + len(streams), {}
                    release()
        yield from (s.row(number + i, lang) for i, (lang, s) in enumerate(streams.items()))

    return run


class Shard:
    """The bitmaps of a shard's frequent words, by word and by block."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, blocks: np.ndarray, bits: np.ndarray):
        self.ids, self.blocks, self.bits = ids, blocks, bits
        self.words = np.repeat(np.arange(len(ids)), sizes)
        self.ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        order = np.argsort(blocks, kind="stable")
        self.by_word, self.by_bits = self.words[order], bits[order]
        last = int(blocks.max()) + 3 if len(blocks) else 2
        self.first = np.searchsorted(blocks[order], np.arange(last + 1))

    def extend(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(phrase, word, block, bits) of phrases followed by a word: shifted by one place, AND, if any bit is left."""
        up, over = np.left_shift(bits, 1), np.right_shift(bits, _BITS - 1)
        stays, goes = np.flatnonzero(up), np.flatnonzero(over)
        phrase, block, bits = np.concatenate([phrase[stays], phrase[goes]]), np.concatenate([block[stays], block[goes] + np.uint32(1)]), np.concatenate([up[stays], over[goes]])
        start = self.first[block]
        many = self.first[block + np.uint32(1)] - start
        ends = np.cumsum(many)
        done = 0
        while done < len(many):
            base = ends[done - 1] if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
            own = many[done:stop]
            row = np.repeat(np.arange(done, stop), own)
            other = np.arange(len(row)) - np.repeat(ends[done:stop] - own - base, own) + start[row]
            both = bits[row] & self.by_bits[other]
            kept = np.flatnonzero(both)
            row, other = row[kept], other[kept]
            yield phrase[row], self.by_word[other], block[row], both[kept]
            done = stop

    def pairs(self) -> tuple[np.ndarray, ...]:
        """The words of all pairs and their popcounts."""
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for left, word, _, bits in self.extend(self.words, self.blocks, self.bits):
            key, _, n = _summed(left * len(self.ids) + word, bits)
            keys.append(key)
            counts.append(n)
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(place, np.concatenate(counts), len(key)).astype(np.int64)
        return self.ids[key // max(1, len(self.ids))], self.ids[key % max(1, len(self.ids))], n

    def phrases(self, steps: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Phrases of three words up to ``longest`` as rows of ids, and their popcounts; steps: the allowed pairs as left * words + right, sorted."""
        width, start = len(self.ids), 0
        while start < width:  # depth first: all lengths of the phrases that begin with some words, then the next words
            stop = max(start + 1, int(np.searchsorted(self.ends, self.ends[start] + _CHUNK // 8, "right")) - 1)
            stop = min(stop, width)
            rows = slice(self.ends[start], self.ends[stop])
            spelt, phrase, block, bits = np.arange(start, stop)[:, None], self.words[rows] - start, self.blocks[rows], self.bits[rows]
            for length in range(2, longest + 1):
                found = [(np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint16))]
                for left, word, to, both in self.extend(phrase, block, bits):
                    step = spelt[left, -1] * width + word
                    ok = np.flatnonzero(_among(step, steps))
                    found.append((left[ok] * width + word[ok], to[ok], both[ok]))
                key, block, bits = (np.concatenate(x) for x in zip(*found, strict=True))
                if not len(key):
                    break
                key, phrase, n = _summed(key, bits)
                spelt = np.concatenate([spelt[key // width], (key % width)[:, None]], 1)
                if length > 2:
                    yield self.ids[spelt], n
            start = stop


def _summed(key: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, the place of each row's key among them, and the popcounts by key."""
    keys, place = np.unique(key, return_inverse=True)
    return keys, place, np.bincount(place, np.bitwise_count(bits), len(keys)).astype(np.int64)


def _among(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return table[at] == x


def _parts(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has rows, and these, in their order."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def _bucket(columns: list[np.ndarray], buckets: int) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix(key ^ c.astype(np.uint64), 5)
    return (key % np.uint64(buckets)).astype(np.int64)


def _sums(columns: list[np.ndarray], n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with the same columns whose n add up to ``least``: all rows, the first row of each, its sum."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(n[order], starts)
    often = sums >= least
    return order[np.repeat(often, np.diff(np.append(starts, len(order))))], order[starts[often]], sums[often]


def _deal_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, words, counts in zip(*(batch.column(c).to_pylist() for c in ("shard", "lang", "words", "counts")), strict=True):
                words, counts = _unzip(words).split(b"\n"), _unpack(counts, 1)[0]
                if not len(counts):
                    continue
                seed = zlib.crc32(lang.encode())
                for k, rows in _parts(np.array([zlib.crc32(w, seed) % buckets for w in words], np.int64), buckets):
                    own = _zip(b"\n".join([words[i] for i in rows.tolist()]))
                    yield pa.RecordBatch.from_arrays([*(pa.array([x]) for x in (k, shard, lang)), *(pa.array([x], pa.binary()) for x in (own, _pack(rows, counts[rows])))], ["bucket", "shard", "lang", "words", "places"])

    return run


_WORDS = "shard long, known binary, lang string, id long, word string, f long"


def _often_words(buckets: int, least: int):
    """Frequent words, numbered, and which of them each shard has."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        counts: dict[tuple[str, bytes], int] = {}
        rows = []
        for shard, lang, words, places in zip(*(table.column(c).to_pylist() for c in ("shard", "lang", "words", "places")), strict=True):
            words, (place, n) = _unzip(words).split(b"\n"), _unpack(places, 2)
            rows.append((shard, lang, words, place))
            for w, k in zip(words, n.tolist(), strict=True):
                counts[lang, w] = counts.get((lang, w), 0) + k
        often = sorted(w for w, n in counts.items() if n >= least)
        number = {w: key[0].as_py() + buckets * i for i, w in enumerate(often)}
        out = [{"lang": lang, "id": number[lang, w], "word": w.decode(), "f": counts[lang, w]} for lang, w in often]
        for shard, lang, words, place in rows:
            own = [(number[lang, w], p) for w, p in zip(words, place.tolist(), strict=True) if (lang, w) in number]
            if own:
                out.append({"shard": shard, "known": _pack(*np.array(sorted(own), np.int64).T)})
        return pa.Table.from_pylist(out, pa.schema([("shard", pa.int64()), ("known", pa.binary()), ("lang", pa.string()), ("id", pa.int64()), ("word", pa.string()), ("f", pa.int64())]))

    return run


def _frequent_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmaps of the words that are known as frequent, in the order of their ids."""
    for batch in batches:
        for i in range(batch.num_rows):
            sizes, blocks, bits = (_unplaned(batch.column(c)[i].as_py(), k) for c, k in (("sizes", np.uint32), ("blocks", np.uint32), ("bits", np.uint16)))
            ids, place = (np.concatenate(x) for x in zip(*(_unpack(x, 2) for x in batch.column("known")[i].as_py()), strict=True))
            order = np.argsort(ids)
            ids, place = ids[order], place[order]
            own, starts = sizes[place].astype(np.int64), np.cumsum(sizes.astype(np.int64)) - sizes
            rows = np.repeat(starts[place] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            out = [_planes(x) for x in (ids, sizes[place], blocks[rows], bits[rows])]
            yield pa.RecordBatch.from_arrays([batch.column("shard").slice(i, 1), *(pa.array([x], pa.binary()) for x in out)], ["shard", "ids", "sizes", "blocks", "bits"])
        release()


def _shard(batch: pa.RecordBatch, i: int) -> Shard:
    return Shard(*(_unplaned(batch.column(c)[i].as_py(), k) for c, k in (("ids", np.int64), ("sizes", np.uint32), ("blocks", np.uint32), ("bits", np.uint16))))


def _pairs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = _shard(batch, i).pairs()
                for k, rows in _parts(_bucket(columns[:2], buckets), buckets):
                    yield pa.RecordBatch.from_arrays([pa.array([k]), batch.column("shard").slice(i, 1), pa.array([_pack(*(c[rows] for c in columns))], pa.binary())], ["bucket", "shard", "pairs"])
            release()

    return run


def _often_pairs(least: int):
    """Frequent pairs with their counts, in a row without a shard, and those of each shard."""

    def run(table: pa.Table) -> pa.Table:
        each = [_unpack(x, 3) for x in table.column("pairs").to_pylist()]
        a, b, n = (np.concatenate(x) for x in zip(*each, strict=True))
        of = np.repeat(np.arange(len(each)), [len(x[0]) for x in each])
        rows, first, sums = _sums([a, b], n, least)
        shards, packed = [None], [_pack(a[first], b[first], sums)]
        for k, own in _parts(of[rows], len(each)):
            own = rows[own]
            shards.append(table.column("shard")[k].as_py())
            packed.append(_pack(a[own], b[own]))
        return pa.table([pa.array(shards, pa.int64()), pa.array(packed, pa.binary())], ["shard", "pairs"])

    return run


def _spelt(ids: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
    ends = np.arange(len(n) + 1, dtype=np.int32) * len(ids)
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(np.stack(ids, 1).ravel())), pa.array(n)], ["phrase", "f"])


def _two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("pairs"):
            a, b, n = _unpack(raw.as_py(), 3)
            yield _spelt([a, b], n)


def _phrases(buckets: int, longest: int):
    def rows(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for length, found in held.items():
            ids, n = (np.concatenate(x) for x in zip(*found, strict=True))
            columns = list(ids.T)
            for k, own in _parts(_bucket(columns, buckets), buckets):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([length], pa.int32()), pa.array([_pack(*(c[own] for c in columns), n[own])], pa.binary())], ["bucket", "length", "phrases"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, held, size = _shard(batch, i), {}, 0
                a, b = (np.searchsorted(shard.ids, np.concatenate(x)) for x in zip(*(_unpack(x, 2) for x in batch.column("mine")[i].as_py()), strict=True))
                for ids, n in shard.phrases(np.sort(a * len(shard.ids) + b), longest):
                    held.setdefault(ids.shape[1], []).append((ids, n))
                    size += len(n)
                    if size > _HELD:
                        yield from rows(held)
                        held, size = {}, 0
                yield from rows(held)
            release()

    return run


def _often_phrases(least: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        *columns, n = (np.concatenate(x) for x in zip(*(_unpack(x, key[1].as_py() + 1) for x in table.column("phrases").to_pylist()), strict=True))
        _, first, sums = _sums(columns, n, least)
        return pa.Table.from_batches([_spelt([c[first] for c in columns], sums)])

    return run


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, shard: int = SHARD, lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: (lang, n), the word occurrences; (lang, id, word, f), the frequent words; (phrase, f), the frequent phrases of two words or more as arrays of ids."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    spark = docs.sparkSession
    folders = {name: shared_folder(spark, name) for name in ("shards", "bitmaps", "pairs")}
    shards = written(texts.mapInArrow(_shards(shard), "shard long, lang string, n long, words binary, counts binary, sizes binary, blocks binary, bits binary"), "shards", folders["shards"])
    totals = written(shards.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    buckets = max(8, shards.count())

    dealt = shards.select("shard", "lang", "words", "counts").mapInArrow(_deal_words(buckets), "bucket long, shard long, lang string, words binary, places binary")
    found = written(dealt.groupBy("bucket").applyInArrow(_often_words(buckets, min_count), _WORDS), "words")
    words = found.filter("shard is null").select("lang", "id", "word", "f")
    known = found.filter("shard is not null").groupBy("shard").agg(F.collect_list("known").alias("known"))
    # lists of words and pairs grow with the corpus: these joins are never broadcast
    base = shards.select("shard", "sizes", "blocks", "bits").join(known.hint("merge"), "shard")
    base = written(base.mapInArrow(_frequent_only, "shard long, ids binary, sizes binary, blocks binary, bits binary"), "bitmaps", folders["bitmaps"])
    discard(spark, folders["shards"])

    dealt = base.mapInArrow(_pairs(buckets), "bucket long, shard long, pairs binary")
    pairs = written(dealt.groupBy("bucket").applyInArrow(_often_pairs(min_count), "shard long, pairs binary"), "pairs", folders["pairs"])
    two = pairs.filter("shard is null").select("pairs").mapInArrow(_two, "phrase array<long>, f long")
    mine = pairs.filter("shard is not null").groupBy("shard").agg(F.collect_list("pairs").alias("mine"))
    more = base.join(mine.hint("merge"), "shard").mapInArrow(_phrases(buckets, longest), "bucket long, length int, phrases binary")
    more = more.groupBy("bucket", "length").applyInArrow(_often_phrases(min_count), "phrase array<long>, f long")
    phrases = written(two.union(more), "phrases")
    for name in ("bitmaps", "pairs"):
        discard(spark, folders[name])
    return totals, words, phrases


def phrase_mining(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, most: int = MOST, share: int = SHARE, shard: int = SHARD, lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each language.

    Words are what spaces and tabs separate within a piece, pieces what one of ``.,;:!?`` or U+000A to U+000D separates, with A-Z
    in lower case. n counts a language's words, a the phrase, l and r its two parts at the cut with the least score (the first of
    these); the score is floor(1000 a n / (l r)), exact in decimals of 38 digits (a times n below 10**35). A phrase goes if a longer
    frequent one has it and at least ``share`` per cent of its count. Order: score and a falling, then the phrase by its bytes.

    Null texts are empty, a null language is ``und``. Rows that repeat count each. A text is in one shard whole. An empty table
    gives no rows. Other columns are ignored.
    """
    totals, words, phrases = frequent_phrases(docs, min_count, longest, shard, lang)
    parts = words.select(F.array("id").alias("phrase"), "f", "lang").unionByName(phrases, allowMissingColumns=True)

    cuts = phrases.select("phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.slice("phrase", F.lit(1), F.col("k")), "rest": F.slice("phrase", F.col("k") + 1, F.size("phrase") - F.col("k"))})
    cuts = join_spread(cuts, parts.select(F.col("phrase").alias("first"), F.col("f").alias("l"), "lang"), ["first"]).drop("first")
    cuts = written(join_spread(written(cuts, "cuts"), parts.select(F.col("phrase").alias("rest"), F.col("f").alias("r")), ["rest"]).drop("rest"), "cuts")
    # the language is told by the first word, so by the cut after it
    sizes = join_spread(cuts.filter("k = 1").select("phrase", "lang"), totals, ["lang"])
    wide = "decimal(38,0)"
    score = F.expr(f"(1000 * cast(a AS {wide}) * cast(n AS {wide})) div (cast(l AS {wide}) * cast(r AS {wide}))").cast("long")
    scored = cuts.drop("lang").join(sizes, "phrase").withColumn("score", score)
    least = scored.groupBy("phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("n").alias("n"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("phrase") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size("phrase") - m + 1), lambda at: F.slice("phrase", at, m))))
    held = phrases.filter(F.size("phrase") > 2).select(F.explode(inner).alias("phrase"), "f").groupBy("phrase").agg(F.max("f").alias("most"))
    left = least.join(held, "phrase", "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    left = written(left.select("phrase", "lang", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score")), "scored")

    spelt = join_spread(written(left.select("phrase", F.posexplode("phrase").alias("at", "id")), "places"), words.select("id", "word"), ["id"])
    spelt = spelt.groupBy("phrase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    rows = left.join(spelt, "phrase").select("lang", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")
    # a language's rows meet in one task only after each of its parts is down to the most that can count
    for keys in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))], ["lang"]):
        place = Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a"), "phrase")
        rows = rows.withColumn("rank", F.row_number().over(place).cast("long")).filter(F.col("rank") <= most)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
