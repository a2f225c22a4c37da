"""Near-duplicate texts by the Jaccard similarity of their word shingles.

Method: SimHash and the perfect binary Golay code (23, 12) find candidates, exact sets decide. A text is the set of its
``SHINGLE``-word shingles; equal sets are one from the start. Each set has a wide SimHash: WORDS words of 23 sums of signs. A
word's key is the codeword nearest to its sums, so that a bit counts by how sure it is: two sets at the threshold of 0.8 share
one in 0.26 at least (measured; 0.12 by signs alone). They share no key with a probability of (1 - 0.26)**WORDS = 5e-8, and
differ in over APART of the first BITS signs with 3e-8 at most; both are less above 0.8. Sets of one key are compared by these
signs first. Those that differ in few, directly or over others, are a part. Small parts give pairs. In a larger part every
member first meets one of them, and is labelled by the least set that it is similar to. Members of one label need not be
compared any more: only those outside of the part's largest label meet the others, in cells of two blocks, so that no task
returns or receives all pairs. A part of near copies is so about linear in its members. All pairs are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .simhash_dedup import codewords
from .spark_tools import checkpointed, fresh, join_spread
from .words import Spans, Words, mix, slices

SHINGLE = 5
SIMILARITY = 0.8
#: Golay words of a SimHash; signs that candidates are compared by, and how many may differ.
WORDS = 56
BITS = 256
APART = 84
#: Larger parts of one key meet in cells of blocks of so many sets, and of so many shingles (8 MB) if a set alone hasn't more.
FEW = 32
BLOCK = 2048
BLOCK_SHINGLES = 1 << 20
#: Up to so many sets of one key are compared along the sorted rows, more of them from set to set.
_LAGS = 256
_LENGTH = 23
_HASHES = -(-WORDS * _LENGTH // 64)
_SIGNS = (2.0 * ((np.arange(256)[:, None] >> np.arange(8)) & 1) - 1).astype(np.float32)
_PRINT = [f"print{i}" for i in range(BITS // 64)]
#: Bits of the map that spares most sets the way to the candidates.
_MAP = 23
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low() -> Column:
    return F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)


def _shingles(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all shingles, and n + 1 offsets by text; a text of fewer words than a shingle, but not none, is one shingle."""
    words = Words(texts)
    spans = Spans(words.hashes())
    size = np.where(words.counts > 0, np.maximum(1, words.counts - shingle + 1), 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    text = np.repeat(np.arange(len(size)), size)
    at = words.first[text] + np.arange(offsets[-1]) - offsets[text]
    return spans.hash(at, np.minimum(at + shingle, words.first[text + 1])), offsets


def _sets(hashes: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted set of each text, and its name; the empty set is 0."""
    own = [np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    names = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in own], np.uint64)
    return own, names.view(np.int64)


def _sums(own: list[np.ndarray]) -> np.ndarray:
    """For each set and each of 64 * _HASHES bits of its shingles' hashes: how many more of them are 1 than 0."""
    hashes = np.concatenate(own)
    base = np.repeat(np.arange(len(own)), [len(s) for s in own]) << 8
    out = np.empty((len(own), 64 * _HASHES), np.float32)
    for k in range(8 * _HASHES):
        if k % 8 == 0:
            bits = mix(hashes, 77 + k).view(np.uint8).reshape(-1, 8)
        counts = np.bincount(base + bits[:, k % 8], minlength=len(own) << 8).reshape(-1, 256)
        out[:, 8 * k : 8 * k + 8] = counts.astype(np.float32) @ _SIGNS
    return out


def nearest(words: np.ndarray) -> np.ndarray:
    """The index of the Golay codeword nearest to each row of 23 sums: that of the largest inner product with its signs."""
    half = codewords()[:, :2048]  # the code holds each word's complement too
    out = np.empty(len(words), np.int32)
    for at in range(0, len(words), 512):
        products = words[at : at + 512] @ half
        best = np.abs(products).argmax(axis=1)
        out[at : at + 512] = 2 * best + (products[np.arange(len(best)), best] < 0)
    return out


def _keys_and_prints(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """WORDS keys and the BITS first signs (as uint64) of each set; the empty set's are of no use."""
    keys, prints = np.empty((len(own), WORDS), np.int32), np.empty((len(own), BITS // 64), np.uint64)
    for at in range(0, len(own), 512):
        sums = _sums(own[at : at + 512])
        keys[at : at + 512] = nearest(sums[:, : WORDS * _LENGTH].reshape(-1, _LENGTH)).reshape(-1, WORDS)
        prints[at : at + 512] = np.packbits(sums[:, :BITS] > 0, axis=1).view(np.uint64)
    return keys | (np.arange(WORDS, dtype=np.int32) << 12), prints


def _key_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, offsets = _shingles(part.column("text"), shingle)
                own, names = _sets(hashes, offsets)
                keys, prints = _keys_and_prints(own)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * WORDS), pa.array(keys.reshape(-1)))
                signs = [pa.array(p) for p in prints.view(np.int64).T]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "a", "b")), pa.array(names), pa.array([len(s) for s in own], pa.int64()), lists, *signs], ["doc_id", "a", "b", "name", "n", "keys", *_PRINT])

    return run


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """The columns of whole groups of one key (the first column) of sorted rows, with each group's first row and size."""
    held = None
    for batch in _and_end(batches):
        if batch is not None:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own, strict=True)]
        if held is None or not len(held[0]):
            continue
        # the last group may go on in the next batch
        last = int(np.searchsorted(held[0], held[0][-1])) if batch is not None else len(held[0])
        now, held = [h[:last] for h in held], [h[last:] for h in held]
        first = np.flatnonzero(np.append(True, now[0][1:] != now[0][:-1])) if last else np.empty(0, np.int64)
        yield now, first, np.diff(np.append(first, last))


def _and_end(batches):
    yield from batches
    yield None


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1) <= APART


def _near_pairs(key: np.ndarray, n: np.ndarray, prints: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one key, of sizes that allow the similarity and few differing signs; sorted by key and n."""
    found, at = [(np.empty(0, np.int64),) * 2], np.arange(len(key))
    for lag in count(1):
        at = at[at < len(key) - lag]
        at = at[(key[at] == key[at + lag]) & (n[at] + 1e-9 >= similarity * n[at + lag])]
        if not len(at):
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))
        ok = at[_near(prints[at], prints[at + lag])]
        found.append((ok, ok + lag))


def _parts(n: np.ndarray, prints: np.ndarray, similarity: float) -> np.ndarray:
    """The first member of each one's part, of sets of one key sorted by n. Those reached once are compared with the others only."""
    label, left = np.arange(len(n)), np.arange(len(n))
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            now, front = front[:64], front[64:]
            low, high = np.searchsorted(n[left], (similarity * n[now].min() - 1, n[now].max() / similarity + 1))
            other = left[low:high]
            small, large = np.minimum(n[now][:, None], n[other]), np.maximum(n[now][:, None], n[other])
            new = (_near(prints[now][:, None], prints[other]) & (small + 1e-9 >= similarity * large)).any(axis=0)
            label[other[new]] = root
            front = np.concatenate([front, other[new]])
            left = np.concatenate([left[:low], other[~new], left[high:]])
    return label


def _group_rows(similarity: float, few: int):
    """Of rows sorted by key and n: candidate pairs (a, b), and (a, part) for each member of a part of more than ``few``.

    A small part gives all its pairs, a larger one those with one member of its middle half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, name, n, *signs), first, size in _groups(batches, ["key", "name", "n", *_PRINT]):
            prints = np.stack(signs, axis=1).view(np.uint64)
            wide = np.repeat(size > _LAGS, size)
            some = np.flatnonzero(~wide)
            i, j = (some[x] for x in _near_pairs(key[some], n[some], prints[some], similarity))
            label = np.arange(len(key))
            if len(i):
                nodes, roots = forest(i, j)
                label[nodes] = roots
            for at, k in zip(first[size > _LAGS].tolist(), size[size > _LAGS].tolist(), strict=True):
                label[at : at + k] = at + _parts(n[at : at + k], prints[at : at + k], similarity)
            members = np.bincount(label, minlength=len(key))[label]
            narrow = members[i] <= few
            rest = np.flatnonzero(wide & (members > 1) & (members <= few))
            rest = rest[np.argsort(label[rest], kind="stable")]
            x, y = (rest[x] for x in _near_pairs(label[rest], n[rest], prints[rest], similarity))
            crowd = np.flatnonzero(members > few)
            crowd = crowd[np.argsort(label[crowd], kind="stable")]
            # of the middle half of each row's part the set that is first by a hash: parts of many keys have few such sets among them
            start = np.searchsorted(label[crowd], label[crowd])
            outer = np.abs(2 * (np.arange(len(crowd)) - start) - members[crowd] + 1) > members[crowd] // 2
            head = crowd[np.lexsort((mix(name[crowd].view(np.uint64), 3), outer, label[crowd]))[start]]
            ok = (head != crowd) & (np.minimum(n[head], n[crowd]) + 1e-9 >= similarity * np.maximum(n[head], n[crowd]))
            a, b = np.concatenate([j[narrow], y, crowd[ok]]), np.concatenate([i[narrow], x, head[ok]])
            part = mix(name[label[crowd]].view(np.uint64)) ^ mix(key[crowd].astype(np.uint64), 5)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([name[a], name[crowd]])), pa.array(np.concatenate([name[b], np.zeros(len(crowd), np.int64)]), mask=np.arange(len(a) + len(crowd)) >= len(a)), pa.array(np.concatenate([np.zeros(len(a), np.int64), part.view(np.int64)]))],
                ["a", "b", "key"],
            )

    return run


def _cells(member: DataFrame, block: int) -> DataFrame:
    """(name, cell, side): members of groups in blocks, those outside of the largest label against each other and against the rest.

    Rows (key, name, n, root). A block has about ``block`` sets or BLOCK_SHINGLES shingles; a group never comes to one task.
    """
    counts = member.groupBy("key", "root").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    largest = F.max_by(F.struct("root", "k", "n"), F.struct("k", "root"))
    split = counts.groupBy("key").agg(F.count("*").alias("roots"), largest.alias("major"), F.sum("k").alias("k"), F.sum("n").alias("n")).filter("roots > 1")
    number = lambda k, n: F.greatest(F.ceil(k / block), F.ceil(n / BLOCK_SHINGLES))
    sized = split.select("key", F.col("major.root").alias("major"), number(F.col("k") - F.col("major.k"), F.col("n") - F.col("major.n")).alias("others"), number(F.col("major.k"), F.col("major.n")).alias("majors"))
    rows = join_spread(member, checkpointed(sized), ["key"])
    minor = F.col("root") != F.col("major")
    at = F.when(minor, F.pmod(F.xxhash64("name"), "others")).otherwise(F.col("others") + F.pmod(F.xxhash64("name"), "majors"))
    none = F.array().cast("array<bigint>")
    # a minor block meets itself, the minor blocks after it, and all others
    after = F.when(F.col("minor"), F.sequence(F.col("at"), F.col("others") + F.col("majors") - 1)).otherwise(none)
    last = F.least(F.col("at"), F.col("others")) - 1
    before = F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(none)
    both = F.concat(
        F.transform(after, lambda j: F.struct(F.xxhash64("key", "at", j).alias("cell"), F.lit(0).alias("side"))),
        F.transform(before, lambda i: F.struct(F.xxhash64("key", i, "at").alias("cell"), F.lit(1).alias("side"))),
    )
    return rows.withColumns({"minor": minor, "at": at}).select("name", F.explode(both).alias("x")).select("name", "x.cell", "x.side")


def _set_rows(shingle: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = wanted.value
        for batch in batches:
            for part in slices(batch):
                own, names = _sets(*_shingles(part.column("text"), shingle))
                at = names & ((1 << _MAP) - 1)
                keep = np.flatnonzero((some[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
                yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array([own[i].tobytes() for i in keep.tolist()], pa.binary())], ["name", "shingles"])

    return run


def _similar(common, n, m, similarity: float):
    # in whole numbers of shingles; the small term is for the rounding of products
    return common + 1e-9 >= similarity * (n + m - common)


def _pair_rows(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                ok.append(_similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in ("a", "b")], ["a", "b"])

    return run


def _cell_links(names: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the similar sets of one cell; in a cell of two blocks only pairs across them count."""
    size = np.array([len(s) for s in sets])
    offsets = np.concatenate([[0], np.cumsum(size)])
    _, values = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(values, kind="stable")
    member = np.repeat(np.arange(len(sets)), size)[order]
    low = np.concatenate([[0], np.cumsum(np.bincount(values))])
    across = sides.any()
    a, b = [], []
    for i in range(len(sets)):
        if across and sides[i]:
            continue
        own = values[offsets[i] : offsets[i + 1]]
        count = low[own + 1] - low[own]
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        common = np.bincount(member[np.repeat(low[own], count) + inner], minlength=len(sets))
        ok = _similar(common, size[i], size, similarity) & (sides == 1 if across else np.arange(len(sets)) > i)
        b.append(names[ok])
        a.append(np.full(len(b[-1]), names[i]))
    return forest(np.concatenate(a), np.concatenate(b)) if a and sum(map(len, a)) else (np.empty(0, np.int64),) * 2


def _cell_rows(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sides, sets = None, [], [], []

        def links():
            a, b = _cell_links(np.array(names, np.int64), np.array(sides), sets, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for cell, name, side, own in zip(*(batch.column(c).to_pylist() for c in ("cell", "name", "side", "shingles")), strict=True):
                if cell != now:
                    if names:
                        yield links()
                    now, names, sides, sets = cell, [], [], []
                names.append(name)
                sides.append(side)
                sets.append(np.frombuffer(own, np.uint64))
        if names:
            yield links()

    return run


def _rooted(names: DataFrame, roots: DataFrame) -> DataFrame:
    return names.join(roots, names["name"] == roots["node"], "left").select("name", F.coalesce("root", "name").alias("root"))


def _shingle_sets(texts: DataFrame, names: DataFrame, shingle: int) -> DataFrame:
    """(name, shingles) of the named sets; a broadcast map of fixed size ends most other sets in their task."""
    bit = F.col("name").bitwiseAND((1 << _MAP) - 1)
    words = names.groupBy(F.shiftright(bit, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))).alias("bits")).toArrow()
    some = np.zeros(1 << (_MAP - 6), np.uint64)
    some[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    sets = texts.mapInArrow(_set_rows(shingle, texts.sparkSession.sparkContext.broadcast(some)), "name long, shingles binary")
    return checkpointed(sets.join(names, "name", "left_semi").groupBy("name").agg(F.first("shingles").alias("shingles")))


def components_of_similar(texts: DataFrame, marked: DataFrame, shingle: int, similarity: float, few: int, block: int) -> DataFrame:
    """(node, root) of names of sets: the components that all pairs of enough similarity make."""
    once = marked.filter("n > 0").groupBy("name").agg(F.max("n").alias("n"), F.first("keys").alias("keys"), *[F.first(c).alias(c) for c in _PRINT])
    keyed = once.select(F.explode("keys").alias("key"), "name", "n", *_PRINT).repartition("key").sortWithinPartitions("key", "n", "name")
    found = checkpointed(keyed.mapInArrow(_group_rows(similarity, few), "a long, b long, key long").distinct())
    pairs, crowd = found.filter("b is not null").select("a", "b"), found.filter("b is null").select(F.col("a").alias("name"), "key")
    sets = _shingle_sets(texts, pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct().union(crowd.select("name")).distinct(), shingle)
    # the member that a part meets may be in very many pairs: the sets of these, 256 at most, are broadcast
    right = join_spread(pairs, sets.select(F.col("name").alias("b"), F.col("shingles").alias("y")), ["b"], 256)
    near = checkpointed(right.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a").mapInArrow(_pair_rows(similarity), "a long, b long"))
    if not crowd.isEmpty():
        # members of one label are in one component: each is similar to the label's set
        labels = near.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        sizes = sets.select("name", (F.length("shingles") / 8).cast("long").alias("n"))
        member = checkpointed(crowd.join(_rooted(sizes.select("name"), labels), "name").join(sizes, "name"))
        cells = _cells(member, block).join(sets, "name").select("cell", "name", "side", "shingles").repartition("cell").sortWithinPartitions("cell")
        # checkpointed, as the next step is Python too: a task would hold two workers, and the executor keeps all it ever had
        near = near.union(checkpointed(cells.mapInArrow(_cell_rows(similarity), "a long, b long")))
    return components(near)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """One document of each group of near-duplicates: the row of the least doc_id; the columns are those of docs.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. Texts whose sets of shingles have a Jaccard similarity
    of ``similarity`` or more are of one group, directly or over others. Texts of fewer words than a shingle are one shingle;
    null, empty and wordless texts are equal. A null doc_id comes after all others; of a group's rows that
    share the least doc_id, one stays.
    """
    # rows go by doc_id and two hashes of the text: what they hold, so that a null or repeated doc_id does no harm
    own = ["doc_id", "a", "b"]
    hashes = F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")
    texts = docs.select(F.col("doc_id").cast("long"), *hashes, _low().alias("text"))
    marked = checkpointed(texts.mapInArrow(_key_rows(shingle), f"doc_id long, a long, b long, name long, n long, keys array<int>, {' long, '.join(_PRINT)} long"))
    roots = components_of_similar(texts.select("text"), marked, shingle, similarity, few, block)
    rows = checkpointed(marked.groupBy("name", *own).agg(F.count("*").alias("times")))
    named = checkpointed(_rooted(rows.select("name").distinct(), roots))
    rooted = checkpointed(join_spread(rows, named, ["name"]))
    first = F.struct(F.col("doc_id").isNull().alias("none"), *own)
    best = checkpointed(rooted.groupBy("root").agg(F.min(first).alias("best")))
    # the rows to decide on: those that aren't the best, and the best ones that are there more than once
    p = fresh(docs)
    names = {"doc_id": f"{p}doc_id", "a": f"{p}a", "b": f"{p}b"}
    decided = join_spread(rooted, best, ["root"]).select(*(F.col(c).alias(names[c]) for c in own), (first != F.col("best")).alias("spare"), "times")
    other = checkpointed(decided.filter("spare or times > 1").drop("times"))
    here = {"a": f"{p}text_a", "b": f"{p}text_b"}
    named = docs.withColumns({here["a"]: hashes[0], here["b"]: hashes[1]})
    same = lambda x: named["doc_id"].cast("long").eqNullSafe(x[names["doc_id"]]) & (named[here["a"]] == x[names["a"]]) & (named[here["b"]] == x[names["b"]])
    kept = named.join(other, same(other), "left_anti")
    again = other.filter("not spare")
    if not again.isEmpty():
        kept = kept.union(named.join(again, same(again), "left_semi").dropDuplicates(["doc_id", *here.values()]))
    return kept.select(*docs.columns)
