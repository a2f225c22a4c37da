"""Quality scores of texts by a factorisation machine.

Method: features are hashed words, classes of structure statistics and the length class that the table's metadata gives. The
machine adds a weight for each feature and a low-rank weight for each pair; the pairs' sum is half of the square of the
summed factors less the sum of their squares, so a text is scored in time linear in its words. It's trained in numpy on a
bounded sample of labelled rows, whose features are made on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .words import Words, slices, string_bytes

BUCKETS = 1 << 16
RANK = 6
#: Labelled rows that training takes at most.
ROWS = 6000
CUT = 0.3


def _classes(*kinds: str) -> list[np.ndarray]:
    out = []
    for kind in kinds:
        row = np.zeros(256, np.int32)
        row[[ord(c) for c in kind]] = 1
        out.append(row)
    return out


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_UPPER, _LOWER, _DIGITS, _STOPS, _MARKS = _classes(_LETTERS, _LETTERS.lower(), "0123456789", ".,;:?'\"()-", "!#$%&*+/<=>@[\\]^_`{|}~")
#: Edges of the classes of each statistic, in the order of ``_statistics``.
_EDGES = (
    (0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7),  # capitals
    (0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4),  # digits
    (0.002, 0.01, 0.02, 0.03, 0.05, 0.1, 0.2),  # stops
    (0.0005, 0.002, 0.01, 0.03, 0.1, 0.2),  # other marks
    (0.05, 0.2, 0.35, 0.5, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9, 0.97),  # different words
    (3.0, 4.0, 5.0, 5.5, 6.0, 6.5, 7.0, 8.0, 10.0, 15.0),  # bytes a word
    (0.1, 0.5, 0.8, 0.95, 0.999),  # different lines
    (1.5, 3.0, 6.0, 12.0, 24.0, 48.0, 96.0),  # words a line
    (2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0, 1000.0, 3000.0, 10000.0),  # words
    (16.0, 64.0, 256.0, 1024.0, 4096.0, 16384.0, 65536.0),  # characters, from the metadata
    (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.8),  # pairs of one word twice running
)
_CLASSES = 16
FEATURES = BUCKETS + _CLASSES * len(_EDGES)


def _features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and values, sorted by row; each row has a feature of each statistic, and its words' with length 1."""
    texts = part.column("text")
    words = Words(texts)
    hashes, text = words.hashes(), words.text_of()
    data, offsets = string_bytes(texts)
    n = part.num_rows
    size = np.maximum(np.diff(offsets), 1)
    share = []
    for kind in (_UPPER, _DIGITS, _STOPS, _MARKS):
        sums = np.concatenate([[0], np.cumsum(kind[data])])
        share.append((sums[offsets[1:]] - sums[offsets[:-1]]) / size)
    count = np.maximum(words.counts, 1)
    order = np.lexsort((hashes, text))
    key, own = hashes[order], text[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    different = np.bincount(own[new], minlength=n)
    twice = np.zeros(n, np.int64)
    if len(hashes):
        again = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        twice = np.bincount(text[1:][again], minlength=n)
    lines = np.empty((2, n))
    raw, at = data.tobytes(), offsets.tolist()
    for i in range(n):
        own_lines = raw[at[i] : at[i + 1]].split(b"\n")
        lines[:, i] = len(own_lines), len(set(own_lines))
    letters = words.ends - words.starts
    mean = np.bincount(text, letters, minlength=n) / count
    chars = part.column("n_chars").to_numpy(zero_copy_only=False).astype(np.float64)
    stats = [*share, different / count, mean, lines[1] / lines[0], words.counts / lines[0], words.counts, chars, twice / count]
    classes = [BUCKETS + _CLASSES * k + np.digitize(np.nan_to_num(s), edges) for k, (s, edges) in enumerate(zip(stats, _EDGES, strict=True))]
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(key)))
    bucket, row = (key[first] % np.uint64(BUCKETS)).astype(np.int64), own[first]
    weight = 1 + np.log(times)
    length = np.sqrt(np.bincount(row, weight**2, minlength=n))
    rows = np.concatenate([row, np.tile(np.arange(n), len(_EDGES))])
    columns = np.concatenate([bucket, *classes])
    values = np.concatenate([weight / np.maximum(length[row], 1e-9), np.ones(n * len(_EDGES))])
    order = np.argsort(rows, kind="stable")
    return rows[order], columns[order], values[order].astype(np.float32)


class FactorisationMachine:
    def __init__(self, seed: int = 3):
        self.bias = np.float32(0)
        self.weight = np.zeros(FEATURES, np.float32)
        self.factors = (np.random.default_rng(seed).standard_normal((FEATURES, RANK)) * 0.05).astype(np.float32)

    def _sums(self, columns, values, first):
        own = self.factors[columns] * values[:, None]
        return own, np.add.reduceat(own, first), np.add.reduceat(own * own, first), np.add.reduceat(self.weight[columns] * values, first)

    def scores(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Every row has a feature at least; rows are numbered from 0 without gaps."""
        if not len(rows):
            return np.empty(0)
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        _, sums, squares, linear = self._sums(columns, values, first)
        z = self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.05, ridge: float = 1e-5, seed: int = 5) -> FactorisationMachine:
        """Adagrad on the logistic loss."""
        rng = np.random.default_rng(seed)
        seen_w, seen_f, seen_b = np.full(FEATURES, 1e-6, np.float32), np.full(self.factors.shape, 1e-6, np.float32), np.float32(1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 32):
                few = order[at : at + 32]
                columns = np.concatenate([rows[i][0] for i in few])
                values = np.concatenate([rows[i][1] for i in few])
                size = np.array([len(rows[i][0]) for i in few])
                first = np.cumsum(size) - size
                own, sums, squares, linear = self._sums(columns, values, first)
                z = self.bias + linear + 0.5 * (sums**2 - squares).sum(axis=1)
                error = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[few]) / len(few)).astype(np.float32)
                each = np.repeat(error, size) * values
                back = each[:, None] * (np.repeat(sums, size, axis=0) - own)
                used, where = np.unique(columns, return_inverse=True)
                g_w = np.bincount(where, each, minlength=len(used)).astype(np.float32) + ridge * self.weight[used]
                g_f = np.zeros((len(used), RANK), np.float32)
                np.add.at(g_f, where, back)
                g_f += ridge * self.factors[used]
                seen_w[used] += g_w**2
                seen_f[used] += g_f**2
                seen_b += error.sum() ** 2
                self.weight[used] -= rate * g_w / np.sqrt(seen_w[used])
                self.factors[used] -= 0.4 * rate * g_f / np.sqrt(seen_f[used])
                self.bias -= rate * error.sum() / np.sqrt(seen_b)
        return self


def _inputs(docs: DataFrame, *more) -> DataFrame:
    chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long"), *more, F.coalesce("text", F.lit("")).alias("text"), F.coalesce(chars, F.length("text"), F.lit(0)).alias("n_chars"))


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows, columns, values = _features(part)
            offsets = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (columns.astype(np.int32), values)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *lists], ["doc_id", "label", "columns", "values"])


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> FactorisationMachine:
    """A machine for ``labels.quality``, from at most ``rows`` labelled rows that aren't held out, chosen by a hash of the doc_id.

    A doc_id labelled more than once has the label 1 if any of its labels is 1.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("label"))
    n = known.count()
    if not n:
        return FactorisationMachine()
    place = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 20)) / (1 << 20)
    some = known.filter(place < min(1.0, 1.5 * rows / n)).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").limit(rows)
    # the sample has ``rows`` rows of two numbers at most, whatever the input's size
    table = _inputs(docs).join(F.broadcast(some), "doc_id").mapInArrow(_sample_rows, "doc_id long, label int, columns array<int>, values array<float>").toArrow()
    found = sorted(zip(table["doc_id"].to_pylist(), range(table.num_rows), strict=True))
    own = [(table["columns"][i].values.to_numpy(zero_copy_only=False), table["values"][i].values.to_numpy(zero_copy_only=False)) for _, i in found]
    marks = table["label"].to_numpy()[[i for _, i in found]].astype(np.float32) if found else np.empty(0, np.float32)
    return FactorisationMachine().fit(own, marks)


def _score(machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = machine.value
        for batch in batches:
            for part in slices(batch):
                score = own.scores(*_features(part))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def quality(docs: DataFrame, labels: DataFrame, machine: FactorisationMachine | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= CUT) of whole texts.

    Null and empty texts are scored by the statistics of an empty text. Without labelled rows every score is that of an
    untrained machine, about 0.5. One row for each input row; a null n_chars is the text's own length; columns other than
    doc_id, text and n_chars are ignored.
    """
    spark = docs.sparkSession
    machine = machine or train(docs, labels)
    texts = _inputs(docs, held_out(F.col("doc_id")).alias("held_out"))
    return texts.mapInArrow(_score(spark.sparkContext.broadcast(machine)), "doc_id long, held_out boolean, score double, predicted int")
