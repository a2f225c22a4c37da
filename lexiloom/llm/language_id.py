"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Method: bytes are embedded; filters of several widths run over windows of fixed length; each filter's largest response (max
pooling, then ReLU) feeds a softmax over the languages. Every byte of a text lies in a window; a text's probabilities are the
mean of its windows', weighted by their bytes. Training takes a bounded sample of windows of labelled rows to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_tools import fresh
from .words import slices, string_bytes

UNKNOWN = "und"
BYTES = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: The training sample: rows of each language and windows of each row at most; rows in all, shared out evenly if there are many languages.
ROWS, WINDOWS, ALL_ROWS = 300, 4, 60_000
_LETTER = regex.compile(r"\p{L}")
_BATCH = 64


def _windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows of BYTES bytes and as many zeros as the widest filter reaches beyond."""
    at = starts[:, None] + np.arange(BYTES + max(WIDTHS) - 1)
    inside = (at < ends[:, None]) & (np.arange(at.shape[1]) < BYTES)
    return np.where(inside, data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)


class ByteCnn:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        n, reach = FILTERS * len(WIDTHS), max(WIDTHS)
        self.mask = np.zeros((reach, EMBEDDING, n), np.float32)
        for k, width in enumerate(WIDTHS):
            self.mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(reach * EMBEDDING, n)
        draw = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        self.weights = {
            "bytes": draw(256, EMBEDDING, by=0.5),
            "filters": draw(reach * EMBEDDING, n, by=0.3) * self.mask,
            "bias": np.zeros(n, np.float32),
            "out": draw(n, len(languages), by=0.2),
            "out_bias": np.zeros(len(languages), np.float32),
        }
        self.weights["bytes"][0] = 0

    def _pooled(self, rows: np.ndarray, where: bool = False):
        embedded = self.weights["bytes"][rows]
        n, reach = len(rows), max(WIDTHS)
        columns = np.concatenate([embedded[:, k : k + BYTES] for k in range(reach)], axis=2)
        responses = (columns.reshape(n * BYTES, -1) @ self.weights["filters"]).reshape(n, BYTES, -1)
        if not where:
            return responses.max(axis=1)
        best = responses.argmax(axis=1)
        return np.take_along_axis(responses, best[:, None], axis=1)[:, 0], best, columns

    def _softmax(self, hidden: np.ndarray) -> np.ndarray:
        logits = hidden @ self.weights["out"] + self.weights["out_bias"]
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        parts = [self._softmax(np.maximum(self._pooled(rows[at : at + _BATCH]) + self.weights["bias"], 0)) for at in range(0, len(rows), _BATCH)]
        return np.concatenate(parts) if parts else np.empty((0, len(self.languages)), np.float32)

    def fit(self, rows: np.ndarray, labels: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 11) -> ByteCnn:
        """Adam on the cross entropy; a third of the windows are cut short at random, as short texts are."""
        rng = np.random.default_rng(seed)
        share = 1 / np.maximum(np.bincount(labels, minlength=len(self.languages)), 1)
        weight = (share[labels] / share[labels].mean()).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step, reach = 0, max(WIDTHS)
        for epoch in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), _BATCH):
                own = order[at : at + _BATCH]
                cut = np.where(rng.random(len(own)) < 1 / 3, rng.integers(8, BYTES, len(own)), BYTES)
                batch = np.where(np.arange(rows.shape[1]) < cut[:, None], rows[own], 0).astype(np.uint8)
                pooled, best, columns = self._pooled(batch, where=True)
                hidden = np.maximum(pooled + self.weights["bias"], 0)
                error = self._softmax(hidden)
                error[np.arange(len(own)), labels[own]] -= 1
                error *= weight[own][:, None] / len(own)
                back = (error @ self.weights["out"].T) * (hidden > 0)
                taken = np.take_along_axis(columns, best[:, :, None], axis=1)
                spread = back[:, :, None] * self.weights["filters"].T[None]
                byte_back = np.zeros_like(self.weights["bytes"])
                at_bytes = batch[np.arange(len(own))[:, None, None], best[:, :, None] + np.arange(reach)]
                np.add.at(byte_back, at_bytes.reshape(-1), spread.reshape(-1, EMBEDDING))
                byte_back[0] = 0
                grads = {
                    "bytes": byte_back,
                    "filters": np.einsum("nf,nfc->cf", back, taken) * self.mask,
                    "bias": back.sum(axis=0),
                    "out": hidden.T @ error,
                    "out_bias": error.sum(axis=0),
                }
                step += 1
                now = rate * (0.5 if epoch > epochs // 2 else 1)
                for k, g in grads.items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """WINDOWS windows of each text at even distances."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = string_bytes(part.column("text"))
            size = np.diff(offsets)
            own = np.repeat(np.arange(len(size)), np.minimum(WINDOWS, (size + BYTES - 1) // BYTES))
            n = np.bincount(own, minlength=len(size))
            k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            starts = offsets[:-1][own] + np.where(n[own] > 1, k * np.maximum(size[own] - BYTES, 0) // np.maximum(n[own] - 1, 1), 0)
            rows = [data[a : min(a + BYTES, e)].tobytes() for a, e in zip(starts.tolist(), offsets[1:][own].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(own)), pa.array(rows, pa.binary())], ["lang", "bytes"])


def train(docs: DataFrame, rows: int = ROWS, all_rows: int = ALL_ROWS) -> ByteCnn:
    """A network for every language of the rows that aren't held out and have text and a language.

    At most ``rows`` rows of each language are used, and about ``all_rows`` in all, one of each language at least; they are
    chosen by a hash of the doc_id: a bounded sample at any size of the input.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & (F.length("text") > 0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return ByteCnn([])
    rows = max(1, min(rows, all_rows // len(languages)))
    share = F.element_at(F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, (1.5 * rows + 30) / r["n"])))]), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / (1 << 20)
    some = labelled.filter(place < share)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id"))).filter(F.col("rank") <= rows)
    table = ranked.select("text", "lang").mapInArrow(_cut, "lang string, bytes binary").toArrow()
    raw = [b.as_py() for b in table["bytes"]]
    order = sorted(range(len(raw)), key=lambda i: (table["lang"][i].as_py(), raw[i]))  # the same order however rows arrive
    data = np.frombuffer(b"".join(raw[i] for i in order), np.uint8)
    ends = np.cumsum([len(raw[i]) for i in order])
    starts = np.concatenate([[0], ends[:-1]])
    names = {x: k for k, x in enumerate(languages)}
    labels = np.array([names[table["lang"][i].as_py()] for i in order])
    return ByteCnn(languages).fit(_windows(data, starts, ends), labels)


def _predicted(own: ByteCnn, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language and the score of each text of one slice."""
    data, offsets = string_bytes(texts)
    raw, at = data.tobytes(), offsets.tolist()
    letter = np.array([_LETTER.search(raw[a:b].decode()) is not None for a, b in zip(at[:-1], at[1:], strict=True)], bool)
    n = np.where(letter, (np.diff(offsets) + BYTES - 1) // BYTES, 0) if own.languages else np.zeros(len(texts), np.int64)
    text = np.repeat(np.arange(len(texts)), n)
    starts = offsets[:-1][text] + BYTES * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    sums = np.zeros((len(texts), max(1, len(own.languages))))
    for a in range(0, len(text), 1024):
        few = slice(a, a + 1024)
        ends = np.minimum(starts[few] + BYTES, offsets[1:][text[few]])
        np.add.at(sums, text[few], own.probabilities(_windows(data, starts[few], ends)) * (ends - starts[few])[:, None])
    total = sums.sum(axis=1)
    best = sums.argmax(axis=1)
    score = np.where(total > 0, sums[np.arange(len(best)), best] / np.maximum(total, 1e-30), 0.0)
    return [own.languages[b] if t > 0 else UNKNOWN for b, t in zip(best.tolist(), total.tolist(), strict=True)], np.clip(score, 0, 1)


def _predict(model):
    """A column function of the text; not deterministic for the optimiser, so that no plan runs it twice for a row."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.value
        for texts in batches:
            found = [_predicted(own, part.column("text")) for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]))]
            names = pa.array([n for f in found for n in f[0]], pa.string())
            yield pa.StructArray.from_arrays([names, pa.array(np.concatenate([f[1] for f in found]) if found else [], pa.float64())], ["lang_pred", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "lang_pred string, score double").asNondeterministic()


def language_id(docs: DataFrame, model: ByteCnn | None = None, passed: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """The columns ``passed`` of docs (by default none), doc_id, held_out, lang_pred and score (the mean probability of that language) of whole texts.

    A text that is null or has no letter is "und" with score 0, as all are where no labelled rows exist. Equal scores go to the
    language first by name. One row for each input row, equal rows alike; a null doc_id isn't held out; extra columns are
    ignored. Only the text goes to Python; rows are read in place, without an exchange.
    """
    found, name = _found(docs, model)
    own = {"doc_id": F.col("doc_id").cast("long"), "held_out": held_out(F.col("doc_id")), "lang_pred": F.col(f"{name}.lang_pred"), "score": F.col(f"{name}.score")}
    return found.select(*[F.col(c) for c in passed], *[v.alias(c) for c, v in own.items() if c not in passed])


def _found(docs: DataFrame, model: ByteCnn | None) -> tuple[DataFrame, str]:
    """docs with the struct (lang_pred, score), and its name, which docs doesn't have."""
    predict = _predict(docs.sparkSession.sparkContext.broadcast(model or train(docs)))
    name = f"{fresh(docs)}found"
    return docs.withColumn(name, predict(F.coalesce("text", F.lit("")))), name


def keep_known(docs: DataFrame, least: float, model: ByteCnn | None = None) -> DataFrame:
    """The documents whose language is known with a score of ``least`` or more; all columns, whatever their names, are those of docs."""
    found, name = _found(docs, model)
    return found.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).select(*docs.columns)
