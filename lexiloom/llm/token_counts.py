"""Token counts of texts by a sentencepiece model, without one huge text being encoded at once.

Method: overlap resynchronisation. A huge text is encoded in chunks that overlap, with the offset of each token. Two neighbour
chunks are spliced at an offset in their overlap where both have a token border and where no piece of the vocabulary of two
characters or more occurs in the text across it: no merge can ever cross such a place, so what stands before it and after it is
encoded alike in the chunk and in the whole text. Where the overlap has no such place, it's widened, at worst to the whole rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices, string_bytes

CHUNK = 1 << 15
OVERLAP = 512
LIMIT = 4096
_SPACE = "▁"
_PROBE = "a  b\u00a0c\u3000\uff21 \ufb01 e\u0301 "


class _Chunk:
    """Tokens of text[start:end]: the character offsets where one begins, the number before each of these, and all."""

    def __init__(self, counter: TokenCounter, text: str, start: int, end: int):
        own = text[start:end]
        # the model puts one space before what it encodes; no piece joins a line feed
        lead = 1 if start == 0 else 0 if own[0] == " " else 2
        own = own if start == 0 else own[1:] if own[0] == " " else "\n" + own
        widths = counter.width[np.asarray(counter.model.encode(own) if own else [counter.space], np.int64)]
        raw = own.encode()
        self.spelt = int(widths.sum()) == len(raw) + 1
        at = np.cumsum(widths) - widths
        skip = 2 if lead == 2 else 0
        self.total = len(widths) - skip
        chars = np.flatnonzero((np.frombuffer(b" " + raw, np.uint8) & 0xC0) != 0x80)
        index = np.minimum(np.searchsorted(chars, at), len(chars) - 1)
        shown = chars[index] == at
        self.places = start + index[shown] - lead
        self.before = np.flatnonzero(shown) - skip


class TokenCounter:
    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        plain = [not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)) for i in range(size)]
        self.space = self.model.piece_to_id(_SPACE)
        self.width = np.array([len(p.replace(_SPACE, " ").encode()) if ok else 1 for p, ok in zip(pieces, plain, strict=True)])
        self.several = {p.replace(_SPACE, " ") for p, ok in zip(pieces, plain, strict=True) if ok and len(p) > 1}
        self.longest = max(map(len, self.several), default=1)
        #: Offsets can be told from pieces only if the model leaves the text as it is.
        self.splits = self.model.normalize(_PROBE) == _SPACE + _PROBE.replace(" ", _SPACE) and not any("\n" in p for p in self.several)

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece of two characters or more occurs in the text across the offset (at least ``longest``)."""
        for start in range(at - self.longest + 1, at):
            for end in range(at + 1, min(len(text), start + self.longest) + 1):
                if text[start:end] in self.several:
                    return False
        return True

    def _splice(self, text: str, left: _Chunk, right: _Chunk, start: int, end: int) -> tuple[int, int, int] | None:
        """A proven place well inside [start, end), and the tokens before it in both chunks."""
        both, i, j = np.intersect1d(left.places, right.places, return_indices=True)
        inside = np.flatnonzero((both > start + self.longest) & (both + self.longest < end))
        for k in inside[np.argsort(np.abs(both[inside] - (start + end) // 2), kind="stable")].tolist():
            if self.stable(text, int(both[k])):
                return int(both[k]), int(left.before[i[k]]), int(right.before[j[k]])
        return None

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        if len(text) <= chunk + overlap or not self.splits:
            return len(self.model.encode(text))
        text = text.replace(_SPACE, " ")  # one sign for both in the model, and a token's width is then plain
        total, place, done, width = 0, 0, 0, overlap
        end = chunk + overlap
        left = _Chunk(self, text, 0, end)
        while end < len(text):
            start = max(place + 1, end - width)
            right = _Chunk(self, text, start, min(len(text), start + width + chunk))
            if not (left.spelt and right.spelt):  # a model whose tokens show no offsets for this text
                return len(self.model.encode(text))
            found = self._splice(text, left, right, start, end)
            if found is None:  # widen: the left chunk goes on further from its proven place
                width *= 2
                end = min(len(text), end + width)
                left, done = _Chunk(self, text, place, end), 0
                continue
            place = found[0]
            total += found[1] - done
            left, done, end, width = right, found[2], min(len(text), start + width + chunk), overlap
        return total + left.total - done


_loaded: dict[str, TokenCounter] = {}


def load(path: str) -> TokenCounter:
    """The counter of a model file, once for each Python process."""
    if path not in _loaded:
        _loaded[path] = TokenCounter(path)
    return _loaded[path]


def _rows(path: str, limit: int, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            for part in slices(batch):
                data, offsets = string_bytes(part.column("text"))
                raw, at = data.tobytes(), offsets.tolist()
                n = np.array([counter.count(raw[a:b].decode(), chunk, overlap) for a, b in zip(at[:-1], at[1:], strict=True)], np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) of whole texts, without added tokens.

    Null and empty texts have 0 bytes and 0 tokens. With a model that normalises its input texts are encoded whole, as its
    tokens show no offsets. One row for each input row, equal rows alike, with a null doc_id too; extra columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_rows(path, limit, chunk, overlap), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
