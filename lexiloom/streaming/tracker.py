"""Clause trackers over a stream of tokens: the state of each text is kept between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_STATE = "gold array<int>, banned array<int>, satisfied boolean, violated boolean, seen long"


def advanced(progress: list[int], sequences: list[list[str]], token: str | None) -> list[int]:
    """The progress of each sequence after one more token, as functions.automata.fed has it."""
    out = []
    for at, s in zip(progress, sequences, strict=True):
        on = at < len(s) and token is not None and s[at] == token
        begins = bool(s) and token is not None and s[0] == token
        out.append(at if at >= len(s) else at + 1 if on else int(begins))
    return out


def track_stream(tokens: DataFrame, key: str = "text_id") -> DataFrame:
    """(key, at, satisfied, violated, progress) after each token, from a stream of (key, at, token, gold, banned); output mode append.

    Tokens of a text come in the order of ``at``, in one batch or several; within a batch they are sorted. ``gold`` and
    ``banned`` are the text's sequences, the same in all its rows; null ones are empty.
    """
    schema = f"{key} {dict(tokens.dtypes)[key]}, at long, satisfied boolean, violated boolean, progress double"

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("at")
        gold, banned = ([list(s) for s in rows[c].iloc[0]] if rows[c].iloc[0] is not None else [] for c in ("gold", "banned"))
        golds, bans, satisfied, violated, seen = state.get if state.exists else ([0] * len(gold), [0] * len(banned), False, False, 0)
        golds, bans, out = list(golds), list(bans), []
        for at, token in zip(rows["at"], rows["token"], strict=True):
            if not violated:
                bans = advanced(bans, banned, token)
                violated = any(s and n >= len(s) for n, s in zip(bans, banned, strict=True))
            if not (violated or satisfied):
                golds = advanced(golds, gold, token)
                satisfied = any(s and n >= len(s) for n, s in zip(golds, gold, strict=True))
            share = 1.0 if satisfied else max([n / len(s) for n, s in zip(golds, gold, strict=True) if s], default=0.0)
            out.append([*keys, at, satisfied, violated, share])
        state.update((golds, bans, satisfied, violated, seen + len(out)))
        yield pd.DataFrame(out, columns=[key, "at", "satisfied", "violated", "progress"])

    return tokens.select(key, "at", "token", "gold", "banned").groupBy(key).applyInPandasWithState(run, schema, _STATE, "append", "NoTimeout")
