"""The spaced-repetition state kept over a stream of review events, in the order of the events' times.

Events come late and out of order. Each waits in its key's state until the watermark has passed its time, so that every event that
the stream's delay allows for is folded in its place; a timer wakes a key that gets no further events.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.mastery import DAYS, LEARNED_BOX

_OUT = "strength double, box int, streak int, successes int, failures int, last timestamp, due timestamp, learned boolean"
_STATE = f"{_OUT}, waiting array<struct<ts: timestamp, event_id: long, outcome: string>>"
_ZERO = (0.0, 0, 0, 0, 0, None, None, False)
_EPOCH = datetime(1970, 1, 1)


def step(state: tuple, outcome: str, ts) -> tuple:
    """The state after one event; outcomes other than correct, incorrect and hinted change nothing."""
    strength, box, streak, good, bad, last, due, learned = state
    if outcome == "hinted":
        return round(min(1.0, strength + 0.05), 6), box, streak, good, bad, ts, due, learned
    if outcome == "correct":
        strength, box, streak, good = min(1.0, strength + 0.2), min(5, box + 1), streak + 1, good + 1
    elif outcome == "incorrect":
        strength, box, streak, bad = max(0.0, strength - 0.3), max(0, box - 1), 0, bad + 1
    else:
        return state
    return round(strength, 6), box, streak, good, bad, ts, ts + timedelta(days=DAYS[box]), learned or box >= LEARNED_BOX


def _ms(ts: datetime) -> int:
    return (ts - _EPOCH) // timedelta(milliseconds=1)


def fold_stream(events: DataFrame, key: str = "vocab_id", delay: str = "0 seconds") -> DataFrame:
    """The states of keys as the watermark passes their events, from a stream of (key, ts, event_id, outcome); output mode update.

    An event that is late by ``delay`` or less is folded in its place by (ts, event_id), in whatever batch it comes; later ones
    are dropped and counted by Spark (numRowsDroppedByWatermark). Events that the watermark hasn't passed wait: the last ``delay``
    of a stream shows once newer events move it on. A row is a key's state after all its events up to the watermark. Null keys
    share one state. Skipped events make a key known but change nothing; events without a time are left out, as in the batch fold.
    A key's state is eight numbers and the events that wait.
    """
    schema = f"{key} {dict(events.dtypes)[key]}, {_OUT}"
    names = [part.split()[0] for part in _OUT.split(", ")]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *now, waiting = state.get if state.exists else (*_ZERO, [])
        # a row's times are in the session's zone, which is UTC
        events_ = [(w[0], w[1], w[2]) for w in waiting]
        for rows in batches:
            events_ += zip((t.to_pydatetime() for t in rows["ts"]), rows["event_id"].tolist(), rows["outcome"].tolist(), strict=True)
        mark = state.getCurrentWatermarkMs()
        events_.sort(key=lambda e: (e[0], e[1]))
        ready = [e for e in events_ if _ms(e[0]) <= mark]
        for ts, _, outcome in ready:
            now = step(tuple(now), outcome, ts)
        rest = events_[len(ready) :]
        state.update((*now, rest))
        if rest:
            state.setTimeoutTimestamp(max(_ms(rest[0][0]), mark + 1))
        if ready:
            yield pd.DataFrame([[*keys, *now]], columns=[key, *names])

    slim = events.select(key, "ts", "event_id", "outcome").filter("ts is not null").withWatermark("ts", delay)
    return slim.groupBy(key).applyInPandasWithState(run, schema, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
