"""Spaced-repetition state folded from review events in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Days until the next review by box, and the box from which a word is learned.
DAYS = (1, 2, 4, 8, 16, 30)
LEARNED_BOX = 4

_STATE = "struct<strength:double,box:int,streak:int,successes:int,failures:int,last:timestamp,due:timestamp,learned:boolean>"


def _zero() -> Column:
    return F.from_json(F.lit('{"strength":0.0,"box":0,"streak":0,"successes":0,"failures":0,"learned":false}'), _STATE)


def step(s: Column, e: Column) -> Column:
    """The state after one event (ts, id, outcome)."""
    o = e["outcome"]
    good, bad, hint = o == "correct", o == "incorrect", o == "hinted"
    strength = F.round(F.when(good, F.least(F.lit(1.0), s["strength"] + 0.2)).when(bad, F.greatest(F.lit(0.0), s["strength"] - 0.3)).when(hint, F.least(F.lit(1.0), s["strength"] + 0.05)).otherwise(s["strength"]), 6)
    box = F.when(good, F.least(F.lit(5), s["box"] + 1)).when(bad, F.greatest(F.lit(0), s["box"] - 1)).otherwise(s["box"])
    days = F.element_at(F.array(*[F.lit(d) for d in DAYS]), box + 1)
    return F.struct(
        strength.alias("strength"),
        box.cast("int").alias("box"),
        F.when(good, s["streak"] + 1).when(bad, 0).otherwise(s["streak"]).cast("int").alias("streak"),
        (s["successes"] + good.cast("int")).cast("int").alias("successes"),
        (s["failures"] + bad.cast("int")).cast("int").alias("failures"),
        F.when(good | bad | hint, e["ts"]).otherwise(s["last"]).alias("last"),
        F.when(good | bad, e["ts"] + F.make_dt_interval(days)).otherwise(s["due"]).alias("due"),
        (s["learned"] | ((good | bad) & (box >= LEARNED_BOX))).alias("learned"),
    )


def fold(events: DataFrame, key: str = "vocab_id") -> DataFrame:
    """One state for each key from events (ts, event_id, outcome); skipped and unknown outcomes change nothing.

    The clamps make the fold order-dependent, so a key's events meet in one task; skipped ones, which are no-ops, are dropped
    before the exchange (a key with only these has the zero state). Events without a time have no place in the order and are left out.
    """
    events = events.filter("ts is not null")
    counted = F.col("outcome").isin("correct", "incorrect", "hinted")
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.when(counted, F.struct("ts", "event_id", "outcome")))).alias("e"))
    return rows.select(key, F.aggregate("e", _zero(), step).alias("s")).select(key, "s.*")


def with_zero(keys: DataFrame, states: DataFrame, key: str = "vocab_id") -> DataFrame:
    """A state for every key; the zero state for keys without events."""
    joined = keys.select(key).join(states, key, "left")
    zero = {"strength": F.lit(0.0), "box": F.lit(0), "streak": F.lit(0), "successes": F.lit(0), "failures": F.lit(0), "learned": F.lit(False)}
    return joined.select(key, *[F.coalesce(F.col(c), zero[c]).alias(c) if c in zero else F.col(c) for c in states.columns if c != key])
