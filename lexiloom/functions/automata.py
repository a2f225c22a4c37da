"""Token automata: progress of many sequences along a token stream, and the clauses that a generated text must and mustn't hold.

A sequence's progress is how many of its tokens the last tokens have matched. The next token goes on with it, else the sequence's
first token begins anew, any other one ends it; a sequence that was completed stays so. A clause tracker has two automata: of gold
variants, one of which must be completed, and of banned ones, the first of which that is completed ends the text for good.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import let

TRACKER = "struct<gold: array<int>, banned: array<int>, satisfied: boolean, violated: boolean>"
#: Tokens that are traced before their states join the trace, so that long streams take time in proportion.
_RUN = 64
_NONE = "array<array<string>>"


def fed(progress: Column, sequences: Column, token: Column) -> Column:
    """The progress of each sequence after one more token; a null token matches nothing."""

    def one(at: Column, sequence: Column) -> Column:
        on = (at < F.size(sequence)) & (F.get(sequence, at) == token)
        return F.when(at >= F.size(sequence), at).when(on, at + 1).when(F.get(sequence, F.lit(0)) == token, 1).otherwise(0)

    return F.zip_with(progress, sequences, one)


def completed(progress: Column, sequences: Column) -> Column:
    """The places (from 0) of the sequences that were completed; empty ones never are."""
    done = F.zip_with(progress, sequences, lambda at, s: (F.size(s) > 0) & (at >= F.size(s)))
    return F.filter(F.sequence(F.lit(0), F.size(sequences)), lambda i: F.coalesce(F.get(done, i), F.lit(False)))


def fraction(progress: Column, sequences: Column) -> Column:
    """The greatest share of a sequence that is matched; 1.0 once one was completed, 0.0 without a sequence."""
    each = F.zip_with(progress, sequences, lambda at, s: F.when(F.size(s) > 0, at / F.size(s)).otherwise(0.0))
    return F.coalesce(F.array_max(each), F.lit(0.0))


def partial(progress: Column, sequences: Column) -> Column:
    """The places of the sequences that were begun and aren't completed."""
    open_ = F.zip_with(progress, sequences, lambda at, s: (at > 0) & (at < F.size(s)))
    return F.filter(F.sequence(F.lit(0), F.size(sequences)), lambda i: F.coalesce(F.get(open_, i), F.lit(False)))


def start(gold: Column, banned: Column) -> Column:
    """The tracker before the first token."""
    zeros = lambda s: F.transform(s, lambda _: F.lit(0))
    return F.struct(zeros(gold).alias("gold"), zeros(banned).alias("banned"), F.lit(False).alias("satisfied"), F.lit(False).alias("violated"))


def tracked(state: Column, token: Column, gold: Column, banned: Column) -> Column:
    """The tracker after one more token.

    Banned sequences come first: once one is completed nothing changes any more. Gold ones are followed until one is completed.
    """
    # the progress of both automata is a value before anything asks for it, so that a token is fed once
    def banned_fed(bans: Column) -> Column:
        violated = state["violated"] | _done(bans, banned)

        def gold_fed(golds: Column) -> Column:
            satisfied = state["satisfied"] | (~violated & _done(golds, gold))
            return F.struct(golds.alias("gold"), bans.alias("banned"), satisfied.alias("satisfied"), violated.alias("violated"))

        return let(F.when(violated | state["satisfied"], state["gold"]).otherwise(fed(state["gold"], gold, token)), gold_fed)

    return let(F.when(state["violated"], state["banned"]).otherwise(fed(state["banned"], banned, token)), banned_fed)


def _done(progress: Column, sequences: Column) -> Column:
    """Whether ``completed`` has a place."""
    return F.exists(F.zip_with(progress, sequences, lambda at, s: F.coalesce((F.size(s) > 0) & (at >= F.size(s)), F.lit(False))), lambda x: x)


def progress(state: Column, gold: Column) -> Column:
    """The share of a gold variant that is matched; 1.0 once one was completed."""
    return F.when(state["satisfied"], 1.0).otherwise(fraction(state["gold"], gold))


def clauses(state: Column) -> Column:
    """How many of the two clauses hold: a gold variant was completed; no banned one was."""
    return state["satisfied"].cast("int") + (~state["violated"]).cast("int")


def beam_key(state: Column, banned: Column) -> Column:
    """What hypotheses of one group of a diverse beam share: gold completed, and which bans are begun; sorted names."""
    bans = F.transform(partial(state["banned"], F.coalesce(banned, F.array().cast(_NONE))), lambda i: F.concat(F.lit("neg_partial:"), i.cast("string")))
    return F.array_sort(F.concat(F.when(state["satisfied"], F.array(F.lit("gold"))).otherwise(F.array().cast("array<string>")), bans))


def score(log_prob: Column, state: Column, gold: Column, weight: float) -> Column:
    """The log-probability, and weight times the progress towards gold while none was completed."""
    return log_prob + weight * F.when(state["satisfied"], 0.0).otherwise(progress(state, gold))


def last(tokens: Column, gold: Column, banned: Column) -> Column:
    """The tracker after all tokens. Null arrays are empty."""
    tokens, gold, banned = _whole(tokens, gold, banned)
    return F.aggregate(tokens, start(gold, banned).cast(TRACKER), lambda s, t: tracked(s, t, gold, banned).cast(TRACKER))


def trace(tokens: Column, gold: Column, banned: Column) -> Column:
    """The tracker after each token, as an array as long as the tokens. Null arrays are empty."""
    tokens, gold, banned = _whole(tokens, gold, banned)
    kind = f"struct<now: {TRACKER}, seen: array<{TRACKER}>>"
    whole = f"struct<now: {TRACKER}, seen: array<array<{TRACKER}>>>"

    def step(s: Column, token: Column) -> Column:
        return let(tracked(s["now"], token, gold, banned).cast(TRACKER), lambda now: F.struct(now.alias("now"), F.concat(s["seen"], F.array(now)).alias("seen")).cast(kind))

    def run(s: Column, at: Column) -> Column:
        own = F.aggregate(F.slice(tokens, at, F.lit(_RUN)), F.struct(s["now"].alias("now"), F.array().cast(f"array<{TRACKER}>").alias("seen")).cast(kind), step)
        return let(own, lambda own: F.struct(own["now"].alias("now"), F.concat(s["seen"], F.array(own["seen"])).alias("seen")).cast(whole))

    runs = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens), F.lit(_RUN))).otherwise(F.array().cast("array<int>"))
    begin = F.struct(start(gold, banned).alias("now"), F.array().cast(f"array<array<{TRACKER}>>").alias("seen")).cast(whole)
    return F.flatten(F.aggregate(runs, begin, run, lambda s: s["seen"]))


def _whole(tokens: Column, gold: Column, banned: Column) -> tuple[Column, Column, Column]:
    return F.coalesce(tokens, F.array().cast("array<string>")), F.coalesce(gold, F.array().cast(_NONE)), F.coalesce(banned, F.array().cast(_NONE))
