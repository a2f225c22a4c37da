"""Rates of accepted and rejected rows with intervals, and accuracy over preferred pairs."""

from __future__ import annotations

from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def rates(rows: DataFrame, ok: Column, slices: list[list[str]], unparseable: Column | None = None) -> DataFrame:
    """n, k, rate (4 places), low and high (Wilson, 4 places) and unparseable for each value of each slice.

    All slices come from one pass of grouping sets; columns outside a row's slice are null, and ``slice`` names its columns.
    """
    keys = list(dict.fromkeys(chain.from_iterable(slices)))
    marked = rows.select(*keys, F.coalesce(ok, F.lit(False)).cast("long").alias("__ok"), (F.coalesce(unparseable, F.lit(False)) if unparseable is not None else F.lit(False)).cast("long").alias("__bad"))
    named = F.concat_ws("+", *[F.when(F.grouping(k) == 0, F.lit(k)) for k in keys])
    counts = marked.groupingSets([[F.col(k) for k in own] for own in slices], *keys).agg(named.alias("slice"), F.count("*").alias("n"), F.sum("__ok").alias("k"), F.sum("__bad").alias("unparseable"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return counts.select("slice", *keys, "n", "k", F.round(F.col("k") / F.col("n"), 4).alias("rate"), F.round(low, 4).alias("low"), F.round(high, 4).alias("high"), "unparseable")


def candidate_rates(rows: DataFrame, candidates: str, ok: str, *keys: str) -> DataFrame:
    """The same by keys and over all, for each candidate of an array of structs whose field ``ok`` says if it's right."""
    return rates(rows.select(*keys, F.explode(candidates).alias("__c")), F.col(f"__c.{ok}"), [[], list(keys)])


def pairwise_accuracy(sides: DataFrame, excluded: list[str]) -> DataFrame:
    """total_pairs, scoreable_pairs, correct and accuracy from rows (pair_id, category, preferred boolean, value).

    A pair is right if the preferred side's value is smaller. Pairs of excluded categories, and those with a missing, null or
    non-finite value, are counted but not scored; a null accuracy means that none was.
    """
    finite = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    pairs = sides.withColumn("value", finite).groupBy("pair_id").agg(F.max("category").alias("category"), F.max(F.when(F.col("preferred"), F.col("value"))).alias("a"), F.max(F.when(~F.col("preferred"), F.col("value"))).alias("b"))
    scored = ~F.coalesce(F.col("category").isin(*excluded), F.lit(False)) & F.col("a").isNotNull() & F.col("b").isNotNull()
    out = pairs.agg(F.count("*").alias("total_pairs"), F.count_if(scored).alias("scoreable_pairs"), F.count_if(scored & (F.col("a") < F.col("b"))).alias("correct"))
    return out.withColumn("accuracy", F.round(F.col("correct") / F.nullif("scoreable_pairs", F.lit(0)), 6))


def counters(rows: DataFrame, *columns: str) -> DataFrame:
    """(dimension, value, n): how often each value of each column occurs, in one pass; the total has the dimension "all"."""
    sets = [[], *[[F.col(c)] for c in columns]]
    name = F.coalesce(*[F.when(F.grouping(c) == 0, F.lit(c)) for c in columns], F.lit("all"))
    return rows.groupingSets(sets, *columns).agg(name.alias("dimension"), F.count("*").alias("n")).select("dimension", F.coalesce(*[F.col(c).cast("string") for c in columns]).alias("value"), "n")


def subsets(*columns: str) -> list[list[str]]:
    """All slices of the columns, the whole first."""
    return [list(own) for size in range(len(columns) + 1) for own in combinations(columns, size)]
