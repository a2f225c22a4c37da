"""Roll-ups of the tall evaluation table into the tall metric table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS = 0.5


def _both_scopes(rows: DataFrame, keys: list[str], aggregates: list[Column], cell: str = "cell") -> DataFrame:
    """One pass for each cell and for all cells pooled."""
    grouped = rows.groupingSets([[*keys, cell], keys], *keys, cell).agg(*aggregates, F.grouping(cell).alias("pooled"))
    return grouped.withColumn("scope", F.when(F.col("pooled") == 1, "experiment").otherwise("constraint_set")).drop("pooled")


def _tall(rows: DataFrame, kinds: list[str], keys: list[str], name: Column) -> DataFrame:
    long = rows.unpivot([*keys, "evaluator", "scope", "cell", "count"], kinds, "kind", "value")
    return long.select(*keys, F.concat_ws("::", "kind", name).alias("metric_name"), "scope", "cell", F.round("value", 6).alias("value"), "count")


def score_rollup(evaluations: DataFrame, keys: tuple[str, ...] = (), threshold: float = PASS) -> DataFrame:
    """mean, min, population std and pass_rate of (evaluator, cell, score), as rows ``<kind>::<evaluator>`` in both scopes."""
    keys = list(keys)
    score = F.col("score")
    grouped = _both_scopes(
        evaluations, [*keys, "evaluator"],
        [F.avg(score).alias("mean"), F.min(score).alias("min"), F.stddev_pop(score).alias("std"), F.avg((score >= threshold).cast("double")).alias("pass_rate"), F.count("*").alias("count")],
    )
    return _tall(grouped, ["mean", "min", "std", "pass_rate"], keys, F.col("evaluator"))


def axis_rollup(evaluations: DataFrame, axes: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """mean, min and std of detail axes (integer columns, 1 to 5); other values and rows with an error are left out."""
    keys = list(keys)
    rows = evaluations.filter(F.coalesce("error", F.lit("")) == "").unpivot([*keys, "evaluator", "cell"], list(axes), "axis", "score")
    rows = rows.filter(F.col("score").between(1, 5)).withColumn("score", F.col("score").cast("double"))
    rows = rows.withColumn("evaluator", F.concat_ws(".", "evaluator", "axis"))
    grouped = _both_scopes(rows, [*keys, "evaluator"], [F.avg("score").alias("mean"), F.min("score").alias("min"), F.stddev_pop("score").alias("std"), F.count("*").alias("count")])
    return _tall(grouped, ["mean", "min", "std"], keys, F.col("evaluator"))


def error_density(evaluations: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """100 * errors / tokens, a ratio of sums over rows with both counts; count is that of all scored rows."""
    keys = list(keys)
    both = F.col("errors").isNotNull() & F.col("tokens").isNotNull()
    grouped = _both_scopes(
        evaluations, [*keys, "evaluator"],
        [F.sum(F.when(both, F.col("errors"))).alias("e"), F.sum(F.when(both, F.col("tokens"))).alias("t"), F.count("*").alias("count")],
    )
    rows = grouped.filter("t > 0").withColumn("errors_per_100w", 100.0 * F.col("e") / F.col("t"))
    return _tall(rows, ["errors_per_100w"], keys, F.col("evaluator"))


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def pivot_scores(evaluations: DataFrame, names: list[str], by: str = "sentence_id") -> DataFrame:
    """One row for each sentence with a column for each evaluator (the highest score if scored twice)."""
    return evaluations.groupBy(by).agg(*[F.max(F.when(F.col("evaluator") == n, F.col("score"))).alias(n) for n in names])
