"""Cost of runs: rows of a log, repeats, ratios and marginal costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WATTS = 165.0


def log_rows(runs: DataFrame) -> DataFrame:
    """ms_per_sentence, sentences_per_s (null for no time), tokens_mean and decode_work of runs (stored, wall_s, tokens, num_beams)."""
    n = F.greatest("stored", F.lit(1))
    mean = F.when(F.col("stored") > 0, F.col("tokens") / F.col("stored"))
    return runs.select(
        "*", F.round(1000 * F.col("wall_s") / n, 2).alias("ms_per_sentence"), F.when(F.col("wall_s") > 0, F.round(n / F.col("wall_s"), 4)).alias("sentences_per_s"),
        F.round(mean, 2).alias("tokens_mean"), F.round(F.col("num_beams") * mean, 2).alias("decode_work"),
    )


def repeats(runs: DataFrame, *arm: str) -> DataFrame:
    """Mean and sample SD (0 for one repeat) over repeats."""
    return runs.groupBy(*arm).agg(F.round(F.avg("ms"), 4).alias("mean_ms"), F.round(F.coalesce(F.stddev_samp("ms"), F.lit(0.0)), 4).alias("sd_ms"), F.count("*").alias("n"))


def to_baseline(arms: DataFrame, arm: str, base: str, value: str = "mean_ms") -> DataFrame:
    """The ratio to the baseline's value; null without a baseline."""
    one = arms.filter(F.col(arm) == base).agg(F.max(value).alias("__base"))
    return arms.join(F.broadcast(one)).withColumn("ratio", F.round(F.col(value) / F.nullif("__base", F.lit(0.0)), 4)).drop("__base")


def marginal(steps: DataFrame, arms: DataFrame) -> DataFrame:
    """Cost for each point of quality of steps (src, dst) between arms (arm, ms, quality): free, paid or dominated."""
    a, b = arms.select(F.col("arm").alias("src"), F.col("ms").alias("m0"), F.col("quality").alias("q0")), arms.select(F.col("arm").alias("dst"), F.col("ms").alias("m1"), F.col("quality").alias("q1"))
    rows = steps.join(F.broadcast(a), "src").join(F.broadcast(b), "dst").withColumn("d_ms", F.round(F.col("m1") - F.col("m0"), 4)).withColumn("d_quality", F.round(F.col("q1") - F.col("q0"), 4))
    kind = F.when(F.col("d_quality") <= 0, "dominated").when(F.col("d_ms") <= 0, "free").otherwise("paid")
    return rows.select("src", "dst", "d_ms", "d_quality", kind.alias("kind"), F.when(kind == "paid", F.round(F.col("d_ms") / F.col("d_quality"), 4)).alias("ms_per_point"))


def energy(runs: DataFrame, watts: float = WATTS) -> DataFrame:
    """GPU seconds and watt hours."""
    return runs.withColumn("gpu_s", F.round(F.col("ms") / 1000, 6)).withColumn("wh", F.round(F.col("ms") / 1000 * watts / 3600, 9))


# Marks of a model's size in its name, and rows a batch by workload and size.
SIZE_MARKS = (("0.6b", "qwen06b"), ("1.7b", "qwen17b"), ("4b", "qwen4b"))
BATCH_ROWS = {
    "short": {"qwen06b": 32, "qwen17b": 32, "qwen4b": 16, "default": 32},
    "medium": {"qwen06b": 16, "qwen17b": 16, "qwen4b": 8, "default": 16},
    "json": {"qwen06b": 16, "qwen17b": 16, "qwen4b": 8, "default": 16},
    "heavy": {"qwen06b": 8, "qwen17b": 8, "qwen4b": 4, "default": 8},
    "beam": {"qwen06b": 8, "qwen17b": 4, "qwen4b": 2, "default": 4},
}


def batch_rows(model: Column, workload: Column, override: Column) -> Column:
    """Rows a batch: the override, else by the workload and the size in the model's name; null for an unknown workload."""
    size = F.coalesce(*[F.when(F.contains(F.lower(model), F.lit(mark)), key) for mark, key in SIZE_MARKS], F.lit("default"))
    table = F.create_map(*[F.lit(x) for kind, own in BATCH_ROWS.items() for key, n in own.items() for x in (f"{kind} {key}", n)])
    return F.coalesce(override.cast("int"), F.try_element_at(table, F.concat_ws(" ", workload, size)))
