"""Metrics of groups of texts, each as grouped aggregates; a group is a value of the key columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def uniqueness(rows: DataFrame, *keys: str) -> DataFrame:
    """Different texts (trimmed, lower-cased) over texts."""
    return rows.groupBy(*keys).agg(F.round(F.count_distinct(F.lower(F.trim("text"))) / F.count("*"), 4).alias("value"))


def distinct_n(rows: DataFrame, n: int, *keys: str, pooled: str | None = None) -> DataFrame:
    """Different n-grams over n-grams of a group's texts; 0 without any. Counts per n-gram come first, so a group is never one task's.

    ``pooled``: a key for whose null all its values count once more together, as if each row came a second time with null.
    """
    tokens = rows.select(*keys, T.words(F.col("text")).alias("tokens"))  # a column, so that n-grams don't split texts again
    grams = tokens.select(*keys, F.explode_outer(T.ngrams(F.col("tokens"), n)).alias("gram"))
    counts = grams.groupBy(*keys, "gram").agg(F.count("gram").alias("n"))
    sums = counts.groupBy(*keys).agg(F.count("gram").alias("d"), F.sum("n").alias("n"))
    if pooled:
        # the counts are exchanged once more, without the pooled key; rows whose own value is null count in both
        others = [k for k in keys if k != pooled]
        every = counts.groupBy(*others, "gram").agg(F.sum("n").alias("n")).groupBy(*others).agg(F.count("gram").alias("d"), F.sum("n").alias("n"))
        every = every.withColumn(pooled, F.lit(None).cast(rows.schema[pooled].dataType)).select(*keys, "d", "n")
        sums = sums.withColumn("d", F.when(F.col(pooled).isNotNull(), F.col("d"))).union(every).groupBy(*keys).agg(F.max("d").alias("d"), F.sum("n").alias("n"))
    return sums.select(*keys, F.round(F.coalesce(F.col("d") / F.nullif("n", F.lit(0)), F.lit(0.0)), 4).alias("value"))


def template_rate(rows: DataFrame, *keys: str, k: int = 3) -> DataFrame:
    """The share of texts whose first k tokens start another text of the group too; 0 for fewer than two texts."""
    prefixes = rows.select(*keys, F.slice(T.words(F.col("text")), 1, k).alias("prefix")).groupBy(*keys, "prefix").agg(F.count("*").alias("n"))
    shared = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return prefixes.groupBy(*keys).agg(F.round(F.when(F.sum("n") < 2, 0.0).otherwise(shared / F.sum("n")), 4).alias("value"))


def token_lengths(rows: DataFrame, *keys: str) -> DataFrame:
    """The mean number of tokens, and its coefficient of variation (0 for fewer than two texts or a mean of 0)."""
    n = F.size(T.words(F.col("text")))
    mean = F.avg(n)
    cv = F.when((F.count("*") < 2) | (mean == 0), 0.0).otherwise(F.stddev_pop(n) / mean)
    return rows.groupBy(*keys).agg(F.round(mean, 4).alias("mean_tokens"), F.round(cv, 4).alias("length_cv"))


def category_histogram(matches: DataFrame, *keys: str) -> DataFrame:
    """Counts by category and their total, from rows with an array ``matches`` of structs with ``category``."""
    rows = matches.select(*keys, F.explode("matches.category").alias("category")).groupBy(*keys, "category").agg(F.count("*").alias("n"))
    return rows.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))


def _gram_counts(tokens: DataFrame, order: int) -> DataFrame:
    grams = F.array(*[F.struct(F.lit(n).alias("n"), T.ngrams(F.col("tokens"), n).alias("g")) for n in range(1, order + 1)])
    return tokens.select("grp", "id", F.explode(grams).alias("x")).select("grp", "id", "x.n", F.explode("x.g").alias("gram")).groupBy("grp", "id", "n", "gram").agg(F.count("*").alias("c"))


def sentence_bleu_terms(rows: DataFrame, order: int = 4) -> DataFrame:
    """For each text against the others of its group: clipped and all n-grams, its length and the closest other length.

    The most that any other text has of an n-gram is the group's highest count, or the second highest for the text that has the
    highest alone; so two ranks for each n-gram are enough, and no text meets another.
    """
    tokens = rows.select("grp", "id", T.intl_words(F.col("text")).alias("tokens")).filter(F.size("tokens") > 0)
    counts = _gram_counts(tokens, order)
    place = Window.partitionBy("grp", "n", "gram").orderBy(F.desc("c"), "id")
    top = counts.withColumn("r", F.row_number().over(place)).filter("r <= 2").groupBy("grp", "n", "gram").agg(
        F.max(F.when(F.col("r") == 1, F.col("c"))).alias("first"), F.max(F.when(F.col("r") == 1, F.col("id"))).alias("owner"), F.max(F.when(F.col("r") == 2, F.col("c"))).alias("second")
    )
    other = F.coalesce(F.when(F.col("id") == F.col("owner"), F.col("second")).otherwise(F.col("first")), F.lit(0))
    hits = counts.join(top, ["grp", "n", "gram"]).groupBy("grp", "id", "n").agg(F.sum(F.least("c", other)).alias("hit"))
    per = hits.groupBy("grp", "id").agg(*[F.coalesce(F.max(F.when(F.col("n") == n, F.col("hit"))), F.lit(0)).alias(f"hit{n}") for n in range(1, order + 1)])
    sizes = tokens.select("grp", "id", F.size("tokens").alias("len"))
    by_length = Window.partitionBy("grp").orderBy("len", "id")
    near = sizes.withColumn("below", F.lag("len").over(by_length)).withColumn("above", F.lead("len").over(by_length))
    closest = F.when(F.col("below").isNull(), F.col("above")).when(F.col("above").isNull(), F.col("below")).when(F.col("len") - F.col("below") <= F.col("above") - F.col("len"), F.col("below")).otherwise(F.col("above"))
    return near.withColumn("ref", closest).drop("below", "above").join(per, ["grp", "id"])


def bleu(order: int = 4) -> Column:
    """Sentence BLEU (0 to 1) of ``sentence_bleu_terms``: effective order, exponential smoothing, 0 if nothing matches."""
    penalty = F.when(F.col("len") >= F.col("ref"), 1.0).otherwise(F.exp(1 - F.col("ref") / F.col("len")))
    logs, zeros, used = F.lit(0.0), F.lit(0), F.lit(0)
    for n in range(1, order + 1):
        hit, total = F.col(f"hit{n}"), F.greatest(F.col("len") - (n - 1), F.lit(0))
        zeros = zeros + F.when((total > 0) & (hit == 0), 1).otherwise(0)
        share = F.when(hit > 0, hit / total).otherwise(1 / (F.pow(F.lit(2.0), zeros) * total))
        logs = logs + F.when(total > 0, F.ln(share)).otherwise(0.0)
        used = used + F.when(total > 0, 1).otherwise(0)
    return F.when(F.col("ref").isNull() | (F.col("hit1") == 0), 0.0).otherwise(penalty * F.exp(logs / used))


def self_bleu(rows: DataFrame) -> DataFrame:
    """(grp, value): the mean BLEU of each text against the other texts of its group; 0 for groups of one. Rows have grp, id and text."""
    scored = sentence_bleu_terms(rows).withColumn("bleu", bleu())
    return scored.groupBy("grp").agg(F.round(F.avg("bleu"), 4).alias("value"))


def capped_sample(rows: DataFrame, cap: int, seed: int = 0, *keys: str) -> DataFrame:
    """At most ``cap`` rows of each group in the order of a hash of (seed, id): the same rows on every run."""
    order = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("id"))), "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cap)
