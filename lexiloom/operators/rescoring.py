"""Rescoring that goes on where it stopped, and results that are kept by the content that they are of."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..files import Files
from ..joins import join_spread
from .merge import to_score

PIECES = 16
#: A row of evaluations: key, evaluator, score, error.
Score = Callable[[DataFrame], DataFrame]


def stage(path: str, sentences: DataFrame, evaluations: DataFrame, evaluator: str, resume: bool = True, key: str = "sentence_id", pieces: int = PIECES) -> None:
    """Writes what a run has to score to ``path/todo``, dealt into pieces by a hash of the key; a run that was staged stays as it is.

    With ``resume`` sentences with a row of the evaluator that has no error are left out; without it, all are scored again.
    """
    spark = sentences.sparkSession
    if "todo" in Files(spark, path).finished(""):
        return
    todo = to_score(sentences, evaluations.filter(F.col("evaluator") == evaluator), key, F.col("error").isNotNull()) if resume else sentences
    dealt = todo.withColumn("piece", F.pmod(F.xxhash64(key), F.lit(pieces)).cast("int"))
    dealt.write.mode("overwrite").partitionBy("piece").parquet(f"{path}/todo")


def score_pieces(spark: SparkSession, path: str, score: Score, most: int | None = None) -> list[int]:
    """Scores the pieces that aren't finished, ``most`` of them at most, and gives those that are left.

    The ledger is what is there: a piece is one Spark job that writes ``path/done/<piece>``, and it's finished once Spark has
    marked that folder as whole. A run that was killed loses the piece it was at and no other; finished ones are never scored again.
    """
    files = Files(spark, path)
    todo = sorted(int(n.removeprefix("piece=")) for n in files.names("todo") if n.startswith("piece="))
    left = [k for k in todo if str(k) not in files.finished("done")]
    for k in left[: len(left) if most is None else most]:
        score(spark.read.parquet(f"{path}/todo/piece={k}")).write.mode("overwrite").parquet(f"{path}/done/{k}")
    return left[len(left) if most is None else most :]


def scored(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the finished pieces; None if there's none."""
    done = sorted(Files(spark, path).finished("done"), key=int)
    return spark.read.parquet(*[f"{path}/done/{k}" for k in done]) if done else None


def replaced(evaluations: DataFrame, fresh: DataFrame, evaluator: str, key: str = "sentence_id") -> DataFrame:
    """The evaluations with the evaluator's rows of the fresh sentences replaced; other evaluators' rows are untouched."""
    old = (F.col("evaluator") == evaluator) & F.col("__new").isNotNull()
    names = fresh.select(key).distinct().withColumn("__new", F.lit(True))
    kept = evaluations.join(names, key, "left").filter(~F.coalesce(old, F.lit(False))).select(*evaluations.columns)
    return kept.unionByName(fresh.select(*evaluations.columns))


def refreshed(rollups: DataFrame, evaluations: DataFrame, fresh: DataFrame, evaluator: str, group: list[str]) -> DataFrame:
    """The roll-ups (group, evaluator, mean, n, errors) with those of the evaluator computed again for the groups that have a fresh row.

    No other group's evaluations are read into the aggregate.
    """
    changed = fresh.select(*group).distinct()
    again = rolled(evaluations.filter(F.col("evaluator") == evaluator).join(changed, group, "left_semi"), group)
    stale = rollups.join(changed.withColumn("__new", F.lit(True)), group, "left")
    kept = stale.filter(~F.coalesce((F.col("evaluator") == evaluator) & F.col("__new").isNotNull(), F.lit(False)))
    return kept.select(*rollups.columns).unionByName(again.select(*rollups.columns))


def rolled(evaluations: DataFrame, group: list[str]) -> DataFrame:
    """mean and number of the scores without an error, and the number with one, by group and evaluator."""
    good = F.when(F.col("error").isNull(), F.col("score"))
    return evaluations.groupBy(*group, "evaluator").agg(F.round(F.avg(good), 9).alias("mean"), F.count(good).alias("n"), F.count("error").alias("errors"))


# results by content ----------------------------------------------------------------------------------------------------------
def digest(lang: Column, text: Column) -> Column:
    """The SHA-256 of a language and a text, null as empty."""
    return F.sha2(F.concat(F.coalesce(lang, F.lit("")), F.lit("\0"), F.coalesce(text, F.lit(""))), 256)


def cached_results(texts: DataFrame, path: str, score: Score, lang: str = "lang", text: str = "text") -> DataFrame:
    """texts with ``digest``, ``result``, ``error`` and ``cached``: results by content, each content scored once for all runs.

    ``score`` gets (digest, lang, text) of contents that the table at ``path`` doesn't have, each once, and gives (digest, result,
    error). Rows without an error are appended to the table, so a failed one is tried again by the next run; ``cached`` says that
    the result was there before. The table is only ever added to, and read by digest: two runs at once may add a content twice,
    which changes nothing. A content that a third of all rows have is one row for the scorer, and its rows stay where they are.
    """
    spark = texts.sparkSession
    rows = checkpointed(texts.withColumn("digest", digest(F.col(lang), F.col(text))))
    own = rows.groupBy("digest").agg(F.first(lang).alias("lang"), F.first(text).alias("text"))
    known = Files(spark, path).finished("") if Files(spark, path).names("") else set()
    have = spark.read.schema("digest string, result double").parquet(*[f"{path}/{k}" for k in sorted(known)]) if known else spark.createDataFrame([], "digest string, result double")
    have = have.groupBy("digest").agg(F.first("result").alias("result"))
    missing = checkpointed(own.join(have, "digest", "left_anti"))
    fresh = checkpointed(score(missing).select("digest", F.col("result").cast("double").alias("result"), F.col("error").cast("string").alias("error")))
    good = fresh.filter("error is null").select("digest", "result")
    if not good.isEmpty():
        good.write.parquet(f"{path}/{max([-1, *map(int, known)]) + 1}")
    answers = have.join(own.select("digest"), "digest", "left_semi").select("digest", "result", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached"))
    return join_spread(rows, checkpointed(answers.unionByName(fresh.withColumn("cached", F.lit(False)))), ["digest"])
