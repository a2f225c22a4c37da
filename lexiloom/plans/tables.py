"""Stand-ins: the reference data model over the driver's tables, in Spark and as SQL text."""

from __future__ import annotations

import re
from functools import reduce
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task of ``dealt``.
_EACH = 1 << 15


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table for work that costs much for each row, in even parts for all cores, of 32,768 rows at most.

    Narrow rows are few bytes: a table of a million may be one file, and so one task.
    """
    rows = table(spark, sf_dir, name)
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // _EACH)))


def same_sql(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose text Spark and DuckDB share."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    # tables are arguments of the text, so that no view of the user's is replaced
    text = reduce(lambda s, t: re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{{{t}}}", s), used, sql)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(text, **{name: table(spark, sf_dir, name) for name in used})

    return run


def sql_tokens(text: str = "text") -> str:
    """The tokens of functions.text.words in DuckDB."""
    punctuation = T.PUNCTUATION.replace("'", "''")
    return f"list_filter(list_transform(regexp_split_to_array(lower(trim({text})), '\\s+'), lambda w: translate(w, '{punctuation}', '')), lambda w: w <> '')"


def sql_intl(text: str = "text") -> str:
    """The tokens of functions.text.intl_words in DuckDB."""
    apart = f"regexp_replace(regexp_replace({text}, '(\\PN)(\\pP)', '\\1 \\2 ', 'g'), '(\\pP)(\\PN)', ' \\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array(trim(regexp_replace({apart}, '(\\pS)', ' \\1 ', 'g')), '\\s+'), lambda w: w <> '')"


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences: documents as (sentence_id, arm, cell, text)."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sentence_id"), F.col("source").alias("arm"), F.col("lang").alias("cell"), "text")


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tall evaluation table: three scores of each sentence by arm and cell."""
    rows = sentences(spark, sf_dir).withColumn("tok", T.words(F.col("text")))
    n = F.size("tok")
    scores = {
        "length_in_band": n.between(100, 600).cast("double"),
        "type_token": F.when(n > 0, F.size(F.array_distinct("tok")) / n).otherwise(0.0),
        "ends_with_stop": F.rlike("text", F.lit("[.!?]$")).cast("double"),
    }
    each = F.array(*[F.struct(F.lit(k).alias("evaluator"), v.alias("score")) for k, v in scores.items()])
    return rows.select("sentence_id", "arm", "cell", F.explode(each).alias("e")).select("sentence_id", "arm", "cell", "e.*")


EVALUATIONS = f"""
ev AS (
  WITH s AS (SELECT doc_id AS sentence_id, source AS arm, lang AS cell, text, {sql_tokens()} AS tok FROM documents)
  SELECT sentence_id, arm, cell, 'length_in_band' AS evaluator, CAST(len(tok) BETWEEN 100 AND 600 AS INT)::DOUBLE AS score FROM s
  UNION ALL SELECT sentence_id, arm, cell, 'type_token', CASE WHEN len(tok) > 0 THEN len(list_distinct(tok)) / len(tok) ELSE 0.0 END FROM s
  UNION ALL SELECT sentence_id, arm, cell, 'ends_with_stop', CAST(regexp_matches(text, '[.!?]$') AS INT)::DOUBLE FROM s
)"""


def mastery_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*[F.lit(x) for pair in (("purchase", "correct"), ("error", "incorrect"), ("view", "hinted")) for x in pair])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("vocab_id"), "ts", "event_id", F.coalesce(kinds[F.col("event_type")], F.lit("skipped")).alias("outcome"))


def vocab_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary items: parts with derived properties; some have no mastery."""
    p = table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    key = F.col("p_partkey")
    mastery = F.when(key % 4 != 0, F.struct((key % 6).cast("int").alias("box"), (F.lit(1_700_000_000_000) + key * 86_400_000 % 2_000_000_000).alias("next_due")))
    return p.select(
        key.alias("id"), F.lit(1).alias("workspace_id"), F.col("p_name").alias("word"), F.col("p_brand").alias("translation"),
        F.element_at(F.array(F.lit("es"), F.lit("he"), F.lit("fr")), (key % 3 + 1).cast("int")).alias("language"),
        F.array(F.element_at(F.array(*[F.lit(t) for t in ("noun", "verb", "adjective", "adverb")]), (key % 4 + 1).cast("int")), F.col("p_type")).alias("tags"),
        (key % 2 == 0).alias("learned"), (F.lit(1_690_000_000_000) + key * 1000).alias("created_at"), F.lower(words[0]).alias("lemma"), F.lit(None).cast("string").alias("surface_form"),
        F.array(F.upper(words[0])).alias("surface_forms"), F.when(key % 7 != 0, F.element_at(F.array(F.lit("noun"), F.lit("verb")), (key % 2 + 1).cast("int"))).alias("pos"),
        F.element_at(F.array(F.lit("A1"), F.lit("A2"), F.lit("B1")), (F.col("p_size") % 3 + 1).cast("int")).alias("cefr"), F.lit(None).cast("string").alias("gender"), F.lit(None).cast("string").alias("ipa"),
        F.lit("").alias("gloss_primary"), F.array(F.col("p_brand")).alias("glosses"), mastery.alias("mastery"),
    )


VOCAB = """
vocab AS (
  SELECT p_partkey AS id, p_name AS word, p_brand AS translation, ['es', 'he', 'fr'][p_partkey % 3 + 1] AS language,
    [['noun', 'verb', 'adjective', 'adverb'][p_partkey % 4 + 1], p_type] AS tags, p_partkey % 2 = 0 AS learned, 1690000000000 + p_partkey * 1000 AS created_at,
    lower(string_split(p_name, ' ')[1]) AS lemma, upper(string_split(p_name, ' ')[1]) AS surface,
    CASE WHEN p_partkey % 7 <> 0 THEN ['noun', 'verb'][p_partkey % 2 + 1] END AS pos, ['A1', 'A2', 'B1'][p_size % 3 + 1] AS cefr,
    CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 6 END AS box, CASE WHEN p_partkey % 4 <> 0 THEN 1700000000000 + p_partkey * 86400000 % 2000000000 END AS next_due
  FROM part
)"""
