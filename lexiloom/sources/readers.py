"""Readers and row shapers for the reference's file formats."""

from __future__ import annotations

from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sampling import global_rank


def read_arms(paths: list[str], spark: SparkSession, columns: list[str], excluded: tuple[str, ...] = ()) -> DataFrame:
    """Parquet tables under one another, each row with its table's name as ``arm``."""
    stems = [(p, p.rstrip("/").rpartition("/")[2].removesuffix(".parquet")) for p in paths]
    parts = [spark.read.parquet(p).select(F.lit(stem).alias("arm"), *columns) for p, stem in stems if stem not in excluded]
    return reduce(DataFrame.unionByName, parts)


def read_yaml(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The list under ``key`` of a (small) YAML file as rows."""
    rows = (yaml.safe_load(Path(path).read_text()) or {}).get(key) or []
    return spark.createDataFrame([tuple(r.get(f.name) for f in spark.createDataFrame([], schema).schema) for r in rows], schema)


def find_preset(folders: list[str], name: str) -> dict:
    """The YAML preset of that name in the first folder that has it; samples_per_case must be 1 or more."""
    for folder in folders:
        for path in sorted(Path(folder).glob("*.yaml")):
            preset = yaml.safe_load(path.read_text()) or {}
            if preset.get("name") == name:
                if int(preset.get("samples_per_case", 5)) < 1:
                    raise ValueError(f"{name}: samples_per_case must be 1 or more")
                return preset
    raise KeyError(name)


def read_manifest(spark: SparkSession, path: str, schema: str, lang: str) -> DataFrame:
    """Rows of one language of a CSV with a header; an error if there are none."""
    rows = spark.read.csv(path, header=True, schema=schema).filter(F.col("lang") == lang)
    if rows.isEmpty():
        raise ValueError(f"no rows for {lang} in {path}")
    return rows


def read_lexicon(spark: SparkSession, path: str, schema: str, pos: str = "v") -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, nullValue="\\N").filter(F.col("pos").startswith(pos))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema).dropna("all")


def read_costs(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Cost logs of a glob such as repeat_*/*.json, with the arm from the file's name."""
    return spark.read.json(pattern, schema=schema, multiLine=True).withColumn("arm", F.regexp_extract("_metadata.file_path", "([^/]+)\\.json$", 1))


def typed_config(rows: DataFrame, column: str, fields: dict[str, tuple[str, object]]) -> DataFrame:
    """JSON fields as typed columns with defaults."""
    return rows.select("*", *[F.coalesce(F.get_json_object(column, f"$.{k}").try_cast(kind), F.lit(other)).alias(k) for k, (kind, other) in fields.items()])


def ranked_frequencies(rows: DataFrame, key: str, value: str, required: str) -> DataFrame:
    """Rows with a value and what is required, their Zipf value and their rank by it."""
    kept = rows.filter(F.col(required).isNotNull() & (F.col(value) > 0)).withColumn("zipf", F.round(F.log10(value) + 3, 9))
    return global_rank(kept, [F.desc("zipf"), F.col(key)]).withColumnRenamed("rank", "freq_rank")


def nested_results(rows: DataFrame, column: str) -> DataFrame:
    """(model, result) of maps from model to a list of results."""
    return rows.select(F.explode(column).alias("model", "results")).select("model", F.explode("results").alias("result"))


def vocab_lines(lines: DataFrame) -> DataFrame:
    """word, translation and tags of lines ``word,translation[,tag;tag]``; blanks, comments and a header are skipped."""
    rows = lines.withColumn("line", F.trim("line")).filter((F.col("line") != "") & ~F.col("line").startswith("#")).withColumn("parts", F.transform(F.split("line", ","), lambda x: F.trim(x))).filter(F.size("parts") >= 2)
    tags = F.filter(F.transform(F.split(F.coalesce(F.get("parts", F.lit(2)), F.lit("")), ";"), lambda x: F.trim(x)), lambda t: t.isin("noun", "verb", "adjective", "adverb", "preposition", "other"))
    header = (F.lower(F.col("parts")[0]) == "word") & (F.lower(F.col("parts")[1]) == "translation")
    return rows.filter(~header).select("*", F.col("parts")[0].alias("word"), F.col("parts")[1].alias("translation"), tags.alias("tags"))


def ordered_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The fields in this order; extras are ignored, missing ones are null."""
    return rows.select(*[F.col(f) if f in rows.columns else F.lit(None).cast("string").alias(f) for f in fields])


def csv_lines(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Each row's fields as one quoted CSV line."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for f in fields]
    return rows.withColumn("line", F.concat_ws(",", *quoted))
