"""Sources and sinks: tagged multi-table scans, nested JSON, text lines, validated writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import readers
from .tables import same_sql, table

SQL = {
    "a_01_scan": "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE n_chars > 500 GROUP BY lang",
    "a_04_arm_scan": """
      SELECT arm, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM (
        SELECT 'benchmark' AS arm, text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY arm""",
    "a_07_typed_config": """
      SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INT), 0) AS k,
        coalesce(json_extract_string(props, '$.mode'), 'default') AS mode FROM events""",
    "a_11_lexicon_rows": "SELECT p_partkey, nullif(p_name, chr(92) || 'N') AS surface, p_type FROM part WHERE p_type LIKE 'S%'",
    "a_12_frequency_rank": """
      SELECT p_partkey, zipf, CAST(row_number() OVER (ORDER BY zipf DESC, p_partkey) AS BIGINT) AS freq_rank FROM (
        SELECT p_partkey, round(log10(p_retailprice) + 3, 9) AS zipf FROM part WHERE p_type IS NOT NULL AND p_retailprice > 0)""",
    "a_15_nested_results": """
      SELECT event_type AS model, k AS result, count(*) AS n FROM (
        SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) GROUP BY event_type, k""",
    "a_18_mock_rows": """
      SELECT doc_id, coalesce(b.text, 'mock ' || d.lang) AS mock FROM documents d LEFT JOIN benchmark b ON d.doc_id = b.item_id""",
    "a_19_vocab_import": r"""
      WITH l AS (SELECT item_id, trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark)
      SELECT item_id, trim(string_split(line, ',')[1]) AS word, trim(string_split(line, ',')[2]) AS translation FROM l
      WHERE line <> '' AND NOT starts_with(line, '#') AND len(string_split(line, ',')) >= 2
        AND NOT (lower(trim(string_split(line, ',')[1])) = 'word' AND lower(trim(string_split(line, ',')[2])) = 'translation')""",
    "p_02_manifest_order": "SELECT p_partkey AS id, p_name AS verb, p_size AS zipf FROM part",
    "p_06_summary_json": """
      SELECT lang, to_json({'n': count(*), 'passed': avg(n_chars) >= 1000}) AS summary FROM documents GROUP BY lang""",
    "j_40_csv_export": """
      SELECT p_partkey, '"' || replace(p_name, '"', '""') || '","' || replace(p_brand, '"', '""') || '","' || p_type || '"' AS line FROM part""",
}


def a_04(spark, sf_dir):
    rows = readers.read_arms([f"{sf_dir}/benchmark.parquet", f"{sf_dir}/conversations.parquet"], spark, ["text"])
    return rows.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"))


def a_07(spark, sf_dir):
    return readers.typed_config(table(spark, sf_dir, "events"), "props", {"k": ("int", 0), "mode": ("string", "default")}).select("event_id", "k", "mode")


def a_11(spark, sf_dir):
    rows = table(spark, sf_dir, "part")
    return rows.filter(F.col("p_type").startswith("S")).select("p_partkey", F.nullif("p_name", F.lit("\\N")).alias("surface"), "p_type")


def a_12(spark, sf_dir):
    return readers.ranked_frequencies(table(spark, sf_dir, "part"), "p_partkey", "p_retailprice", "p_type").select("p_partkey", "zipf", "freq_rank")


def a_15(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.create_map("event_type", F.array(F.from_json("props", "k int"))).alias("by_model"))
    return readers.nested_results(rows, "by_model").groupBy("model", F.col("result.k").alias("result")).agg(F.count("*").alias("n"))


def a_18(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("text", "mock")
    return d.join(b, d.doc_id == b.item_id, "left").select("doc_id", F.coalesce("mock", F.concat(F.lit("mock "), "lang")).alias("mock"))


def a_19(spark, sf_dir):
    lines = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line"))
    return readers.vocab_lines(lines).select("item_id", "word", "translation")


def p_02(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("verb"), F.col("p_size").alias("zipf"), "p_brand")
    return readers.ordered_fields(rows, ["id", "verb", "zipf"])


def p_06(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("m"))
    return rows.select("lang", F.to_json(F.struct("n", (F.col("m") >= 1000).alias("passed"))).alias("summary"))


def j_40(spark, sf_dir):
    return readers.csv_lines(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"]).select("p_partkey", "line")


QUERIES = {
    "a_01_scan": same_sql(SQL["a_01_scan"]), "a_04_arm_scan": a_04, "a_07_typed_config": a_07, "a_11_lexicon_rows": a_11, "a_12_frequency_rank": a_12,
    "a_15_nested_results": a_15, "a_18_mock_rows": a_18, "a_19_vocab_import": a_19, "p_02_manifest_order": p_02, "p_06_summary_json": p_06, "j_40_csv_export": j_40,
}
