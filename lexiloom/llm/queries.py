"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.shipping import ensure_on_workers

from . import byte_bpe, decontaminate, filter_audit, html_extract, language_id, line_dedup, phrase_mining, quality, simhash_dedup, substring_dedup, token_counts, token_files, topk_search
from .spark_tools import shared_folder

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_on_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_extract(_table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, with_ids=False)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")))


OP3_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), starts AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS p FROM w WHERE len(ws) >= 35
), keyed AS (
  SELECT doc_id, p, sha256(array_to_string(ws[p:p + 34], ' ')) AS k FROM starts
), again AS (
  SELECT doc_id, p FROM keyed WHERE k IN (SELECT k FROM keyed GROUP BY k HAVING count(*) > 1)
), gone AS (
  SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM again)
), places AS (
  SELECT doc_id, ws[i] AS word, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)
), kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY i) AS s, count(*) AS n
  FROM places p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.q WHERE g.q IS NULL GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(s, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) AS p FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS w
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM bw) WHERE len(ws) >= k)
), hit AS (
  SELECT dw.doc_id, dw.p, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.w = bw.w
), cover AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cover c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.simhash_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.topk_search(_table(spark, sf_dir, "embeddings"))


OP7_SQL = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, source, i, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
), shared AS (
  SELECT line FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT doc_id, i, raw, line, line IN (SELECT line FROM shared) AS gone FROM l
), per AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_gone, count(*) FILTER (NOT gone AND line <> '') AS n_left,
    string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN n_gone > 0 AND n_left > 0 THEN kept ELSE d.text END AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(CASE WHEN n_gone > 0 AND n_left > 0 THEN n_gone ELSE 0 END AS BIGINT) AS n_removed
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.digests(spark, path)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS capitals FROM t
), l AS (
  SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
    100 * capitals > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)] AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), h AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), letters AS (
  SELECT unnest([1, 2, 3, 4, 5]) AS x
), orders AS (
  SELECT [a.x, b.x, c.x, d.x, 15 - a.x - b.x - c.x - d.x] AS o FROM letters a, letters b, letters c, letters d
  WHERE len(list_distinct([a.x, b.x, c.x, d.x])) = 4
), steps AS (
  SELECT o, s, o[s] AS own, o[1:s - 1] AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)
), each AS (
  SELECT h.*, o, s, own, fails[own] AS now, len(list_filter(before, lambda i: fails[i])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS many FROM h, steps
), counts AS (
  SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, s AS step, own,
    CAST(coalesce(sum(n) FILTER (NOT now AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (now AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (now AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (now AND many = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (now AND NOT gone), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (now AND NOT gone), 0) AS BIGINT) AS toxic_lost
  FROM each GROUP BY part, o, s, own
)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counts
"""


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.phrase_mining(_table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, ws FROM (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces) WHERE len(ws) > 0
), totals AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang
), starts AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), grams AS (
  SELECT lang, ws[i:i + k - 1] AS p FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(ws)
), f AS (
  SELECT lang, p, count(*) AS a FROM grams GROUP BY lang, p HAVING count(*) >= 100
), cuts AS (
  SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1
), scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.a AS l, y.a AS r, t.n, CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:] JOIN totals t ON t.lang = c.lang
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), inside AS (
  SELECT lang, q[i:i + k - 1] AS p, max(a) AS b
  FROM (SELECT lang, p AS q, a, k, unnest(range(1, len(p) - k + 2)) AS i FROM f, (SELECT unnest([2, 3, 4]) AS k) WHERE k < len(p)) GROUP BY ALL
), kept AS (
  SELECT least.* FROM least LEFT JOIN inside i ON i.lang = least.lang AND i.p = least.p WHERE i.b IS NULL OR 100 * i.b < 100 * least.a
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM kept
) WHERE rank <= 2000
"""


def queries() -> dict[str, Query]:
    return {
        "op1_html_extract": op1_html_extract,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_decontaminate": op4_decontaminate,
        "op5_simhash_dedup": op5_simhash_dedup,
        "op6_language_id": op6_language_id,
        "op7_topk_search": op7_topk_search,
        "op8_line_dedup": op8_line_dedup,
        "op9_token_counts": op9_token_counts,
        "op10_quality": op10_quality,
        "op11_token_files": op11_token_files,
        "op12_filter_audit": op12_filter_audit,
        "op13_phrase_mining": op13_phrase_mining,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_dedup": OP3_SQL, "op4_decontaminate": OP4_SQL, "op7_topk_search": OP7_SQL, "op8_line_dedup": OP8_SQL, "op12_filter_audit": OP12_SQL, "op13_phrase_mining": OP13_SQL}
