"""Roll-ups and group metrics (E-01 to E-03, F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, rollups
from .tables import EVALUATIONS, evaluations, sentences, sql_intl, sql_tokens, table

GROUPED = "SELECT {keys}, metric_name, scope, cell, round(value, 6) AS value, n AS count FROM g"


def _groups(spark, sf_dir):
    """Groups of a metric: every (arm, cell), and every arm pooled (cell null)."""
    rows = sentences(spark, sf_dir).select("sentence_id", "arm", F.explode(F.array("cell", F.lit(None).cast("string"))).alias("cell"), "text")
    return rows


_G = "g AS (SELECT source AS arm, lang AS cell, text, doc_id FROM documents UNION ALL SELECT source, NULL, text, doc_id FROM documents)"


def e_01(spark, sf_dir):
    return rollups.score_rollup(evaluations(spark, sf_dir), ("arm",))


def e_02(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("evaluator"), F.col("l_linestatus").alias("cell"), F.when(F.col("l_linenumber") == 7, "failed").otherwise("").alias("error"),
        F.col("l_linenumber").alias("grammaticality"), (F.col("l_quantity").cast("int") % 8).alias("naturalness"),
    )
    return rollups.axis_rollup(rows, ("grammaticality", "naturalness"))


def _density(spark, sf_dir):
    rows = sentences(spark, sf_dir)
    return rows.select("arm", "cell", F.lit("grammar").alias("evaluator"), F.when(F.col("sentence_id") % 5 != 0, F.regexp_count("text", F.lit("\\."))).alias("errors"), F.size(T.words(F.col("text"))).alias("tokens"))


def e_03(spark, sf_dir):
    return rollups.error_density(_density(spark, sf_dir), ("arm",))


def f_01(spark, sf_dir):
    return metrics.uniqueness(_groups(spark, sf_dir), "arm", "cell")


def f_02(n):
    return lambda spark, sf_dir: metrics.distinct_n(sentences(spark, sf_dir), n, "arm", "cell", pooled="cell")


def f_03(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 8).alias("grp"), F.col("item_id").alias("id"), "text")
    return metrics.self_bleu(rows)


def f_04(spark, sf_dir):
    rows = sentences(spark, sf_dir).select("arm", F.col("sentence_id").alias("id"))
    return metrics.capped_sample(rows, 20, 0, "arm").select("arm", "id", "rank")


def f_05(spark, sf_dir):
    # the three tokens come first: only these are doubled for the pooled groups
    rows = sentences(spark, sf_dir).select("arm", "cell", F.array_join(F.slice(T.words(F.col("text")), 1, 3), " ").alias("text"))
    return metrics.template_rate(rows.withColumn("cell", F.explode(F.array("cell", F.lit(None).cast("string")))), "arm", "cell")


def f_06(spark, sf_dir):
    return metrics.token_lengths(_groups(spark, sf_dir), "arm", "cell").select("arm", "cell", "mean_tokens")


def f_07(spark, sf_dir):
    return metrics.token_lengths(_groups(spark, sf_dir), "arm", "cell").select("arm", "cell", "length_cv")


def f_08(spark, sf_dir):
    rows = sentences(spark, sf_dir).select("arm", F.to_json(F.struct(F.regexp_count("text", F.lit(",")).alias("clause_count"))).alias("details"))
    parsed = rows.withColumn("c", F.from_json("details", "clause_count int")["clause_count"])
    return parsed.groupBy("arm").agg(F.round(F.coalesce(F.avg("c"), F.lit(0.0)), 4).alias("value"))


def f_09(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(F.struct(F.col("event_type").alias("category"))).alias("matches"))
    return metrics.category_histogram(rows.withColumn("cell", F.col("user_id") % 10), "cell")


def f_10(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.words(F.col("text")), " ").alias("tokens"))


QUERIES = {
    "e_01_rollup": e_01, "e_02_axis_rollup": e_02, "e_03_density": e_03, "f_01_uniqueness": f_01, "f_02_distinct_1": f_02(1), "f_02_distinct_2": f_02(2), "f_03_self_bleu": f_03,
    "f_04_capped_sample": f_04, "f_05_template_rate": f_05, "f_06_mean_tokens": f_06, "f_07_length_cv": f_07, "f_08_mean_clauses": f_08, "f_09_category_histogram": f_09, "f_10_tokens": f_10,
}

_TALL = "SELECT arm, '{k}::' || evaluator AS metric_name, scope, cell, round({k}, 6) AS value, count FROM a"
_GRAMS = f"""
WITH {_G}, t AS (SELECT arm, cell, {sql_tokens()} AS tok FROM g),
q AS (SELECT arm, cell, unnest(CASE WHEN len(tok) >= {{n}} THEN list_transform(range(1, len(tok) - {{n}} + 2), lambda i: array_to_string(tok[i:i + {{n}} - 1], ' ')) ELSE CAST([] AS VARCHAR[]) END) AS gram FROM t),
c AS (SELECT arm, cell, count(DISTINCT gram) AS d, count(*) AS n FROM q GROUP BY arm, cell), every AS (SELECT DISTINCT arm, cell FROM g)
SELECT e.arm, e.cell, round(coalesce(d / n, 0.0), 4) AS value FROM every e LEFT JOIN c ON e.arm = c.arm AND e.cell IS NOT DISTINCT FROM c.cell"""
SQL = {
    "e_01_rollup": f"""
      WITH {EVALUATIONS}, a AS (
        SELECT arm, evaluator, cell, CASE WHEN grouping(cell) = 1 THEN 'experiment' ELSE 'constraint_set' END AS scope, avg(score) AS mean, min(score) AS min,
          stddev_pop(score) AS std, avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END) AS pass_rate, count(*) AS count
        FROM ev GROUP BY GROUPING SETS ((arm, evaluator, cell), (arm, evaluator)))
      {" UNION ALL ".join(_TALL.format(k=k) for k in ("mean", "min", "std", "pass_rate"))}""",
    "e_02_axis_rollup": f"""
      WITH l AS (SELECT l_returnflag AS evaluator, l_linestatus AS cell, l_linenumber AS g, CAST(l_quantity AS INT) % 8 AS n FROM lineitem WHERE l_linenumber <> 7),
      x AS (SELECT evaluator || '.grammaticality' AS evaluator, cell, CAST(g AS DOUBLE) AS score FROM l WHERE g BETWEEN 1 AND 5
        UNION ALL SELECT evaluator || '.naturalness', cell, CAST(n AS DOUBLE) FROM l WHERE n BETWEEN 1 AND 5),
      a AS (SELECT evaluator, cell, CASE WHEN grouping(cell) = 1 THEN 'experiment' ELSE 'constraint_set' END AS scope, avg(score) AS mean, min(score) AS min, stddev_pop(score) AS std, count(*) AS count
        FROM x GROUP BY GROUPING SETS ((evaluator, cell), (evaluator)))
      {" UNION ALL ".join(_TALL.format(k=k).replace("arm, ", "") for k in ("mean", "min", "std"))}""",
    "e_03_density": f"""
      WITH s AS (SELECT source AS arm, lang AS cell, CASE WHEN doc_id % 5 <> 0 THEN length(text) - length(replace(text, '.', '')) END AS e, len({sql_tokens()}) AS t FROM documents),
      a AS (SELECT arm, cell, CASE WHEN grouping(cell) = 1 THEN 'experiment' ELSE 'constraint_set' END AS scope, sum(CASE WHEN e IS NOT NULL THEN e END) AS es,
        sum(CASE WHEN e IS NOT NULL THEN t END) AS ts, count(*) AS count FROM s GROUP BY GROUPING SETS ((arm, cell), (arm)))
      SELECT arm, 'errors_per_100w::grammar' AS metric_name, scope, cell, round(100.0 * es / ts, 6) AS value, count FROM a WHERE ts > 0""",
    "f_01_uniqueness": f"WITH {_G} SELECT arm, cell, round(count(DISTINCT lower(trim(text))) / count(*), 4) AS value FROM g GROUP BY arm, cell",
    "f_02_distinct_1": _GRAMS.replace("{n}", "1"),
    "f_02_distinct_2": _GRAMS.replace("{n}", "2"),
    "f_03_self_bleu": f"""
      WITH t AS (SELECT item_id % 8 AS grp, item_id AS id, {sql_intl()} AS tok FROM benchmark), s AS (SELECT * FROM t WHERE len(tok) > 0),
      n AS (SELECT unnest([1, 2, 3, 4]) AS n),
      g AS (SELECT grp, id, n, unnest(CASE WHEN len(tok) >= n THEN list_transform(range(1, len(tok) - n + 2), lambda i: array_to_string(tok[i:i + n - 1], ' ')) ELSE CAST([] AS VARCHAR[]) END) AS gram FROM s, n),
      c AS (SELECT grp, id, n, gram, count(*) AS c FROM g GROUP BY ALL),
      o AS (SELECT a.grp, a.id, a.n, a.gram, a.c, coalesce(max(b.c), 0) AS other FROM c a LEFT JOIN c b ON a.grp = b.grp AND a.n = b.n AND a.gram = b.gram AND a.id <> b.id GROUP BY ALL),
      h AS (SELECT grp, id, n, sum(least(c, other)) AS hit FROM o GROUP BY ALL),
      r AS (SELECT a.grp, a.id, len(a.tok) AS l, min_by(len(b.tok), abs(len(b.tok) - len(a.tok)) * 100000 + len(b.tok)) AS ref FROM s a LEFT JOIN s b ON a.grp = b.grp AND a.id <> b.id GROUP BY ALL),
      x AS (SELECT r.grp, r.id, l, ref, n.n, greatest(l - n.n + 1, 0) AS total, coalesce(hit, 0) AS hit FROM r CROSS JOIN n LEFT JOIN h ON h.grp = r.grp AND h.id = r.id AND h.n = n.n),
      y AS (SELECT *, sum(CASE WHEN total > 0 AND hit = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY grp, id ORDER BY n) AS zeros FROM x),
      z AS (SELECT grp, id, any_value(l) AS l, any_value(ref) AS ref, max(CASE WHEN n = 1 THEN hit END) AS h1,
        sum(CASE WHEN total > 0 THEN ln(CASE WHEN hit > 0 THEN hit / total ELSE 1 / (pow(2.0, zeros) * total) END) END) / count(CASE WHEN total > 0 THEN 1 END) AS m FROM y GROUP BY grp, id)
      SELECT grp, round(avg(CASE WHEN ref IS NULL OR h1 = 0 THEN 0.0 ELSE (CASE WHEN l >= ref THEN 1.0 ELSE exp(1 - ref / l) END) * exp(m) END), 4) AS value FROM z GROUP BY grp""",
    "f_04_capped_sample": """
      SELECT * FROM (SELECT source AS arm, doc_id AS id, CAST(row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) AS INT) AS rank FROM documents) WHERE rank <= 20""",
    "f_05_template_rate": f"""
      WITH {_G}, p AS (SELECT arm, cell, ({sql_tokens()})[1:3] AS prefix FROM g), c AS (SELECT arm, cell, prefix, count(*) AS n FROM p GROUP BY ALL)
      SELECT arm, cell, round(CASE WHEN sum(n) < 2 THEN 0.0 ELSE sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n) END, 4) AS value FROM c GROUP BY arm, cell""",
    "f_06_mean_tokens": f"WITH {_G} SELECT arm, cell, round(avg(len({sql_tokens()})), 4) AS mean_tokens FROM g GROUP BY arm, cell",
    "f_07_length_cv": f"""
      WITH {_G}, t AS (SELECT arm, cell, len({sql_tokens()}) AS n FROM g)
      SELECT arm, cell, round(CASE WHEN count(*) < 2 OR avg(n) = 0 THEN 0.0 ELSE stddev_pop(n) / avg(n) END, 4) AS length_cv FROM t GROUP BY arm, cell""",
    "f_08_mean_clauses": "SELECT source AS arm, round(avg(length(text) - length(replace(text, ',', ''))), 4) AS value FROM documents GROUP BY source",
    "f_09_category_histogram": """
      WITH c AS (SELECT user_id % 10 AS cell, event_type AS category, count(*) AS n FROM events GROUP BY ALL) SELECT cell, category, n, CAST(sum(n) OVER (PARTITION BY cell) AS BIGINT) AS total FROM c""",
    "f_10_tokens": f"SELECT conv_id, turn, array_to_string({sql_tokens()}, ' ') AS tokens FROM conversations",
}
