"""Rates, selections by hash order, quotas and orderings whose SQL text Spark and DuckDB share (C, E, H, I, K, L)."""

from __future__ import annotations

from .tables import same_sql

#: A reproducible shuffle: the order of a digest of seed and key.
_SHUFFLE = "md5(concat('7:', CAST(p_partkey AS STRING)))"
_TIER = "CASE WHEN p_size < 17 THEN 'low' WHEN p_size >= 34 THEN 'high' ELSE 'mid' END"
_PARTS = f"(SELECT p_partkey, p_name, p_size, p_type, p_brand, p_retailprice, {_TIER} AS tier, {_SHUFFLE} AS h FROM part)"

SQL = {
    "c_07_resolved_default": "SELECT c_custkey, coalesce(nullif(CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END, ''), 'short') AS resolved FROM customer",
    "d_19_step_pairs": "SELECT s.a, s.b, x.n AS n_from, y.n AS n_to, y.n - x.n AS step FROM (SELECT '1-URGENT' AS a, '2-HIGH' AS b UNION ALL SELECT '2-HIGH', '3-MEDIUM') s JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY o_orderpriority) x ON s.a = x.p JOIN (SELECT o_orderpriority AS p, count(*) AS n FROM orders GROUP BY o_orderpriority) y ON s.b = y.p",
    "e_05_duration": "SELECT user_id, round((epoch_us(CAST(max(ts) AS TIMESTAMP)) - epoch_us(CAST(min(ts) AS TIMESTAMP))) / 3.6e9, 6) AS hours FROM events GROUP BY user_id",
    "e_21_filtered_rates": "SELECT round(sum(ok) / sum(n), 6) AS pooled, round(avg(ok / n), 6) AS mean_of_cases, round(avg(CASE WHEN ok = n THEN 1e0 ELSE 0e0 END), 6) AS whole FROM (SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS n, CAST(count(CASE WHEN l_discount > 0.03 THEN 1 END) AS DOUBLE) AS ok FROM lineitem GROUP BY l_orderkey) c",
    "e_33_mean_score": "SELECT o_orderpriority, avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 WHEN o_orderstatus = 'O' THEN 0e0 END) AS mean FROM orders GROUP BY o_orderpriority",
    "e_34_error_rows": "SELECT event_type, count(*) AS n, count(CASE WHEN value IS NULL OR value > 90 THEN 1 END) AS errors FROM events GROUP BY event_type",
    "e_37_case_summary": "SELECT count(*) AS n, count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS kinds, round(count(*) / CAST(count(DISTINCT p_brand) AS DOUBLE), 6) AS per_brand, count(CASE WHEN p_name IS NULL OR p_name = '' THEN 1 END) AS holes FROM part",
    "e_41_pass_rate": "SELECT l_shipdate, round(avg(CASE WHEN l_discount >= 0.05 THEN 1e0 ELSE 0e0 END), 6) AS pass_rate, count(CASE WHEN l_tax = 0 THEN 1 END) AS errors FROM lineitem GROUP BY l_shipdate",
    "e_43_strict_and_lenient": "SELECT l_linenumber, round(avg(CASE WHEN l_discount > 0.05 THEN 1e0 ELSE 0e0 END), 6) AS strict, round(avg(CASE WHEN l_discount > 0.05 OR l_tax < 0.02 THEN 1e0 ELSE 0e0 END), 6) AS lenient, count(CASE WHEN l_discount <= 0.05 AND l_tax < 0.02 THEN 1 END) AS fixed FROM lineitem GROUP BY GROUPING SETS ((l_linenumber), ())",
    "h_06_exclude_sample": f"SELECT p_partkey FROM (SELECT p.p_partkey, row_number() OVER (ORDER BY h, p.p_partkey) AS r FROM {_PARTS} p WHERE tier = 'mid' AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity = 50)) x WHERE r <= 25",
    "h_09_per_cell": f"SELECT p_partkey, p_brand FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY h, p_partkey) AS r FROM {_PARTS} p) x WHERE r <= 4",
    "h_10_pilot_quota": f"SELECT x.p_partkey, x.tier, x.irregular FROM (SELECT p_partkey, tier, p_size % 2 AS irregular, row_number() OVER (PARTITION BY tier, p_size % 2 ORDER BY h, p_partkey) AS r FROM {_PARTS} p) x JOIN (SELECT 'high' AS tier, 0 AS irregular, 6 AS quota UNION ALL SELECT 'high', 1, 6 UNION ALL SELECT 'low', 0, 4 UNION ALL SELECT 'low', 1, 4) q ON x.tier = q.tier AND x.irregular = q.irregular WHERE x.r <= q.quota",
    "h_11_blocked_swap": f"SELECT b.p_brand, b.p_partkey AS blocked, c.p_partkey AS replacement FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM {_PARTS} p WHERE p_size = 1) b LEFT JOIN (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY h, p_partkey) AS k FROM {_PARTS} p WHERE p_size > 40) c ON b.p_brand = c.p_brand AND b.k = c.k",
    "h_14_per_tier": f"SELECT tier, p_partkey FROM (SELECT tier, p_partkey, row_number() OVER (PARTITION BY tier ORDER BY h, p_partkey) AS r FROM {_PARTS} p) x WHERE r <= 10",
    "h_22_backfill": f"SELECT target, p_partkey, r FROM (SELECT t.p_partkey AS target, p.p_partkey, row_number() OVER (PARTITION BY t.p_partkey ORDER BY CASE WHEN p.p_size = t.p_size THEN 0 ELSE 1 END, p.h, p.p_partkey) AS r FROM (SELECT p_partkey, p_size, p_type, p_brand FROM part WHERE p_partkey <= 20) t JOIN {_PARTS} p ON p.p_brand = t.p_brand AND p.p_partkey <> t.p_partkey) x WHERE r <= 3",
    "i_06_distinct_values": "SELECT DISTINCT o_orderpriority AS version FROM orders WHERE o_orderpriority IS NOT NULL",
    "k_01_cost_row": "SELECT user_id, round(1000e0 * s / CASE WHEN n > 1 THEN n ELSE 1 END, 3) AS ms_per_row, CASE WHEN s > 0 THEN round(n / s, 4) END AS rows_per_s FROM (SELECT user_id, count(*) AS n, sum(value) AS s FROM events GROUP BY user_id) x",
    "k_07_counters": "SELECT role, count(*) AS calls, sum(length(text)) AS total, round(avg(length(text)), 6) AS mean FROM conversations GROUP BY role",
    "l_03_repeated_prefix": "SELECT doc_id, count(*) OVER (PARTITION BY lang, substr(text, 1, 20)) > 1 AS repeated FROM documents",
    "l_05_first_after_shuffle": f"SELECT tier, p_partkey FROM (SELECT tier, p_partkey, row_number() OVER (PARTITION BY tier ORDER BY md5(concat('11:', CAST(p_partkey AS STRING))), p_partkey) AS r FROM {_PARTS} p) x WHERE r = 1",
    "l_10_first_occurrence": "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) x WHERE r = 1",
}
#: The one function that the two name differently.
QUERIES = {name: same_sql(sql.replace("epoch_us", "unix_micros")) for name, sql in SQL.items()}
