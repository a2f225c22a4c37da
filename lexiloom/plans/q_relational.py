"""Filters, joins, aggregations and window shapes whose SQL text Spark and DuckDB share (C, D, E, I, K, L)."""

from __future__ import annotations

from .tables import same_sql

_EAV = "(SELECT doc_id, 'quality' AS name, quality AS score FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)"
_LAB = "(SELECT d.doc_id, d.source AS arm, d.lang AS cell, d.n_chars, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"

SQL = {
    # predicates and projections
    "b_01_required_fields": "SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'status' ELSE 'priority' END AS missing FROM orders WHERE nullif(o_orderstatus, 'P') IS NULL OR nullif(o_orderpriority, '5-LOW') IS NULL",
    "b_02_dimension_violations": "SELECT e.event_id, e.event_type AS value FROM events e WHERE e.event_type NOT IN ('click', 'view', 'purchase') AND e.event_type IS NOT NULL",
    "b_08_gold_holes": "SELECT p.p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)",
    "b_09_minimum_guard": "SELECT count(*) AS n, count(*) >= 10 AS enough FROM benchmark",
    "b_10_ownership": "SELECT DISTINCT l.l_suppkey, l.l_partkey FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal > 0 WHERE s.s_suppkey IS NULL",
    "b_11_disjointness": "SELECT item_id AS id FROM benchmark INTERSECT SELECT conv_id FROM conversations WHERE turn = 0",
    "c_01_filter_by": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
    "c_02_in_list": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "c_03_like": "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%' OR p_type LIKE '%R' OR p_name LIKE '%1'",
    "c_06_null_default": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'participle') AS tense FROM orders",
    "c_08_pronoun_slot": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'yo' WHEN l_linenumber = 2 THEN 'tú' WHEN l_linenumber = 3 THEN 'él' WHEN l_linenumber = 4 THEN 'nosotros' WHEN l_linenumber = 5 THEN 'vosotros' ELSE 'ellos' END AS slot FROM lineitem",
    "c_13_tier": "SELECT p_partkey, CASE WHEN p_retailprice < 1200 THEN 'low' WHEN p_retailprice >= 1600 THEN 'high' ELSE 'mid' END AS tier FROM part",
    "c_14_census_semi": "SELECT p_partkey, p_size FROM part WHERE p_size > 25 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "c_15_strict_keep": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 25 AND l_returnflag = 'R' AND l_discount >= 0.05 AND l_tax <= 0.04",
    "c_17_length_bands": "SELECT b.label, count(*) AS n FROM (SELECT 'short' AS label, 2 AS lo, 5 AS hi UNION ALL SELECT 'short_expanded', 4, 8 UNION ALL SELECT 'medium', 5, 9 UNION ALL SELECT 'long', 10, 16) b JOIN part p ON p.p_size BETWEEN b.lo AND b.hi GROUP BY b.label",
    "c_20_blocklist": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '5-LOW')",
    "c_27_allowed_vocab": "SELECT p_partkey AS id, 'learned' AS kind FROM part WHERE p_size <= 10 UNION SELECT p_partkey, 'stretch' FROM (SELECT p_partkey, row_number() OVER (ORDER BY md5(concat('3:', CAST(p_partkey AS STRING))), p_partkey) AS r FROM part WHERE p_size > 10) s WHERE r <= 15",
    "c_30_counts": "SELECT count(*) AS total, count(CASE WHEN p_size > 25 THEN 1 END) AS learned, count(CASE WHEN p_size <= 25 THEN 1 END) AS remaining FROM part",
    # joins
    "d_01_inner": f"SELECT arm, count(*) AS n, round(avg(quality), 6) AS mean FROM {_LAB} x GROUP BY arm",
    "d_02_many_to_one": "SELECT o.o_orderkey, c.c_mktsegment, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey",
    "d_04_three_way": "SELECT c.c_mktsegment, o.o_orderpriority, count(*) AS n, round(avg(l.l_discount), 6) AS mean FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, o.o_orderpriority",
    "d_05_self_eav": f"SELECT q.doc_id, q.score AS quality, t.score AS toxic FROM {_EAV} q JOIN {_EAV} t ON q.doc_id = t.doc_id AND q.name = 'quality' AND t.name = 'toxic' WHERE q.score = 1",
    "d_06_pairing": f"SELECT a.score AS lt, b.score AS judge, count(*) AS n FROM {_EAV} a JOIN {_EAV} b ON a.doc_id = b.doc_id WHERE a.name = 'quality' AND b.name = 'toxic' GROUP BY a.score, b.score",
    "d_07_left_pivot": f"SELECT d.doc_id, max(CASE WHEN e.name = 'quality' THEN e.score END) AS quality, max(CASE WHEN e.name = 'toxic' THEN e.score END) AS toxic FROM documents d LEFT JOIN {_EAV} e ON d.doc_id = e.doc_id GROUP BY d.doc_id",
    "d_08_metrics_join": "SELECT r.r_name, n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE c.c_mktsegment IN ('BUILDING', 'FURNITURE') GROUP BY r.r_name, n.n_name",
    "d_09_merge_inner": "SELECT a.p_brand, a.n AS n_left, b.n AS n_right FROM (SELECT p_brand, count(*) AS n FROM part WHERE p_size < 25 GROUP BY p_brand) a JOIN (SELECT p_brand, count(*) AS n FROM part WHERE p_size >= 25 GROUP BY p_brand) b ON a.p_brand = b.p_brand",
    "d_12_outcome_join": f"SELECT x.arm, count(*) AS n, count(CASE WHEN x.quality = 1 AND c.role = 'user' THEN 1 END) AS both_ok FROM {_LAB} x JOIN conversations c ON x.doc_id = c.conv_id GROUP BY x.arm",
    "d_13_binding_gap": f"SELECT cell, count(*) AS n, round(avg(toxic), 6) AS rate FROM {_LAB} x WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY cell",
    "d_15_nullable_joins": "SELECT l.l_orderkey, l.l_linenumber, p.p_brand, s.s_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal > 5000",
    "d_16_parents_semi": "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size = 7)",
    "d_18_completeness": "SELECT DISTINCT e.event_type FROM events e LEFT JOIN (SELECT 'click' AS arm UNION ALL SELECT 'view') q ON e.event_type = q.arm WHERE q.arm IS NULL",
    "d_20_default_lookup": "SELECT o.o_orderkey, coalesce(c.c_mktsegment, 'UNK') AS tier FROM orders o LEFT JOIN (SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) c ON o.o_custkey = c.c_custkey",
    "d_21_grid": "SELECT r.r_name, n.n_name, p.o_orderpriority FROM region r CROSS JOIN (SELECT n_name FROM nation WHERE n_nationkey < 6) n CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p UNION ALL SELECT r_name, 'participle', NULL FROM region",
    # aggregations
    "e_04_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(CASE WHEN value > 0 THEN value END), 6) AS mean FROM events GROUP BY event_type",
    "e_06_score_histogram": "SELECT l_quantity AS score, count(*) AS n FROM lineitem GROUP BY l_quantity",
    "e_07_two_level": "SELECT count(CASE WHEN m = 0 THEN 1 END) AS none, count(CASE WHEN m = 1 THEN 1 END) AS every_one, count(CASE WHEN m > 0 AND m < 1 THEN 1 END) AS some FROM (SELECT o_custkey, avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) AS m FROM orders GROUP BY o_custkey) c",
    "e_08_slices": "SELECT l_returnflag, l_linestatus, l_linenumber, round(100 * avg(l_discount), 1) AS pct, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_linenumber), ())",
    "e_09_macro_average": "SELECT c_mktsegment, round(avg(m), 6) AS macro FROM (SELECT c.c_mktsegment, c.c_custkey, avg(o.o_totalprice) AS m FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment, c.c_custkey) x GROUP BY c_mktsegment",
    "e_12_reason_ranking": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_discount = 0 THEN 'no_discount' WHEN l_tax > 0.06 THEN 'high_tax' WHEN l_quantity < 10 THEN 'small' ELSE 'other' END AS reason FROM lineitem) r GROUP BY reason",
    "e_15_contingency": f"SELECT quality, toxic, n, round(n / sum(n) OVER (PARTITION BY quality), 6) AS share FROM (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY quality, toxic) c",
    "e_16_pearson": "SELECT l_returnflag, CASE WHEN count(*) >= 3 AND stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 THEN round(corr(l_quantity, l_extendedprice), 6) END AS r FROM lineitem GROUP BY l_returnflag",
    "e_18_effect_sizes": "SELECT round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) AS welch_t, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS cohen_d FROM (SELECT avg(CASE WHEN quality = 1 THEN n_chars END) AS m1, avg(CASE WHEN quality = 0 THEN n_chars END) AS m0, var_samp(CASE WHEN quality = 1 THEN n_chars END) AS v1, var_samp(CASE WHEN quality = 0 THEN n_chars END) AS v0, count(CASE WHEN quality = 1 THEN 1 END) AS n1, count(CASE WHEN quality = 0 THEN 1 END) AS n0 FROM " + _LAB + " x) y",
    "e_19_per_arm": f"SELECT arm, count(*) AS n, round(avg(quality), 6) AS pass_rate, round(avg(CASE WHEN toxic = 1 THEN quality END), 6) AS given_toxic, round(avg(CASE WHEN toxic = 0 THEN quality END), 6) AS given_clean FROM {_LAB} x GROUP BY arm",
    "e_22_multi_slice": f"SELECT arm, cell, count(*) AS n, round(avg(quality), 6) AS rate FROM {_LAB} x GROUP BY GROUPING SETS ((), (arm), (cell), (arm, cell))",
    "e_24_pass_at_k": "SELECT count(*) AS n, round(avg(first_ok), 6) AS pass_1, round(avg(any_ok), 6) AS pass_k FROM (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 AND l_discount > 0.05 THEN 1e0 ELSE 0e0 END) AS first_ok, max(CASE WHEN l_discount > 0.05 THEN 1e0 ELSE 0e0 END) AS any_ok FROM lineitem GROUP BY l_orderkey) x",
    "e_25_transitions": "SELECT count(CASE WHEN a.f AND b.f THEN 1 END) AS both_pass, count(CASE WHEN NOT a.f AND NOT b.f THEN 1 END) AS both_fail, count(CASE WHEN NOT a.f AND b.f THEN 1 END) AS rescued, count(CASE WHEN a.f AND NOT b.f THEN 1 END) AS hurt FROM (SELECT l_orderkey, l_discount > 0.05 AS f FROM lineitem WHERE l_linenumber = 1) a JOIN (SELECT l_orderkey, l_discount > 0.05 AS f FROM lineitem WHERE l_linenumber = 2) b ON a.l_orderkey = b.l_orderkey",
    "e_26_dissociation": "SELECT count(CASE WHEN k > 25 AND n <= 2 THEN 1 END) AS known_but_failing, count(CASE WHEN k > 25 AND n >= 5 THEN 1 END) AS both_ok, round(avg(n), 6) AS mean FROM (SELECT o_orderkey, max(l_quantity) AS k, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) x",
    "e_27_rate_ignoring_nulls": "SELECT d.lang, round(avg(l.quality), 6) AS rate, count(l.quality) AS valid, count(*) AS n FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang",
    "e_29_agreement_errors": f"SELECT arm, round(avg(abs(quality - toxic)), 6) AS mae, round(avg(CASE WHEN abs(quality - toxic) <= 1 THEN 1e0 ELSE 0e0 END), 6) AS within_one, round(avg(CASE WHEN quality = toxic THEN 1e0 ELSE 0e0 END), 6) AS exact FROM {_LAB} x GROUP BY arm",
    "e_31_next_position": "SELECT c.c_custkey, count(o.o_orderkey) AS n, coalesce(nullif(max(o.o_orderkey), 0), -1) + 1 AS next_position FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey",
    "e_32_count_guard": "SELECT n_regionkey, count(*) > 1 AS deletable FROM nation GROUP BY n_regionkey",
    "e_35_resume_counts": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey",
    "e_38_tier_summary": "SELECT tier, count(*) AS n, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM (SELECT p_retailprice, CASE WHEN p_retailprice < 1200 THEN 'low' WHEN p_retailprice >= 1600 THEN 'high' ELSE 'mid' END AS tier FROM part) t GROUP BY tier",
    "e_39_session_stats": "SELECT user_id, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS correct, count(CASE WHEN event_type = 'error' THEN 1 END) AS incorrect, count(CASE WHEN event_type IN ('click', 'signup') THEN 1 END) AS skipped, count(CASE WHEN event_type = 'view' THEN 1 END) AS hinted FROM events GROUP BY user_id",
    "e_40_cells_kept": "SELECT c.c_custkey, count(o.o_orderkey) AS n, count(CASE WHEN o.o_orderstatus = 'F' THEN 1 END) AS passed, round(count(CASE WHEN o.o_orderstatus = 'F' THEN 1 END) / nullif(count(o.o_orderkey), 0), 6) AS rate FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey",
    "e_42_component_recalls": "SELECT l_returnflag, round(sum(CASE WHEN l_linenumber = 1 THEN l_quantity END) / sum(CASE WHEN l_linenumber = 1 THEN 50e0 END), 6) AS aux, round(sum(CASE WHEN l_linenumber > 1 THEN l_quantity END) / sum(CASE WHEN l_linenumber > 1 THEN 50e0 END), 6) AS noun FROM lineitem GROUP BY l_returnflag",
    # sets, dedupe and windows
    "h_01_latest": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "h_02_latest_by": "SELECT o_custkey, max(o_orderkey) AS latest FROM orders GROUP BY o_custkey",
    "i_01_union": "SELECT 'customer' AS arm, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY c_nationkey UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY s_nationkey",
    "i_02_intersect": "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "i_03_except": "SELECT n_nationkey AS nation FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000",
    "i_07_distinct_rows": "SELECT DISTINCT l_shipdate, l_returnflag, l_linestatus FROM lineitem",
    "l_07_kth_copy": "SELECT a.p_size, a.k, a.p_partkey AS left_id, b.p_partkey AS right_id FROM (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 0) a JOIN (SELECT p_size, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 2 = 1) b ON a.p_size = b.p_size AND a.k = b.k",
    "l_08_share_of_total": "SELECT o_orderpriority, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority) c",
    "k_05_ladder": "SELECT event_type, round(avg(value), 6) AS ms FROM events GROUP BY event_type ORDER BY ms, event_type",
}
QUERIES = {name: same_sql(sql) for name, sql in SQL.items()}
