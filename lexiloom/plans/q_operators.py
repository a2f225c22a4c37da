"""Statistics, merges, samples, scoring functions, saved views and mastery (B, C, D, E, G, H, I, J, K, M, N)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import forms, judge, stats
from ..functions import text as T
from ..operators import cost, evaluators, mastery, merge, rollups, sampling, views
from .tables import EVALUATIONS, VOCAB, evaluations, mastery_events, sql_tokens, table, vocab_items

QUERIES, SQL = {}, {}
NOW = 1_700_500_000_000
_PUNCT = T.PUNCTUATION.replace("'", "''")


def register(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        SQL[name] = sql
        return run

    return add


# statistics ------------------------------------------------------------------------------------------------------------------
@register("e_14_agreement", """
WITH c AS (SELECT t.t AS threshold, count(CASE WHEN l_linenumber >= t.t AND l_quantity >= 25 THEN 1 END) AS tp, count(CASE WHEN l_linenumber < t.t AND l_quantity < 25 THEN 1 END) AS tn,
  count(CASE WHEN l_linenumber >= t.t AND l_quantity < 25 THEN 1 END) AS fp, count(CASE WHEN l_linenumber < t.t AND l_quantity >= 25 THEN 1 END) AS fn FROM lineitem CROSS JOIN (SELECT unnest([3, 4, 5]) AS t) t GROUP BY t.t)
SELECT threshold, tp, tn, fp, fn, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1,
  round(tn / (tn + fn), 6) AS npv, round(((tp + tn) / (tp + tn + fp + fn) - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn)))
  / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn))), 6) AS kappa,
  round((tp * tn - fp * fn) / sqrt(CAST((tp + fp) * (tp + fn) AS DOUBLE) * CAST((tn + fp) * (tn + fn) AS DOUBLE)), 6) AS mcc FROM c""")
def e_14(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity", F.explode(F.array(*[F.lit(t) for t in (3, 4, 5)])).alias("threshold"))
    said, true = F.col("l_linenumber") >= F.col("threshold"), F.col("l_quantity") >= 25
    counts = rows.groupBy("threshold").agg(F.count_if(said & true).alias("tp"), F.count_if(~said & ~true).alias("tn"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & true).alias("fn"))
    return counts.select("*", *[F.round(c, 6).alias(k) for k, c in stats.agreement(*map(F.col, ("tp", "tn", "fp", "fn"))).items()])


@register("e_20_wilson", """
WITH c AS (SELECT d.source AS arm, count(*) AS n, count(CASE WHEN l.quality = 1 THEN 1 END) AS k FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source)
SELECT arm, n, k, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) - 1.96 / (1 + 1.96 * 1.96 / n) * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))), 6) AS low,
  round(least(1, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) + 1.96 / (1 + 1.96 * 1.96 / n) * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))), 6) AS high FROM c""")
def e_20(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("arm")).agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rows.select("*", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register("e_10_pivot", f"""
WITH {EVALUATIONS} SELECT sentence_id, max(CASE WHEN evaluator = 'length_in_band' THEN score END) AS length_in_band, round(max(CASE WHEN evaluator = 'type_token' THEN score END), 6) AS type_token FROM ev GROUP BY sentence_id""")
def e_10(spark, sf_dir):
    return rollups.pivot_scores(evaluations(spark, sf_dir), ["length_in_band", "type_token"]).withColumn("type_token", F.round("type_token", 6))


@register("e_13_upper_median", "SELECT l_returnflag, list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median, count(DISTINCT l_quantity) AS different FROM lineitem GROUP BY l_returnflag")
def e_13(spark, sf_dir):
    # counts per value first: the rows of a group are never gathered
    counts = rollups.histogram(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")
    w = Window.partitionBy("l_returnflag")
    placed = counts.withColumn("upto", F.sum("n").over(w.orderBy("l_quantity"))).withColumn("all", F.sum("n").over(w))
    return placed.groupBy("l_returnflag").agg(F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("l_quantity"))).alias("upper_median"), F.count("*").alias("different"))


@register("e_11_flag_histogram", """
WITH f AS (SELECT lang, unnest(list_filter([CASE WHEN n_chars > 3000 THEN 'long' END, CASE WHEN text LIKE '%' || chr(10) || '%' THEN 'lines' END, CASE WHEN n_chars < 500 THEN 'short' END], lambda x: x IS NOT NULL)) AS flag FROM documents)
SELECT lang, flag, count(*) AS n FROM f GROUP BY lang, flag""")
def e_11(spark, sf_dir):
    flags = F.array_compact(F.array(F.when(F.col("n_chars") > 3000, "long"), F.when(F.contains("text", F.lit("\n")), "lines"), F.when(F.col("n_chars") < 500, "short")))
    return table(spark, sf_dir, "documents").select("lang", F.explode(flags).alias("flag")).groupBy("lang", "flag").agg(F.count("*").alias("n"))


@register("e_30_gate", """
SELECT source, array_to_string(list_filter([CASE WHEN avg(n_chars) < 2500 THEN 'length' END, CASE WHEN count(*) < 51 THEN 'size' END], lambda x: x IS NOT NULL), ',') AS failed FROM documents GROUP BY source""")
def e_30(spark, sf_dir):
    failed = F.array_join(F.array_compact(F.array(F.when(F.avg("n_chars") < 2500, "length"), F.when(F.count("*") < 51, "size"))), ",")
    return table(spark, sf_dir, "documents").groupBy("source").agg(failed.alias("failed"))


# merges ----------------------------------------------------------------------------------------------------------------------
@register("d_11_merge_antijoin", """
SELECT o_orderkey, o_custkey, o_orderstatus, 'kept' AS origin FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL
SELECT o_orderkey, o_custkey, o_orderstatus, 'added' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0""")
def d_11(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    target = rows.filter("o_orderkey % 3 <> 0").withColumn("origin", F.lit("kept"))
    return merge.insert_absent(rows.filter("o_orderkey % 2 = 0").withColumn("origin", F.lit("added")), target, ["o_orderkey"])


@register("d_10_natural_key_remap", """
SELECT c.c_custkey, n.n_nationkey + 100 AS c_nationkey FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE n.n_nationkey < 20""")
def d_10(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    source = n.select(F.col("n_nationkey").alias("id"), "n_name", "n_regionkey")
    target = n.filter("n_nationkey < 20").select((F.col("n_nationkey") + 100).alias("id"), "n_name", "n_regionkey")
    return merge.remap(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), source, target, "c_nationkey", ["n_name", "n_regionkey"])[0]


@register("g_02_upsert", """
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '*' ELSE p_brand END AS p_brand, p_size FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def g_02(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    source = rows.filter("p_partkey % 2 = 0").withColumn("p_brand", F.concat("p_brand", F.lit("*")))
    return merge.upsert(source, rows.filter("p_partkey % 3 = 0"), ["p_partkey"], ["p_brand"])


@register("g_03_recompute", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 0.5 ELSE l_discount END AS value FROM lineitem")
def g_03(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_discount").alias("value"))
    stale = F.col("l_returnflag") == "R"
    return merge.recompute(rows, rows.filter(stale).withColumn("value", F.lit(0.5)), stale).drop("l_returnflag")


@register("g_04_resume", "SELECT o_orderkey FROM orders WHERE NOT (o_orderkey % 2 = 0 AND coalesce(o_orderstatus, '') <> 'F')")
def g_04(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return merge.to_score(items.select("o_orderkey"), items.filter("o_orderkey % 2 = 0"), "o_orderkey", F.col("o_orderstatus") == "F")


@register("g_05_archive_replace", """
SELECT doc_id, CASE WHEN quality = 0 THEN 'judge_superseded' ELSE 'judge' END AS evaluator, CAST(quality AS DOUBLE) AS score, CASE WHEN quality = 0 THEN 'v1' ELSE 'v2' END AS version FROM labels
UNION ALL SELECT doc_id, 'judge', 0.9, 'v2' FROM labels WHERE quality = 0""")
def g_05(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    live = rows.select("doc_id", F.lit("judge").alias("evaluator"), F.col("quality").cast("double").alias("score"), F.when(F.col("quality") == 0, "v1").otherwise("v2").alias("version"))
    fresh = rows.select("doc_id", F.lit("judge").alias("evaluator"), F.lit(0.9).alias("score"), F.lit("v2").alias("version"))
    return merge.archive_replace(live, fresh, ["doc_id"], "judge", "version", "v2")


@register("g_07_work_queue", "SELECT c_custkey, have, 10 - have AS missing FROM (SELECT c.c_custkey, count(o.o_orderkey) AS have FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey) WHERE have < 10")
def g_07(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return merge.work_queue(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", 10)


@register("g_11_duplicate_lexemes", """
WITH c AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY lower(p_brand), p_size) AS canonical FROM part)
SELECT l_suppkey, canonical AS l_partkey, min(l_orderkey * 10 + l_linenumber) AS id, count(*) AS merged FROM lineitem JOIN c ON l_partkey = c.id GROUP BY l_suppkey, canonical""")
def g_11(spark, sf_dir):
    canon = merge.canonical(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id"), [T.key(F.col("p_brand")), F.col("p_size")])
    links = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return merge.repoint(links, canon, "l_suppkey", "l_partkey")


@register("g_16_cascade_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def g_16(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return merge.cascade(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey").select("o_orderkey", "o_custkey")


@register("i_05_first_dedupe", "SELECT c_mktsegment, c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_mktsegment, c_nationkey")
def i_05(spark, sf_dir):
    return merge.first_by(table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey", "c_custkey"), ["c_mktsegment", "c_nationkey"], [F.col("c_custkey")])


# samples ---------------------------------------------------------------------------------------------------------------------
@register("h_04_best_per_cell", """
SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY least(l_quantity / 50, l_discount * 10) DESC, l_quantity DESC, l_discount DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1""")
def h_04(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return sampling.best_per_cell(rows, ["l_orderkey"], [F.least(F.col("l_quantity") / 50, F.col("l_discount") * 10), F.col("l_quantity"), F.col("l_discount")], "l_linenumber")


_TIER = "CASE WHEN p_retailprice < 1200 THEN 'low' WHEN p_retailprice >= 1600 THEN 'high' ELSE 'mid' END"


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", forms.tier(F.col("p_retailprice"), 1200, 1600).alias("tier"), (F.col("p_size") % 2).alias("odd"))


@register("h_07_stratified_sample", f"""
SELECT p_partkey, tier, odd, CAST(r AS INT) AS rank FROM (SELECT p_partkey, {_TIER} AS tier, p_size % 2 AS odd, row_number() OVER (PARTITION BY {_TIER}, p_size % 2 ORDER BY md5('7:' || p_partkey), p_partkey) AS r FROM part) WHERE r <= 12""")
def h_07(spark, sf_dir):
    return sampling.per_cell(_cells(spark, sf_dir), 12, 7, "p_partkey", "tier", "odd").select("p_partkey", "tier", "odd", "rank")


@register("h_08_balanced_quota", f"""
WITH o AS (SELECT p_partkey, {_TIER} AS tier, p_brand, row_number() OVER (PARTITION BY {_TIER}, p_brand ORDER BY md5('1:' || p_partkey), p_partkey) AS own FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY own > 20 // 5, md5('1:' || p_partkey), p_partkey) AS r FROM o) SELECT p_partkey, tier, p_brand FROM r WHERE r <= 20""")
def h_08(spark, sf_dir):
    return sampling.balanced(_cells(spark, sf_dir), 20, 5, 1, "p_partkey", ["tier"], "p_brand").select("p_partkey", "tier", "p_brand")


@register("h_13_terciles", """
SELECT p_partkey, CASE WHEN r <= n // 3 THEN 'low' WHEN r <= 2 * n // 3 THEN 'mid' ELSE 'high' END AS tercile FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS r, count(*) OVER () AS n FROM part)""")
def h_13(spark, sf_dir):
    return sampling.terciles(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.col("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "tercile")


@register("h_15_largest_remainder", """
WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS size FROM customer GROUP BY ALL), s AS (SELECT *, 100 * size / sum(size) OVER () AS exact FROM c),
b AS (SELECT *, CAST(floor(exact) AS BIGINT) AS base FROM s), l AS (SELECT *, 100 - sum(base) OVER () AS left_over, row_number() OVER (ORDER BY round(exact - base, 9) DESC, c_mktsegment, c_nationkey) AS r FROM b)
SELECT c_mktsegment, c_nationkey, size, base + CAST(r <= left_over AS BIGINT) AS quota FROM l""")
def h_15(spark, sf_dir):
    return sampling.largest_remainder(table(spark, sf_dir, "customer"), 100, "c_mktsegment", "c_nationkey")


@register("h_19_oversample", "SELECT p_partkey, unnest(range(1, CASE WHEN p_size > 40 THEN 4 ELSE 2 END))::INT AS copy FROM part")
def h_19(spark, sf_dir):
    return sampling.oversample(table(spark, sf_dir, "part").select("p_partkey", "p_size"), F.col("p_size") > 40, 3).select("p_partkey", "copy")


@register("h_20_train_val", """
SELECT p_partkey, CASE WHEN r <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY md5('9:' || p_partkey), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)""")
def h_20(spark, sf_dir):
    return sampling.train_val(table(spark, sf_dir, "part"), 0.1, 9, "p_partkey", "p_brand").select("p_partkey", "split")


@register("h_21_round_robin", "SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part) ORDER BY turn, p_brand LIMIT 23")
def h_21(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "part"), "p_brand", [F.col("p_partkey")], 23).select("p_brand", "p_partkey")


# scoring functions -----------------------------------------------------------------------------------------------------------
_JUDGE = """'{"grammaticality": ' || l_linenumber || ', "naturalness": 4, "semantic_coherence": 3, "target_form_use": "' || CASE WHEN l_returnflag = 'R' THEN 'absent' ELSE 'x' END || '", "flags": [' || CASE WHEN l_linestatus = 'O' THEN '"mutation_error","mutation_error"' ELSE '' END || '], "rationale": "it is the form"}'"""


@register("b_05_judge_validator", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 5 THEN 'grammaticality_out_of_range' WHEN l_returnflag <> 'R' THEN 'bad_target_form_use' WHEN l_linestatus = 'O' THEN 'duplicate_flag' END AS error FROM lineitem""")
def b_05(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", judge.judge_error(F.expr(_JUDGE)).alias("error"))


@register("b_07_language_heuristic", """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-záéíóúüñ]+)', 1) AS w FROM documents)
SELECT doc_id, len(list_filter(w, lambda x: x IN (%s))) > len(list_filter(w, lambda x: x IN (%s))) AS spanish FROM t""" % tuple(", ".join(f"'{x}'" for x in own) for own in (judge.SPANISH, judge.ENGLISH)))
def b_07(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", judge.mostly_spanish(F.col("text")).alias("spanish"))


def _mutation_sql(word: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({word}, '{a}') THEN '{b}' || substr({word}, {len(a) + 1})" for a, b in rules) + f" ELSE {word} END"


@register("j_23_mutations", "SELECT DISTINCT w, " + ", ".join(f"{_mutation_sql('w', r)} AS {n}" for n, r in (("soft", forms.SOFT), ("nasal", forms.NASAL), ("aspirate", forms.ASPIRATE))) + f" FROM (SELECT unnest({sql_tokens()}) AS w FROM benchmark)")
def j_23(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    return rows.select("w", *[forms.mutated(F.col("w"), r).alias(n) for n, r in (("soft", forms.SOFT), ("nasal", forms.NASAL), ("aspirate", forms.ASPIRATE))])


@register("j_21_spanish_regular", """
SELECT p_partkey, v || 'ar' AS verb, CASE p_size % 3 WHEN 0 THEN v || 'o' WHEN 1 THEN v || 'aste' ELSE v || 'arán' END AS form FROM (SELECT p_partkey, p_size, lower(string_split(p_name, ' ')[1]) AS v FROM part)""")
def j_21(spark, sf_dir):
    verb = F.concat(F.lower(F.split("p_name", " ")[0]), F.lit("ar"))
    third = F.col("p_size") % 3
    tense = F.when(third == 0, "present").when(third == 1, "preterite").otherwise("future")
    slot = F.when(third == 0, "1s").when(third == 1, "2s").otherwise("3p")
    return table(spark, sf_dir, "part").select("p_partkey", verb.alias("verb"), forms.spanish_regular(verb, tense, slot).alias("form"))


@register("j_34_answer_check", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'exact' WHEN 1 THEN 'lenient-pronoun' WHEN 2 THEN 'lenient-diacritic' ELSE 'mismatch' END AS kind FROM part""")
def j_34(spark, sf_dir):
    word, k = F.lower(F.split("p_name", " ")[0]), F.col("p_size") % 4
    expected = F.concat(F.lit("yo juego "), word, F.lit(" aquí"))
    given = F.when(k == 0, F.concat(F.lit(" Yo  juego "), word, F.lit(" aquí! "))).when(k == 1, F.concat(F.lit("juego "), word, F.lit(" aquí"))).when(k == 2, F.concat(F.lit("yo juego "), word, F.lit(" aqui"))).otherwise(F.lit("otra cosa"))
    return table(spark, sf_dir, "part").select("p_partkey", forms.answer_kind(given, expected).alias("kind"))


@register("j_36_spans", r"""
WITH p AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS parts FROM benchmark), e AS (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p)
SELECT item_id, parts[i] AS token, CAST(coalesce(length(array_to_string(parts[1:i - 1], '')), 0) AS INT) AS start_at, CAST(length(array_to_string(parts[1:i], '')) AS INT) AS end_at FROM e WHERE regexp_matches(parts[i], '^[\p{L}\p{N}_]')""")
def j_36(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.spans(F.col("text"))).alias("s")).filter("s.word")
    return rows.select("item_id", F.col("s.token").alias("token"), F.col("s.start").alias("start_at"), F.col("s.end").alias("end_at"))


@register("j_38_cloze", "SELECT item_id, regexp_replace(text, '(^|[^\\p{L}\\p{N}_])(' || string_split(trim(text), ' ')[2] || ')($|[^\\p{L}\\p{N}_])', '\\1____\\3') AS cloze FROM benchmark WHERE regexp_full_match(string_split(trim(text), ' ')[2], '[a-z]+') AND strpos(text, ' ' || string_split(trim(text), ' ')[2] || ' ') = length(string_split(trim(text), ' ')[1]) + 1 AND lower(string_split(trim(text), ' ')[1]) <> string_split(trim(text), ' ')[2] AND regexp_full_match(string_split(trim(text), ' ')[1], '[A-Za-z]+')")
def j_38(spark, sf_dir):
    first, second = F.split(F.trim("text"), " ")[0], F.try_element_at(F.split(F.trim("text"), " "), F.lit(2))
    rows = table(spark, sf_dir, "benchmark").filter(F.rlike(second, F.lit("^[a-z]+$")) & (F.instr("text", F.concat(F.lit(" "), second, F.lit(" "))) == F.length(first) + 1) & (F.lower(first) != second) & F.rlike(first, F.lit("^[A-Za-z]+$")))
    return rows.select("item_id", T.cloze(F.col("text"), second).alias("cloze"))


@register("j_01_expected_form", f"""
WITH t AS (SELECT item_id, text, lower({sql_tokens().replace("text", "text")}[2]) AS form FROM benchmark WHERE len({sql_tokens()}) >= 2)
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 0e0 ELSE 1e0 END AS score, CASE WHEN item_id % 3 = 0 THEN 'missing_expected_aux' END AS reason FROM t""")
def j_01(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").withColumn("form", F.get(T.words(F.col("text")), F.lit(1))).filter("form is not null")
    aux = F.when(F.col("item_id") % 3 == 0, "zzzz")
    found = evaluators.expected_form(F.col("text"), F.col("form"), F.lit(None).cast("string"), aux, F.lit(None).cast("string"), F.lit(False))
    return rows.select("item_id", found.alias("f")).select("item_id", "f.score", "f.reason")


@register("j_06_length_in_band", f"""
SELECT item_id AS sentence_id, CASE WHEN item_id % 4 = 3 THEN 0.0 WHEN item_id % 4 = 0 THEN CAST(n BETWEEN 2 AND 5 AS INT) WHEN item_id % 4 = 1 THEN CAST(n BETWEEN 5 AND 9 AS INT) ELSE CAST(n BETWEEN 10 AND 16 AS INT) END::DOUBLE AS score FROM (SELECT item_id, len({sql_tokens()}) AS n FROM benchmark)""")
def j_06(spark, sf_dir):
    k = F.col("item_id") % 4
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("sentence_id"), "text", F.when(k == 0, "short").when(k == 1, "medium").when(k == 2, "long").otherwise("huge").alias("length_label"))
    return evaluators.length_in_band(rows).select("sentence_id", "score")


@register("j_25_accent_fold", f"SELECT item_id, translate(replace(lower(text), 'ß', 'ss'), '{T.ACCENTED}', '{T.BASE}') AS folded FROM benchmark")
def j_25(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.fold_accents(F.col("text")).alias("folded"))


@register("j_41_yes_no", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS said FROM documents WHERE NOT regexp_matches(lower(text), '(^|[^a-z])(yes|no)([^a-z]|$)')")
def j_41(spark, sf_dir):
    k = F.col("doc_id") % 4
    rows = table(spark, sf_dir, "documents").filter(~F.rlike(F.lower("text"), F.lit("(^|[^a-z])(yes|no)([^a-z]|$)")))
    reply = F.concat(F.when(k == 0, "Yes! ").when(k == 1, "no, ").when(k == 2, "yes and no: ").otherwise(""), F.col("text"))
    return rows.select("doc_id", judge.yes_no(reply).cast("string").alias("said"))


@register("d_17_token_resolve", f"""
WITH w AS (SELECT doc_id, unnest(list_distinct({sql_tokens()})) AS token FROM documents), v AS (SELECT DISTINCT item_id AS id, unnest(list_distinct({sql_tokens()})) AS form FROM benchmark),
c AS (SELECT w.doc_id, w.token, count(v.id) AS n, min(v.id) AS one FROM w LEFT JOIN v ON w.token = v.form GROUP BY w.doc_id, w.token)
SELECT doc_id, count(CASE WHEN n = 1 THEN 1 END) AS sure, count(CASE WHEN n > 1 THEN 1 END) AS unsure, count(CASE WHEN n = 0 THEN 1 END) AS unknown, CAST(sum(CASE WHEN n = 1 THEN one END) AS BIGINT) AS checksum FROM c GROUP BY doc_id""")
def d_17(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("token"))
    owners = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.explode(F.array_distinct(T.words(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.min("id").alias("one"))
    rows = tokens.join(owners, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.groupBy("doc_id").agg(F.count_if(F.col("n") == 1).alias("sure"), F.count_if(F.col("n") > 1).alias("unsure"), F.count_if(F.col("n") == 0).alias("unknown"), F.sum(F.when(F.col("n") == 1, F.col("one"))).alias("checksum"))


@register("c_26_lexicon_filter", f"""
WITH allowed AS (SELECT DISTINCT unnest({sql_tokens()}) AS w FROM documents WHERE lang = 'en'), t AS (SELECT item_id, unnest({sql_tokens()}) AS w FROM benchmark)
SELECT b.item_id FROM benchmark b WHERE b.item_id NOT IN (SELECT item_id FROM t WHERE length(w) > 2 AND w NOT IN (SELECT w FROM allowed))""")
def c_26(spark, sf_dir):
    allowed = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.explode(T.words(F.col("text"))).alias("w")).distinct()
    rows = table(spark, sf_dir, "benchmark")
    bad = rows.select("item_id", F.explode(T.words(F.col("text"))).alias("w")).filter(F.length("w") > 2).join(allowed, "w", "left_anti").select("item_id").distinct()
    return rows.select("item_id").join(bad, "item_id", "left_anti")


# saved views and mastery -----------------------------------------------------------------------------------------------------
@register("c_09_lexicon_query", f"""
WITH {VOCAB} SELECT id FROM vocab WHERE contains(lower(concat_ws(' ', word, translation, lemma, '', '', translation, surface)), 'brand#1') AND list_has_any(tags, ['noun', 'verb']) AND pos IN ('noun', 'verb') AND coalesce(box, 0) >= 1 AND language = 'es'""")
def c_09(spark, sf_dir):
    query = views.Query(search="Brand#1", tags=("noun", "verb"), pos=("noun", "verb"), box_min=1, language="es")
    return vocab_items(spark, sf_dir).filter(views.condition(query, F.lit(NOW))).select("id")


@register("c_10_status_any", f"WITH {VOCAB} SELECT id FROM vocab WHERE NOT learned OR coalesce(next_due <= {NOW}, false)")
def c_10(spark, sf_dir):
    return vocab_items(spark, sf_dir).filter(views.condition(views.Query(learned="not_learned", due="due_now", status_match="any"), F.lit(NOW))).select("id")


@register("c_11_due_week", f"WITH {VOCAB} SELECT id FROM vocab WHERE next_due <= {NOW + views.WEEK_MS}")
def c_11(spark, sf_dir):
    return vocab_items(spark, sf_dir).filter(views.condition(views.from_params("due=due_week"), F.lit(NOW))).select("id")


@register("m_01_saved_view", f"""
WITH {VOCAB} SELECT id, coalesce(cefr, '') AS group_key, cefr AS group_label, CAST(row_number() OVER (PARTITION BY cefr ORDER BY coalesce(box, 0) DESC, coalesce(next_due, 9007199254740991), id) AS INT) AS position, word, translation, pos FROM vocab WHERE learned""")
def m_01(spark, sf_dir):
    view = views.View(views.Query(learned="learned"), (("box", "desc"), ("nextDue", "asc")), "cefr")
    return views.apply_view(vocab_items(spark, sf_dir), view, F.lit(NOW))


@register("m_02_groups", f"WITH {VOCAB} SELECT tags[1] AS group_key, count(*) AS n FROM vocab GROUP BY tags[1]")
def m_02(spark, sf_dir):
    return vocab_items(spark, sf_dir).groupBy(views.group_key("tags").alias("group_key")).agg(F.count("*").alias("n"))


@register("n_01_mastery_fold", """
WITH RECURSIVE e AS (SELECT user_id, ts, CASE event_type WHEN 'purchase' THEN 'c' WHEN 'error' THEN 'i' ELSE 'h' END AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('purchase', 'error', 'view')),
f AS (SELECT user_id, 0::BIGINT AS r, 0.0::DOUBLE AS strength, 0 AS box, 0 AS streak, 0 AS successes, 0 AS failures, false AS learned FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT f.user_id, e.r, round(CASE o WHEN 'c' THEN least(1.0, strength + 0.2::DOUBLE) WHEN 'i' THEN greatest(0.0, strength - 0.3::DOUBLE) ELSE least(1.0, strength + 0.05::DOUBLE) END, 6),
  CASE o WHEN 'c' THEN least(5, box + 1) WHEN 'i' THEN greatest(0, box - 1) ELSE box END, CASE o WHEN 'c' THEN streak + 1 WHEN 'i' THEN 0 ELSE streak END,
  successes + CASE WHEN o = 'c' THEN 1 ELSE 0 END, failures + CASE WHEN o = 'i' THEN 1 ELSE 0 END,
  learned OR (o <> 'h' AND CASE o WHEN 'c' THEN least(5, box + 1) ELSE greatest(0, box - 1) END >= 4) FROM f JOIN e ON f.user_id = e.user_id AND e.r = f.r + 1)
SELECT user_id AS vocab_id, strength, CAST(box AS INT) AS box, CAST(streak AS INT) AS streak, CAST(successes AS INT) AS successes, CAST(failures AS INT) AS failures, learned FROM f
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY r DESC) = 1""")
def n_01(spark, sf_dir):
    return mastery.fold(mastery_events(spark, sf_dir)).select("vocab_id", "strength", "box", "streak", "successes", "failures", "learned")


@register("n_03_zero_state", "SELECT c_custkey AS vocab_id, CAST(0 AS INT) AS box FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)")
def n_03(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vocab_id"))
    states = mastery.fold(mastery_events(spark, sf_dir))
    return mastery.with_zero(keys.join(states, "vocab_id", "left_anti"), states).select("vocab_id", "box")


# cost ------------------------------------------------------------------------------------------------------------------------
@register("k_02_repeat_stats", """
WITH r AS (SELECT event_type, day(ts) % 3 AS repeat_no, avg(value) AS ms FROM events GROUP BY ALL)
SELECT event_type, round(avg(ms), 4) AS mean_ms, round(coalesce(stddev_samp(ms), 0), 4) AS sd_ms, count(*) AS n FROM r GROUP BY event_type""")
def k_02(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("event_type", (F.dayofmonth("ts") % 3).alias("repeat_no")).agg(F.avg("value").alias("ms"))
    return cost.repeats(runs, "event_type")


@register("k_03_baseline_ratio", """
WITH m AS (SELECT event_type, round(avg(value), 4) AS mean_ms FROM events GROUP BY event_type) SELECT event_type, mean_ms, round(mean_ms / (SELECT mean_ms FROM m WHERE event_type = 'click'), 4) AS ratio FROM m""")
def k_03(spark, sf_dir):
    return cost.to_baseline(table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("mean_ms")), "event_type", "click")


@register("k_04_marginal_cost", """
WITH a AS (SELECT event_type AS arm, round(avg(value), 4) AS ms, count(DISTINCT user_id) / 10.0::DOUBLE AS quality FROM events GROUP BY event_type),
d AS (SELECT x.arm AS src, y.arm AS dst, round(y.ms - x.ms, 4) AS d_ms, round(y.quality - x.quality, 4) AS d_quality FROM a x JOIN a y ON x.arm < y.arm)
SELECT src, dst, d_ms, d_quality, CASE WHEN d_quality <= 0 THEN 'dominated' WHEN d_ms <= 0 THEN 'free' ELSE 'paid' END AS kind, CASE WHEN d_quality > 0 AND d_ms > 0 THEN round(d_ms / d_quality, 4) END AS ms_per_point FROM d""")
def k_04(spark, sf_dir):
    arms = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("arm")).agg(F.round(F.avg("value"), 4).alias("ms"), (F.count_distinct("user_id") / 10.0).alias("quality"))
    # one row for each arm: the steps between a handful of arms
    names = arms.select(F.col("arm").alias("src"))
    steps = names.join(names.withColumnRenamed("src", "dst"), F.col("src") < F.col("dst"))
    return cost.marginal(steps, arms)


@register("k_06_energy", "SELECT event_id, round(value / 1000, 6) AS gpu_s, round(value / 1000 * 165.0::DOUBLE / 3600, 9) AS wh FROM events")
def k_06(spark, sf_dir):
    return cost.energy(table(spark, sf_dir, "events").withColumnRenamed("value", "ms")).select("event_id", "gpu_s", "wh")
