"""Evaluators, word scores, orders, prompts, views and queues (C, G, H, J, M, N), each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms, prompts
from ..functions import text as T
from ..operators import cost, evaluators, lexemes, paradigm, sampling, views
from .tables import VOCAB, sql_tokens, table, vocab_items

QUERIES, SQL = {}, {}


def register(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        SQL[name] = sql
        return run

    return add


_WORD = "lower(string_split(p_name, ' ')[1])"


def _word():
    return F.lower(F.split("p_name", " ")[0])


# evaluators ------------------------------------------------------------------------------------------------------------------
@register("j_13_grammar_stub", """
WITH r AS (SELECT p_partkey AS sentence_id, lower(p_name) AS s, coalesce(CASE p_size % 3 WHEN 1 THEN p_brand WHEN 2 THEN upper(p_name) END, '') AS k, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '  ' END AS t FROM part),
b AS (SELECT sentence_id, contains(s, lower(left(k, 3))) AS x, trim(t) <> '' AS y, trim(s) <> '' AS z FROM r)
SELECT sentence_id, round((CAST(x AS INT) + CAST(y AS INT) + CAST(z AS INT)) / 3e0, 4) AS score, '{"has_keyword_stem":' || x || ',"has_translation":' || y || ',"is_nonempty":' || z || '}' AS details FROM b""")
def j_13(spark, sf_dir):
    kind = F.col("p_size") % 3
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("sentence_id"), F.col("p_name").alias("text"), F.when(kind == 1, F.col("p_brand")).when(kind == 2, F.upper("p_name")).alias("keyword"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("  ").alias("translation"),
    )
    return evaluators.grammar_stub(rows).select("sentence_id", "score", "details")


@register("j_07_clause_count", f"""
WITH r AS (SELECT p_partkey AS sentence_id, list_transform({sql_tokens('p_name')}, lambda w: length(w)) AS ls FROM part),
c AS (SELECT sentence_id, len(list_filter(ls, lambda n: (n % 4 = 0 AND n % 3 < 2) OR n % 4 = 2 OR (n % 4 = 1 AND n % 3 < 2 AND n % 5 < 3))) AS n FROM r)
SELECT sentence_id, least(n, 4) / 4e0 AS score, '{{"clause_count":' || n || '}}' AS details FROM c""")
def j_07(spark, sf_dir):
    dep = lambda n: F.get(F.array(*[F.lit(d) for d in ("ROOT", "conj", "ccomp", "nsubj")]), n % 4)
    kind = lambda fits: F.when(fits, "VERB").otherwise("NOUN")
    parse = F.transform(T.words(F.col("p_name")), lambda w: F.struct(kind(F.length(w) % 3 < 2).alias("pos"), dep(F.length(w)).alias("dep"), kind(F.length(w) % 5 < 3).alias("head_pos")))
    return evaluators.clause_count(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sentence_id"), parse.alias("parse"))).select("sentence_id", "score", "details")


_CATEGORIES = ("STYLE", "AGREEMENT_VERBS", "AGREEMENT_NOUNS", "GRAMMAR", "TYPOGRAPHY", "MISSPELLING", "CONFUSIONS")
_MATCHES = f"""
m AS (SELECT p_partkey AS sentence_id, p_name, [c[p_size % 7 + 1], c[p_partkey % 7 + 1]] AS cs FROM part, (SELECT {list(_CATEGORIES)} AS c) x),
k AS (SELECT *, list_filter(cs, lambda c: c NOT IN ('STYLE', 'TYPOGRAPHY')) AS kept FROM m)"""


def _matches(spark, sf_dir):
    names = F.array(*[F.lit(c) for c in _CATEGORIES])
    one = lambda at: F.struct(F.get(names, (at % 7).cast("int")).alias("category"), F.lit("").alias("message"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sentence_id"), F.col("p_name").alias("text"), F.array(one(F.col("p_size")), one(F.col("p_partkey"))).alias("matches"))


@register("j_08_grammar", f"""
WITH {_MATCHES}
SELECT sentence_id, CASE WHEN len(kept) = 0 THEN 1e0 ELSE 0e0 END AS score, '{{"match_count":' || len(kept) || ',"total_match_count":2,"token_count":' || len({sql_tokens('p_name')}) || '}}' AS details FROM k""")
def j_08(spark, sf_dir):
    return evaluators.grammar(_matches(spark, sf_dir)).select("sentence_id", "score", "details")


@register("c_18_grammar_categories", f"WITH {_MATCHES} SELECT sentence_id, array_to_string(kept, ',') AS categories FROM k WHERE len(kept) > 0")
def c_18(spark, sf_dir):
    kept = _matches(spark, sf_dir).withColumn("kept", evaluators.of_categories(F.col("matches"))).filter(F.size("kept") > 0)
    return kept.select("sentence_id", F.array_join("kept.category", ",").alias("categories"))


@register("j_10_perplexity", """
WITH r AS (SELECT p_partkey AS sentence_id, CASE WHEN p_size % 10 <> 0 THEN p_size / 10e0 - 1 END AS nll FROM part)
SELECT sentence_id, round(CASE WHEN nll IS NULL THEN 0e0 ELSE greatest(0e0, least(1e0, exp(-nll))) END, 6) AS score, CASE WHEN nll IS NULL THEN 'no_scoreable_tokens' END AS error FROM r""")
def j_10(spark, sf_dir):
    nll = F.when(F.col("p_size") % 10 != 0, F.col("p_size") / 10 - 1)
    scored = evaluators.perplexity(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sentence_id"), nll.alias("mean_nll")))
    return scored.select("sentence_id", F.round("score", 6).alias("score"), F.get_json_object("details", "$.error").alias("error"))


# words -----------------------------------------------------------------------------------------------------------------------
@register("c_22_quality_score", """
WITH v AS (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) || ['ar', 'er', 'ir'][p_partkey % 3 + 1] AS v, p_size / 10e0 AS z FROM part)
SELECT p_partkey, round(z + CASE right(v, 2) WHEN 'ar' THEN 0.05e0 WHEN 'er' THEN 0.02e0 ELSE 0e0 END + least(0.1e0, 0.01e0 * greatest(0, length(v) - 5)), 6) AS score FROM v""")
def c_22(spark, sf_dir):
    verb = F.concat(_word(), F.get(F.array(F.lit("ar"), F.lit("er"), F.lit("ir")), (F.col("p_partkey") % 3).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(forms.quality_score(verb, F.col("p_size") / 10), 6).alias("score"))


@register("j_22_corpus_zipf", "SELECT p_partkey, round(CASE WHEN p_retailprice > 910 THEN log10(CAST(p_retailprice AS DOUBLE) - 910) + 3 ELSE 0e0 END, 6) AS zipf FROM part")
def j_22(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(forms.corpus_zipf(F.col("p_retailprice").cast("double") - 910), 6).alias("zipf"))


@register("j_52_adjacent_phrase", f"""
WITH r AS (SELECT p_partkey, list_concat({sql_tokens('p_name')}, {sql_tokens('p_name')}) AS ws FROM part), s AS (SELECT p_partkey, ws, ws[2:3] AS ph FROM r)
SELECT p_partkey, array_to_string(list_filter(range(1, len(ws) - len(ph) + 2), lambda i: ws[i:i + len(ph) - 1] = ph), ',') AS starts FROM s""")
def j_52(spark, sf_dir):
    doubled = F.concat(T.words(F.col("p_name")), T.words(F.col("p_name")))
    rows = table(spark, sf_dir, "part").select("p_partkey", doubled.alias("tokens"))
    return rows.select("p_partkey", F.array_join(T.starts_of(F.col("tokens"), F.slice("tokens", 2, 2)).cast("array<string>"), ",").alias("starts"))


@register("j_48_keyterms", f"""
WITH r AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: trim(w, '{T.ANSWER_MARKS.replace("'", "''")}')), lambda w: w <> '') AS ws FROM benchmark),
l AS (SELECT item_id, ws, list_transform(ws, lambda w: lower(w)) AS low FROM r)
SELECT item_id, array_to_string(list_filter(ws, lambda w, i: list_position(low, lower(w)) = i)[1:{T.MOST_KEYTERMS}], ' ') AS keyterms FROM l""")
def j_48(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.keyterms(F.col("text")), " ").alias("keyterms"))


# orders and picks --------------------------------------------------------------------------------------------------------------
_ZIPF_TIER = "CASE WHEN p_size < 15 THEN 'low' WHEN p_size >= 35 THEN 'high' ELSE 'mid' END"


@register("h_05_tier_order", f"SELECT p_partkey, tier, row_number() OVER (PARTITION BY tier ORDER BY p_retailprice DESC, p_partkey) AS place FROM (SELECT *, {_ZIPF_TIER} AS tier FROM part) x")
def h_05(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("tier", F.expr(_ZIPF_TIER))
    return sampling.rank_within(rows, "tier", [F.desc("p_retailprice"), F.asc("p_partkey")], "place").select("p_partkey", "tier", "place")


@register("h_18_sample_where", """
WITH h AS (SELECT *, md5('3:' || p_partkey) AS h FROM part)
SELECT * FROM (SELECT 'small' AS predicate, p_partkey FROM h WHERE p_size < 10 ORDER BY h, p_partkey LIMIT 15) a UNION ALL SELECT * FROM (SELECT 'large', p_partkey FROM h WHERE p_size > 40 ORDER BY h, p_partkey LIMIT 15) b""")
def h_18(spark, sf_dir):
    return sampling.sample_where(table(spark, sf_dir, "part"), 15, 3, "p_partkey", {"small": F.col("p_size") < 10, "large": F.col("p_size") > 40}).select("predicate", "p_partkey")


@register("h_23_fixed_pair", f"""
WITH r AS (SELECT p_partkey, p_brand, {_ZIPF_TIER} AS tier, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn FROM part),
f AS (SELECT *, CASE WHEN p_partkey = min(CASE WHEN tier = 'high' THEN p_partkey END) OVER () THEN 0 WHEN p_partkey = min(CASE WHEN tier = 'low' THEN p_partkey END) OVER () THEN 1 ELSE 2 END AS first FROM r)
SELECT p_partkey, tier FROM f ORDER BY first, turn, p_brand LIMIT 6""")
def h_23(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("tier", F.expr(_ZIPF_TIER))
    return sampling.fixed_pair(rows, 6, "tier", ("high", "low"), "p_brand", "p_partkey").select("p_partkey", "tier")


@register("h_27_shuffled_deck", "SELECT p_partkey, row_number() OVER (ORDER BY md5('8:' || p_partkey), p_partkey) AS place FROM part")
def h_27(spark, sf_dir):
    return sampling.global_rank(table(spark, sf_dir, "part").select("p_partkey"), [sampling.hash_order(8, "p_partkey"), F.asc("p_partkey")]).select("p_partkey", F.col("rank").cast("long").alias("place"))


# prompts -----------------------------------------------------------------------------------------------------------------------
@register("j_43_demonstrations", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY md5('4:' || p_partkey), p_partkey) AS k FROM part), e AS (
  SELECT p_brand, k, {_WORD} AS verb, CASE p_size % 3 WHEN 0 THEN 'to ' || p_type WHEN 1 THEN p_type ELSE '' END AS t, p_name FROM r WHERE k <= 3)
SELECT p_brand, '{prompts.HEAD}' || chr(10) || chr(10) || string_agg('Example ' || k || ' — ' || verb || ' (' || CASE WHEN t <> '' AND NOT starts_with(t, 'to ') THEN 'to ' ELSE '' END || t || '), ' || p_brand || ':' || chr(10) || p_name || chr(10) || chr(10), '' ORDER BY k) || '{prompts.END}' AS block
FROM e GROUP BY p_brand""")
def j_43(spark, sf_dir):
    kind = F.col("p_size") % 3
    sense = F.when(kind == 0, F.concat(F.lit("to "), "p_type")).when(kind == 1, F.col("p_type")).otherwise("")
    picked = sampling.per_cell(table(spark, sf_dir, "part"), 3, 4, "p_partkey", "p_brand")  # three a brand, so its list is short
    own = F.struct("rank", _word().alias("verb"), sense.alias("translation"), F.col("p_brand").alias("label"), F.col("p_name").alias("sentence"))
    return picked.groupBy("p_brand").agg(F.array_sort(F.collect_list(own)).alias("own")).select("p_brand", prompts.demonstration_block(F.col("own")).alias("block"))


# views, queues, quotas and packages ----------------------------------------------------------------------------------------------
@register("m_03_default_board", f"""
WITH {VOCAB}
SELECT id, CAST(learned AS VARCHAR) AS group_key, CASE WHEN learned THEN 'Learned' ELSE 'Not learned' END AS group_label, CAST(row_number() OVER (PARTITION BY learned ORDER BY created_at DESC, id) AS INT) AS position, word, translation FROM vocab""")
def m_03(spark, sf_dir):
    return views.apply_view(vocab_items(spark, sf_dir), views.default_view("board"), F.lit(0))


@register("g_19_seed_views", """
SELECT c_custkey AS workspace_id, CAST(i AS INT) AS position, ['All words', 'Cards', 'Review queue'][i + 1] AS name, ['📋', '🖼️', '📅'][i + 1] AS icon, ['table', 'gallery', 'table'][i + 1] AS layout
FROM (SELECT c_custkey, unnest(range(3)) AS i FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)) x""")
def g_19(spark, sf_dir):
    own = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("workspace_id"))
    return views.seeded(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace_id")), own)


@register("n_04_enqueue", """
WITH l AS (SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS lemma, CASE WHEN p_partkey % 7 <> 0 THEN 'noun' END AS pos, p_size % 4 = 0 AS untagged, CASE p_size % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'enriched' ELSE 'complete' END AS s FROM part)
SELECT id AS lexeme_id, 'pending' AS status, array_to_string(list_filter([CASE WHEN lemma = '' THEN 'lemma' END, CASE WHEN pos IS NULL THEN 'pos' END, CASE WHEN untagged THEN 'tags' END, 'gloss_primary'], lambda f: f IS NOT NULL), ',') AS requested_fields
FROM l WHERE s <> 'enriched' AND id NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)""")
def n_04(spark, sf_dir):
    size = F.col("p_size")
    entries = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(size % 5 == 0, "").otherwise(F.col("p_name")).alias("lemma"), F.when(F.col("p_partkey") % 7 != 0, "noun").alias("pos"),
        F.when(size % 4 != 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("tags"), F.lit("").alias("gloss_primary"),
        F.when(size % 3 == 0, "pending").when(size % 3 == 1, "enriched").otherwise("complete").alias("enrichment_status"),
    )
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45), "pending").otherwise("done")
    jobs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("lexeme_id"), status.alias("status"))
    return lexemes.enqueue(entries, jobs).withColumn("requested_fields", F.array_join("requested_fields", ","))


@register("h_17_capped_quotas", """
WITH s AS (SELECT p_brand, count(*) AS size, least(count(*), count(*) FILTER (p_size < 20)) AS room FROM part GROUP BY p_brand),
x AS (SELECT *, 40 * size / CAST(sum(size) OVER () AS DOUBLE) AS share FROM s), q AS (SELECT *, least(room, CAST(floor(share) AS BIGINT)) AS base FROM x),
t AS (SELECT *, 40 - sum(base) OVER () AS remaining, row_number() OVER (ORDER BY base - share, p_brand) AS turn FROM q),
e AS (SELECT p_brand, row_number() OVER (ORDER BY cycle, turn) AS k, remaining FROM (SELECT p_brand, turn, remaining, unnest(range(room - base)) AS cycle FROM t) c)
SELECT t.p_brand, t.base + count(e.k) AS quota FROM t LEFT JOIN e ON t.p_brand = e.p_brand AND e.k <= e.remaining GROUP BY t.p_brand, t.base""")
def h_17(spark, sf_dir):
    counts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("size"), F.count_if(F.col("p_size") < 20).alias("room"))
    return sampling.capped_quotas(counts, 40, "p_brand")


@register("j_49_package", f"""
WITH r AS (SELECT p_partkey, p_size, {sql_tokens('p_name')} AS ws FROM part),
f AS (SELECT p_partkey, p_size % 3 = 0 OR p_size % 3 = 1 AS aux_ok, p_size % 4 <> 1 AS particle_ok, p_size % 5 <> 0 AS form_ok, p_size % 7 = 0 AS exact FROM r)
SELECT p_partkey, aux_ok, particle_ok, form_ok, exact OR (aux_ok AND particle_ok AND form_ok) AS package_ok FROM f""")
def j_49(spark, sf_dir):
    size, tokens = F.col("p_size"), T.words(F.col("p_name"))
    none = F.array().cast("array<string>")
    aux = F.when(size % 3 == 0, none).when(size % 3 == 1, F.array(F.lit("zz"), F.get(tokens, F.lit(0)))).otherwise(F.array(F.lit("zz")))
    particle = F.when(size % 4 == 1, "zz").when(size % 4 != 0, F.get(tokens, F.lit(1)))
    wanted = F.array(F.when(size % 5 == 0, "zz").otherwise(F.get(tokens, F.lit(0))))
    packages = F.array(F.when(size % 7 == 0, tokens).otherwise(F.array(F.lit("zz"))))
    return table(spark, sf_dir, "part").select("p_partkey", paradigm.package(tokens, aux, particle, wanted, packages).alias("x")).select("p_partkey", "x.*")


@register("j_46_batch_rows", """
SELECT p_partkey, CAST(CASE WHEN p_size % 6 = 0 THEN p_size ELSE
  CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size % 4 = 2 THEN 16 ELSE 32 END WHEN 1 THEN CASE WHEN p_size % 4 = 2 THEN 4 ELSE 8 END ELSE [8, 4, 2, 4][p_size % 4 + 1] END END AS INT) AS batch_rows FROM part""")
def j_46(spark, sf_dir):
    pick = lambda of, n: F.get(F.array(*[F.lit(x) for x in of]), n.cast("int"))
    size, key = F.col("p_size"), F.col("p_partkey")
    model, workload = pick(("M-0.6B", "m-1.7b-base", "m-4B", "other"), size % 4), pick(("short", "heavy", "beam"), key % 3)
    return table(spark, sf_dir, "part").select("p_partkey", cost.batch_rows(model, workload, F.when(size % 6 == 0, size)).alias("batch_rows"))
