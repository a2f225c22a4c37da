"""Paradigms, bans, lexemes, merges of runs, selections and validation (B, C, D, E, G, H, J, N), each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import forms
from ..functions import text as T
from ..operators import bans, lexemes, merge, paradigm, ranks, sampling, validation
from .tables import dealt, sql_tokens, table

QUERIES, SQL = {}, {}


def register(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        SQL[name] = sql
        return run

    return add


# paradigms -------------------------------------------------------------------------------------------------------------------
_STEM = "lower(string_split(p_name, ' ')[1])"
_ENDS = ("o", "as", "a", "amos", "áis", "an")
_NAMES = ("yo", "tú", "él", "nosotros", "vosotros", "ellos")


def _paradigms(spark, sf_dir):
    """Replies of four kinds to six gold forms: labelled and right, by place and right, labels turned round, two forms only."""
    part = dealt(spark, sf_dir, "part").withColumn("v", F.lower(F.split("p_name", " ")[0]))
    gold = [F.concat("v", F.lit(e)) for e in _ENDS]
    labelled = lambda order: F.concat_ws("\n", *[F.concat(F.lit(f"- {_NAMES[i]}: "), gold[k]) for i, k in enumerate(order)])
    kind = F.col("p_partkey") % 4
    raw = F.when(kind == 0, labelled(range(6))).when(kind == 1, F.concat_ws("\n", *gold)).when(kind == 2, labelled((1, 0, 2, 3, 4, 5))).otherwise(F.concat(gold[2], F.lit("\n<think>"), gold[5], F.lit("</think>\nnosotros: "), gold[3]))
    return part.select("p_partkey", raw.alias("raw"), F.array(*gold).alias("expected"))


@register("j_15_paradigm_slots", f"""
WITH v AS (SELECT p_partkey, {_STEM} AS v FROM part)
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN concat_ws(',', v || 'o', v || 'as', v || 'a', v || 'amos', v || 'áis', v || 'an') WHEN 1 THEN concat_ws(',', v || 'o', v || 'as', v || 'a', v || 'amos', v || 'áis', v || 'an')
  WHEN 2 THEN concat_ws(',', v || 'as', v || 'o', v || 'a', v || 'amos', v || 'áis', v || 'an') ELSE concat_ws(',', v || 'a', '-', '-', v || 'amos', '-', '-') END AS slots FROM v""")
def j_15(spark, sf_dir):
    return paradigm.parsed(_paradigms(spark, sf_dir)).select("p_partkey", F.array_join("slots", ",", "-").alias("slots"))


@register("j_17_paradigm_score", f"""
WITH v AS (SELECT p_partkey, {_STEM} AS v, p_partkey % 4 AS k FROM part)
SELECT p_partkey, CAST(CASE k WHEN 2 THEN 4 WHEN 3 THEN 1 ELSE 6 END AS INT) AS strict, CASE k WHEN 2 THEN 0.6667 WHEN 3 THEN 0.1667 ELSE 1.0 END::DOUBLE AS strict_recall,
  CASE k WHEN 3 THEN 0.3333 ELSE 1.0 END::DOUBLE AS assignment_recall, CASE k WHEN 3 THEN 0.3333 ELSE 1.0 END::DOUBLE AS presence_recall, k IN (0, 1) AS perfect,
  CASE k WHEN 2 THEN v || 'o,' || v || 'as' WHEN 3 THEN concat_ws(',', v || 'o', v || 'as', v || 'a', v || 'áis', v || 'an') ELSE '' END AS missing FROM v""")
def j_17(spark, sf_dir):
    return paradigm.score(_paradigms(spark, sf_dir)).select("p_partkey", "strict", "strict_recall", "assignment_recall", "presence_recall", "perfect", F.array_join("missing", ",").alias("missing"))


@register("j_16_assignment", f"SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 3 THEN 2 ELSE 6 END AS INT) AS hits FROM part")
def j_16(spark, sf_dir):
    return paradigm.parsed(_paradigms(spark, sf_dir)).select("p_partkey", paradigm.assigned(F.col("expected"), F.col("line_forms")).alias("hits"))


@register("j_18_participle", f"SELECT p_partkey, p_size % 3 <> 1 AS correct, CASE WHEN p_size % 3 = 1 THEN 'he' ELSE {_STEM} || 'ado' END AS token FROM part")
def j_18(spark, sf_dir):
    gold = F.concat(F.lower(F.split("p_name", " ")[0]), F.lit("ado"))
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Respuesta: "), gold, F.lit(".\nmore"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("he "), gold)).otherwise(F.concat(F.lit('"'), gold, F.lit('"')))
    return table(spark, sf_dir, "part").select("p_partkey", paradigm.participle_correct(gold, raw).alias("correct"), paradigm.first_token(raw).alias("token"))


@register("j_14_normal_form", "SELECT item_id, lower(regexp_replace(text, '^[.,;:!?\"''«»“”‘’¡¿()\\[\\]{}]+|[.,;:!?\"''«»“”‘’¡¿()\\[\\]{}]+$', '', 'g')) AS form FROM (SELECT item_id, replace(text, 'ß', 'ss') AS text FROM benchmark)")
def j_14(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", paradigm.normal_form(F.col("text")).alias("form"))


# Welsh forms, frequencies, bans -----------------------------------------------------------------------------------------------
@register("j_24_mutation_policy", f"""
WITH v AS (SELECT p_partkey, p_size % 5 AS k, 'po' || {_STEM} AS p, 'ca' || {_STEM} AS c FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'soft_optional' WHEN 1 THEN 'soft_optional' WHEN 2 THEN 'soft_required' ELSE 'none' END AS policy,
  CASE WHEN k < 3 THEN concat_ws(',', p, c, 'b' || substr(p, 2), 'g' || substr(c, 2)) ELSE concat_ws(',', p, c) END AS forms FROM v""")
def j_24(spark, sf_dir):
    stem, k = F.lower(F.split("p_name", " ")[0]), F.col("p_size") % 5
    policy = forms.mutation_policy(F.when(k == 0, "Periphrastic").otherwise("synthetic"), F.when(k.isin(0, 3), "past").otherwise("present"), F.when(k == 1, "Yes"), F.when(k == 2, "soft_required").when(k == 4, "nasal"))
    given = F.array(F.concat(F.lit(" po"), stem), F.concat(F.lit("ca"), stem), F.lit(" "), F.upper(F.concat(F.lit("po"), stem)))
    return table(spark, sf_dir, "part").select("p_partkey", policy.alias("policy"), F.array_join(forms.with_mutations(given, policy), ",").alias("forms"))


@register("j_26_oi_variants", f"""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN v || 'of,' || v || 'oaf' WHEN 1 THEN v || 'ont,' || v || 'oant,' || v || 'oiant' WHEN 2 THEN v || 'oi' ELSE 'zzois' END AS variants FROM (SELECT p_partkey, p_size, {_STEM} AS v FROM part)""")
def j_26(spark, sf_dir):
    stem, k = F.lower(F.split("p_name", " ")[0]), F.col("p_size") % 4
    form = F.when(k == 0, F.concat(stem, F.lit("of"))).when(k == 1, F.concat(stem, F.lit("ont"))).when(k == 2, F.concat(stem, F.lit("oi"))).otherwise(F.lit("zzois"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(forms.oi_variants(form, F.concat(stem, F.lit("oi"))), ",").alias("variants"))


@register("j_19_verb_zipf", f"""
WITH w AS (SELECT unnest({sql_tokens()}) AS word FROM documents), f AS (SELECT word, count(*) / (SELECT count(*) FROM w) AS frequency FROM w GROUP BY word),
v AS (SELECT DISTINCT unnest({sql_tokens()}) AS verb FROM benchmark), e AS (SELECT DISTINCT verb, unnest([verb || 's', verb || 'ed']) AS word FROM v),
t AS (SELECT e.verb, sum(frequency) AS total FROM e JOIN f ON e.word = f.word GROUP BY e.verb)
SELECT v.verb, round(CASE WHEN coalesce(t.total, f.frequency, 0) > 0 THEN log10(coalesce(t.total, f.frequency) * 1e9) ELSE 0.0 END, 6) AS zipf FROM v LEFT JOIN t ON t.verb = v.verb LEFT JOIN f ON f.word = v.verb""")
def j_19(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    frequencies = words.join(F.broadcast(words.agg(F.sum("n").alias("all")))).select("word", (F.col("n") / F.col("all")).alias("frequency"))  # one row
    verbs = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("verb")).distinct()
    rows = verbs.select("verb", F.array(F.concat("verb", F.lit("s")), F.concat("verb", F.lit("ed"))).alias("forms"))
    return forms.summed_zipf(rows, frequencies).withColumn("zipf", F.round("zipf", 6))


def _bans(spark, sf_dir, mode):
    part = table(spark, sf_dir, "part").withColumn("lemma", F.concat(F.lower(F.split("p_name", " ")[0]), F.lit("ar")))
    cells = part.select("p_partkey", "lemma", F.when(F.col("p_size") % 5 == 0, "participle").otherwise("present").alias("tense"), F.when(F.col("p_size") % 2 == 0, "1s").otherwise("3p").alias("slot"))
    gold = F.when(F.col("tense") == "participle", F.regexp_replace("lemma", "r$", "do")).otherwise(forms.spanish_regular(F.col("lemma"), F.col("tense"), F.col("slot")))
    grid = part.select("lemma").distinct().select("lemma", F.explode(F.array(*[F.lit(t) for t in bans.TENSES])).alias("tense")).select("*", F.explode(F.array(*[F.lit(s) for s in forms.SLOTS])).alias("slot"))
    return bans.ban_sets(cells.withColumn("expected", gold), grid.withColumn("form", forms.spanish_regular(F.col("lemma"), F.col("tense"), F.col("slot"))), mode)


_PRESENT = "list_transform(['o', 'as', 'a', 'amos', 'áis', 'an'], lambda e: v || e)"
_ALL_FORMS = ", ".join(f"'{e}'" for own in forms.SPANISH_ENDINGS.values() for e in own["ar"].split())


@register("j_27_ban_sets", f"""
WITH v AS (SELECT p_partkey, {_STEM} AS v, p_size % 5 = 0 AS participle, p_size % 2 = 0 AS first FROM part)
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(CASE WHEN participle THEN list_transform([{_ALL_FORMS}], lambda e: v || e) ELSE {_PRESENT} END || [v || 'ar'],
  lambda f: f <> CASE WHEN participle THEN v || 'ado' WHEN first THEN v || 'o' ELSE v || 'an' END))), ',') AS forms,
  CAST(CASE WHEN participle THEN 0 WHEN first THEN 12 ELSE 10 END AS INT) AS pronouns FROM v""")
def j_27(spark, sf_dir):
    return _bans(spark, sf_dir, "full").select("p_partkey", F.array_join("forms", ",").alias("forms"), F.size("pronouns").alias("pronouns"))


@register("j_27_ban_sets_thin", f"""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 2 = 0 THEN v || 'a' ELSE v || 'a,' || v || 'o' END AS forms FROM (SELECT p_partkey, p_size, {_STEM} AS v FROM part)""")
def j_27_thin(spark, sf_dir):
    return _bans(spark, sf_dir, "thin").select("p_partkey", F.array_join("forms", ",").alias("forms"))


@register("j_28_ban_hits", f"""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN v || 'a' WHEN p_size % 2 = 0 THEN 'ella,' || v || 'a' ELSE 'ella,' || v || 'a' END AS hits FROM (SELECT p_partkey, p_size, {_STEM} AS v FROM part)""")
def j_28(spark, sf_dir):
    text = F.concat(F.lit("Ella "), F.regexp_replace("lemma", "ar$", "a"), F.lit("! zz."))
    return _bans(spark, sf_dir, "full").select("p_partkey", F.array_join(F.array_sort(bans.hits(text, F.concat("forms", "pronouns")), lambda a, b: F.when((a == "ella") & (b != "ella"), -1).when((b == "ella") & (a != "ella"), 1).otherwise(0)), ",").alias("hits"))


@register("j_29_ban_audit", f"""
WITH v AS (SELECT {_STEM} AS v, p_size % 5 = 0 AS participle, p_size % 2 = 0 AS first FROM part),
f AS (SELECT unnest(list_distinct(list_filter(CASE WHEN participle THEN list_transform([{_ALL_FORMS}], lambda e: v || e) ELSE {_PRESENT} END || [v || 'ar'],
  lambda f: f <> CASE WHEN participle THEN v || 'ado' WHEN first THEN v || 'o' ELSE v || 'an' END))) AS surface FROM v)
SELECT surface, count(*) AS cells, surface IN (SELECT CASE WHEN participle THEN v || 'ado' WHEN first THEN v || 'o' ELSE v || 'an' END FROM v) AS ambiguous FROM f GROUP BY surface""")
def j_29(spark, sf_dir):
    return bans.audit(_bans(spark, sf_dir, "full"))


@register("j_30_main_verb", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS main FROM part")
def j_30(spark, sf_dir):
    form, k = F.concat(F.lower(F.split("p_name", " ")[0]), F.lit("o")), F.col("p_size") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("Yo "), form, F.lit(" con mi amiga."))).when(k == 1, F.concat(F.lit('Dice "'), form, F.lit('" y ya.'))).when(k == 2, F.concat(F.lit("La forma correcta es "), form, F.lit(".")))
        .when(k == 3, F.lit("Nada que ver.")).otherwise(F.concat(F.lit("Siempre "), form, F.lit(" aquí.")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", bans.main_verb(text, form).alias("main"))


# token streams and matches -----------------------------------------------------------------------------------------------------
@register("j_44_prefix_fraction", f"""
WITH t AS (SELECT item_id, {sql_tokens()} AS tok FROM benchmark), u AS (SELECT item_id, tok, tok[1:2] AS a, [tok[len(tok)], 'zzz'] AS b FROM t WHERE len(tok) > 3)
SELECT item_id, CASE item_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS progress, item_id % 3 = 0 AS satisfied, true AS violated FROM u""")
def j_44(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("tok")).filter(F.size("tok") > 3)
    last, k = F.element_at("tok", -1), F.col("item_id") % 3
    gold = F.when(k == 0, F.array(F.slice("tok", 1, 2))).when(k == 1, F.array(F.array(last, F.lit("zzz")))).otherwise(F.array(F.array(F.lit("zzz"), last)))
    return rows.select("item_id", T.tracked(F.col("tok"), gold, F.array(F.slice("tok", 2, 1))).alias("t")).select("item_id", "t.progress", "t.satisfied", "t.violated")


@register("j_50_clitic_match", f"""
SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'strict' WHEN 1 THEN 'clitic_stripped' END AS kind FROM (SELECT item_id, {sql_tokens()} AS tok FROM benchmark) WHERE len(tok) > 0""")
def j_50(spark, sf_dir):
    k = F.col("item_id") % 3
    rows = table(spark, sf_dir, "benchmark").select("item_id", T.words(F.col("text")).alias("tok")).filter(F.size("tok") > 0)
    tokens = F.concat(F.array(F.when(k == 0, "גן").when(k == 1, "והגן").otherwise("רב")), F.col("tok"))
    return rows.select("item_id", T.clitic_match(tokens, F.lit("גן"), "ובכלמשה").alias("kind"))


@register("j_51_article_agreement", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false END AS agrees FROM part""")
def j_51(spark, sf_dir):
    noun, k = F.lower(F.split("p_name", " ")[0]), F.col("p_size") % 4
    tokens = F.when(k == 0, F.array(F.lit("veo"), F.lit("La"), noun)).when(k == 1, F.array(F.lit("la"), F.lit("gran"), noun)).otherwise(F.array(F.lit("la"), F.lit("muy"), F.lit("gran"), noun))
    return table(spark, sf_dir, "part").select("p_partkey", T.article_agrees(tokens, F.when(k != 3, noun), F.array(F.lit("la"), F.lit("una"))).alias("agrees"))


@register("j_37_token_candidates", r"""
WITH p AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS parts FROM benchmark), e AS (SELECT item_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM p),
s AS (SELECT item_id, parts[i] AS token, CAST(coalesce(length(array_to_string(parts[1:i - 1], '')), 0) AS INT) AS start_at FROM e WHERE regexp_matches(parts[i], '^[\p{L}\p{N}_]')),
v AS (SELECT DISTINCT p_partkey AS id, unnest([lower(string_split(p_name, ' ')[1]), 'the']) AS form FROM part WHERE p_size < 4), c AS (SELECT form, count(DISTINCT id) AS n, min(id) AS one FROM v GROUP BY form)
SELECT item_id, token, start_at, CASE WHEN n = 1 THEN one END AS vocab_id, CAST(coalesce(n, 0) AS INT) AS n, CASE WHEN n = 1 THEN 1.0 WHEN n > 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM s LEFT JOIN c ON replace(lower(token), 'ß', 'ss') = form""")
def j_37(spark, sf_dir):
    vocab = table(spark, sf_dir, "part").filter("p_size < 4").select(F.col("p_partkey").alias("id"), F.array(F.split("p_name", " ")[0], F.lit("The ")).alias("forms"))
    found = lexemes.resolved_spans(table(spark, sf_dir, "benchmark"), vocab, "item_id")
    return found.select("item_id", "token", F.col("start").alias("start_at"), "vocab_id", F.size("candidates").alias("n"), "confidence")


# JSON, predicates, joins -------------------------------------------------------------------------------------------------------
_DETAILS = "'{\"tense\": \"' || l_returnflag || '\", \"token_count\": ' || CASE WHEN l_linenumber = 7 THEN '\"many\"' ELSE CAST(l_linenumber AS VARCHAR) END || CASE WHEN l_linestatus = 'O' THEN ', \"flags\": {\"late\": 1}' ELSE '' END || '}'"


@register("c_04_json_path", f"WITH d AS (SELECT l_orderkey, l_linenumber, {_DETAILS} AS details FROM lineitem) SELECT l_orderkey, l_linenumber, json_extract_string(details, '$.tense') AS tense, json_extract_string(details, '$.flags.late') AS late FROM d")
def c_04(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_DETAILS.replace("VARCHAR", "STRING")).alias("details"))
    return rows.select("l_orderkey", "l_linenumber", T.json_text(F.col("details"), "$.tense").alias("tense"), T.json_text(F.col("details"), "$.flags.late").alias("late"))


@register("c_05_json_predicate", f"WITH d AS (SELECT l_orderkey, l_linenumber, {_DETAILS} AS details FROM lineitem) SELECT l_orderkey, l_linenumber FROM d WHERE TRY_CAST(json_extract_string(details, '$.token_count') AS INT) < 3 AND json_extract_string(details, '$.flags') IS NULL")
def c_05(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_DETAILS.replace("VARCHAR", "STRING")).alias("details"))
    return rows.filter((T.json_int(F.col("details"), "$.token_count") < 3) & T.json_text(F.col("details"), "$.flags").isNull()).select("l_orderkey", "l_linenumber")


@register("c_19_verb_candidates", f"SELECT DISTINCT w FROM (SELECT unnest({sql_tokens()}) AS w FROM documents) WHERE length(w) >= 4 AND regexp_matches(w, '^\\p{{L}}+$') AND (w LIKE '%ar' OR w LIKE '%er' OR w LIKE '%ir')")
def c_19(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(T.words(F.col("text"))).alias("w"))
    return words.filter(forms.is_verb_candidate(F.col("w"))).distinct()


@register("b_03_split_row", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'number=' || p_size ELSE '' END AS dimensions, 'brand=' || p_brand AS companions FROM part")
def b_03(spark, sf_dir):
    raw = F.create_map(F.lit("number"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")), F.lit("tense"), F.lit(" "), F.lit("brand"), F.col("p_brand"))
    kept = F.map_filter(raw, lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    join = lambda own: F.array_join(F.transform(F.array_sort(F.map_entries(own)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    own = lambda k: k.isin("number", "tense", "person")
    return table(spark, sf_dir, "part").select("p_partkey", join(F.map_filter(kept, lambda k, v: own(k))).alias("dimensions"), join(F.map_filter(kept, lambda k, v: ~own(k))).alias("companions"))


@register("d_03_eager_children", "SELECT d.doc_id, count(l.doc_id) AS n, coalesce(string_agg('quality=' || l.quality || ';toxic=' || l.toxic, ','), '') AS evaluations FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id")
def d_03(spark, sf_dir):
    children = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("quality", "toxic"))).alias("evaluations"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(children, "doc_id", "left")
    said = F.array_join(F.transform("evaluations", lambda e: F.concat(F.lit("quality="), e["quality"], F.lit(";toxic="), e["toxic"])), ",")
    return rows.select("doc_id", F.coalesce(F.size("evaluations"), F.lit(0)).cast("long").alias("n"), F.coalesce(said, F.lit("")).alias("evaluations"))


@register("d_14_slot_lookup", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 5 THEN string_split('a b c d e', ' ')[l_linenumber] || p.p_size END AS known FROM lineitem LEFT JOIN (SELECT p_partkey, p_size FROM part WHERE p_size > 10) p ON l_partkey = p_partkey AND p.p_size IS NOT NULL")
def d_14(spark, sf_dir):
    calls = table(spark, sf_dir, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.transform(F.split(F.lit("a b c d e"), " "), lambda x: F.concat(x, F.col("p_size"))).alias("per_person"))
    return table(spark, sf_dir, "lineitem").join(calls, "l_partkey", "left").select("l_orderkey", "l_linenumber", F.get("per_person", F.col("l_linenumber").cast("int") - 1).alias("known"))


@register("d_23_slot_grid", "SELECT v.p_brand, s.slot, s.difficulty FROM (SELECT DISTINCT p_brand FROM part) v CROSS JOIN (SELECT unnest(['1s', '3s', '1p', '2p']) AS slot, unnest(['easy', 'easy', 'hard', 'hard']) AS difficulty) s")
def d_23(spark, sf_dir):
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), F.lit(d).alias("difficulty")) for s, d in (("1s", "easy"), ("3s", "easy"), ("1p", "hard"), ("2p", "hard"))])
    return table(spark, sf_dir, "part").select("p_brand").distinct().select("p_brand", F.explode(slots).alias("s")).select("p_brand", "s.*")


# validation --------------------------------------------------------------------------------------------------------------------
_WILSON = "round({f}({e}, (k / n + 1.96 * 1.96 / (2 * n)) / (1 + 1.96 * 1.96 / n) {s} 1.96 / (1 + 1.96 * 1.96 / n) * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))), 4)"


@register("e_44_accept_rates", f"""
WITH r AS (SELECT d.lang, d.source, l.quality = 1 AS ok, d.n_chars < 400 AS bad FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT lang, source, concat_ws('+', CASE WHEN grouping(lang) = 0 THEN 'lang' END, CASE WHEN grouping(source) = 0 THEN 'source' END) AS slice, CAST(count(*) AS DOUBLE) AS n, CAST(count(CASE WHEN ok THEN 1 END) AS DOUBLE) AS k,
  CAST(count(CASE WHEN bad THEN 1 END) AS BIGINT) AS unparseable FROM r GROUP BY GROUPING SETS ((), (lang), (source), (lang, source)))
SELECT slice, lang, source, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 4) AS rate, {_WILSON.format(f="greatest", e="0.0", s="-")} AS low, {_WILSON.format(f="least", e="1.0", s="+")} AS high, unparseable FROM g""")
def e_44(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return validation.rates(rows, F.col("quality") == 1, validation.subsets("lang", "source"), F.col("n_chars") < 400)


@register("e_23_gold_and_foil", f"""
WITH r AS (SELECT o.o_orderpriority AS probe, CASE WHEN l.l_linenumber = 1 THEN 'gold' ELSE 'foil' END AS condition, CASE WHEN l.l_linenumber = 1 THEN l_discount > 0.03 ELSE l_discount <= 0.03 END AS ok, l_tax = 0 AS bad FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey),
g AS (SELECT probe, condition, concat_ws('+', CASE WHEN grouping(probe) = 0 THEN 'probe' END, CASE WHEN grouping(condition) = 0 THEN 'condition' END) AS slice, CAST(count(*) AS DOUBLE) AS n, CAST(count(CASE WHEN ok THEN 1 END) AS DOUBLE) AS k,
  CAST(count(CASE WHEN bad THEN 1 END) AS BIGINT) AS unparseable FROM r GROUP BY GROUPING SETS ((), (condition), (probe, condition)))
SELECT slice, probe, condition, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 4) AS rate, {_WILSON.format(f="greatest", e="0.0", s="-")} AS low, {_WILSON.format(f="least", e="1.0", s="+")} AS high, unparseable FROM g""")
def e_23(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    gold = F.col("l_linenumber") == 1
    rows = rows.select(F.col("o_orderpriority").alias("probe"), F.when(gold, "gold").otherwise("foil").alias("condition"), F.when(gold, F.col("l_discount") > 0.03).otherwise(F.col("l_discount") <= 0.03).alias("ok"), (F.col("l_tax") == 0).alias("bad"))
    return validation.rates(rows, F.col("ok"), [["probe", "condition"], [], ["condition"]], F.col("bad"))


@register("e_45_candidate_rates", f"""
WITH r AS (SELECT o.o_orderpriority AS model, l_discount > 0.05 AS ok FROM lineitem l JOIN orders o ON l_orderkey = o_orderkey),
g AS (SELECT model, CASE WHEN grouping(model) = 0 THEN 'model' ELSE '' END AS slice, CAST(count(*) AS DOUBLE) AS n, CAST(count(CASE WHEN ok THEN 1 END) AS DOUBLE) AS k FROM r GROUP BY GROUPING SETS ((), (model)))
SELECT slice, model, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k, round(k / n, 4) AS rate, {_WILSON.format(f="greatest", e="0.0", s="-")} AS low, {_WILSON.format(f="least", e="1.0", s="+")} AS high, CAST(0 AS BIGINT) AS unparseable FROM g""")
def e_45(spark, sf_dir):
    candidates = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_discount") > 0.05).alias("ok"))).alias("candidates"))
    rows = table(spark, sf_dir, "orders").join(candidates, F.col("o_orderkey") == F.col("l_orderkey")).withColumnRenamed("o_orderpriority", "model")
    return validation.candidate_rates(rows, "candidates", "ok", "model")


@register("e_28_pairwise_accuracy", """
WITH p AS (SELECT o_orderkey, max(o_orderpriority) AS category, max(CASE WHEN l_linenumber = 1 THEN l_extendedprice END) AS a, max(CASE WHEN l_linenumber = 2 AND l_quantity < 49 THEN l_extendedprice END) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber <= 2 GROUP BY o_orderkey)
SELECT count(*) AS total_pairs, count(CASE WHEN category <> '5-LOW' AND a IS NOT NULL AND b IS NOT NULL THEN 1 END) AS scoreable_pairs, count(CASE WHEN category <> '5-LOW' AND a < b THEN 1 END) AS correct,
  round(count(CASE WHEN category <> '5-LOW' AND a < b THEN 1 END) / count(CASE WHEN category <> '5-LOW' AND a IS NOT NULL AND b IS NOT NULL THEN 1 END), 6) AS accuracy FROM p""")
def e_28(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    value = F.when((F.col("l_linenumber") == 2) & (F.col("l_quantity") >= 49), F.lit(float("inf"))).otherwise(F.col("l_extendedprice").cast("double"))
    return validation.pairwise_accuracy(rows.select(F.col("o_orderkey").alias("pair_id"), F.col("o_orderpriority").alias("category"), (F.col("l_linenumber") == 1).alias("preferred"), value.alias("value")), ["5-LOW"])


@register("e_36_meta_counters", """
SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' WHEN grouping(l_shipmode) = 0 THEN 'l_shipmode' WHEN grouping(l_linenumber) = 0 THEN 'l_linenumber' ELSE 'all' END AS dimension,
  coalesce(l_returnflag, l_shipmode, CAST(l_linenumber AS VARCHAR)) AS value, count(*) AS n FROM (SELECT l_returnflag, l_linestatus AS l_shipmode, l_linenumber FROM lineitem) GROUP BY GROUPING SETS ((), (l_returnflag), (l_shipmode), (l_linenumber))""")
def e_36(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_linestatus").alias("l_shipmode"), "l_linenumber")
    return validation.counters(rows, "l_returnflag", "l_shipmode", "l_linenumber")


# lexemes and merges ------------------------------------------------------------------------------------------------------------
@register("g_08_find_or_create", """
WITH l AS (SELECT min(p_partkey) AS id, lower(p_brand) AS lemma, max(p_type) AS ipa FROM part WHERE p_size < 20 GROUP BY lower(p_brand)),
i AS (SELECT lower(p_brand) AS lemma, arg_max(p_type, p_partkey) AS ipa FROM part WHERE p_size >= 15 GROUP BY lower(p_brand))
SELECT coalesce(l.lemma, i.lemma) AS lemma, l.id, coalesce(i.ipa, l.ipa) AS ipa, CASE WHEN i.lemma IS NOT NULL THEN 'a,b' ELSE 'x' END AS tags, CASE WHEN l.lemma IS NULL THEN 'pending' ELSE 'enriched' END AS status FROM l FULL JOIN i ON l.lemma = i.lemma""")
def g_08(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fixed = [F.lit("es").alias("language"), F.lit("noun").alias("pos"), F.lit("g").alias("gloss_primary")]
    have = part.filter("p_size < 20").groupBy(F.lower("p_brand").alias("lemma")).agg(F.min("p_partkey").alias("id"), F.max("p_type").alias("ipa"))
    have = have.select("id", "lemma", *fixed, F.array(F.lit("x")).alias("tags"), "ipa", F.lit("enriched").alias("enrichment_status"))
    new = part.filter("p_size >= 15").select(F.concat(F.lit(" "), F.upper("p_brand")).alias("lemma"), F.lit("es").alias("language"), F.lit("thing").alias("pos"), F.lit(" G ").alias("gloss_primary"), F.array(F.lit("a"), F.lit("b"), F.lit("a")).alias("tags"), F.col("p_type").alias("ipa"), F.col("p_partkey").alias("seq"))
    new = new.withColumn("pos", F.lit("noun"))
    return lexemes.find_or_create(new, have).select("lemma", "id", "ipa", F.array_join("tags", ",").alias("tags"), F.col("enrichment_status").alias("status"))


@register("g_10_backfill", """
WITH l AS (SELECT min(p_partkey) AS id, lower(p_brand) AS lemma FROM part WHERE p_size < 10 GROUP BY lower(p_brand))
SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN -1 ELSE l.id END AS lexeme_id, CASE WHEN p_size % 2 = 1 AND l.id IS NOT NULL THEN p_brand END AS surface_form, CASE WHEN p_size % 2 = 1 AND l.id IS NOT NULL THEN 'A thing' END AS gloss_override FROM part LEFT JOIN l ON lower(p_brand) = l.lemma""")
def g_10(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    have = part.filter("p_size < 10").groupBy(F.lower("p_brand").alias("lemma")).agg(F.min("p_partkey").alias("id")).select("id", "lemma", F.lit("es").alias("language"), F.lit("noun").alias("pos"), F.lit("a thing").alias("gloss_primary"))
    vocab = part.select(F.col("p_partkey").alias("id"), F.lit("es").alias("language"), F.col("p_brand").alias("word"), F.lit("A thing").alias("translation"), F.lit("noun").alias("pos"), F.array().cast("array<string>").alias("tags"), F.when(F.col("p_size") % 2 == 0, F.lit(-1).cast("long")).alias("lexeme_id"), F.lit(None).cast("string").alias("surface_form"))
    return lexemes.backfill(vocab, have).select("id", "lexeme_id", "surface_form", "gloss_override")


@register("g_12_coerced_pos", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' ELSE '' END AS pos FROM part")
def g_12(spark, sf_dir):
    k = F.col("p_size") % 3
    return table(spark, sf_dir, "part").select("p_partkey", lexemes.coerced_pos(F.when(k == 0, "noun").otherwise("thing"), F.when(k < 2, F.array(F.lit("big"), F.lit("verb"), F.lit("noun")))).alias("pos"))


@register("j_47_missing_fields", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'lemma,' ELSE '' END || 'tags' || CASE WHEN p_size % 3 = 0 THEN ',gloss_primary' ELSE '' END AS missing, p_size % 5 < 2 AS needed FROM part")
def j_47(spark, sf_dir):
    k = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, "").otherwise("x").alias("lemma"), F.lit("noun").alias("pos"), F.array().cast("array<string>").alias("tags"), F.when(k % 3 != 0, "g").alias("gloss_primary"), F.when(k % 5 == 0, "pending").when(k % 5 == 1, "complete").when(k % 5 == 2, "enriched").alias("status"))
    return rows.select("p_partkey", F.array_join(lexemes.missing_fields(rows), ",").alias("missing"), lexemes.needs_enrichment(F.col("status")).alias("needed"))


@register("g_13_insert_unique", """
SELECT p_brand, min(p_partkey) AS p_partkey, 'accepted' AS kind FROM part WHERE p_size >= 45 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 1) GROUP BY p_brand
UNION ALL SELECT p_brand, p_partkey, 'conflict' FROM part p WHERE p_size >= 45 AND (p_brand IN (SELECT p_brand FROM part WHERE p_size = 1) OR EXISTS (SELECT 1 FROM part q WHERE q.p_size >= 45 AND q.p_brand = p.p_brand AND q.p_partkey < p.p_partkey))""")
def g_13(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    ok, conflicts = lexemes.insert_unique(part.filter("p_size >= 45"), part.filter("p_size = 1"), ["p_brand"], "p_partkey")
    return ok.withColumn("kind", F.lit("accepted")).union(conflicts.withColumn("kind", F.lit("conflict"))).select("p_brand", "p_partkey", "kind")


@register("g_15_occurrences", """
WITH o AS (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN NULL ELSE length(text) % 3 END AS char_start FROM conversations)
SELECT CASE WHEN role IS NULL THEN 0 ELSE 1 END AS workspace_id, conv_id AS vocab_id, role AS context_type, char_start, min(turn) AS id FROM o GROUP BY ALL""")
def g_15(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("id"), F.when(F.col("role").isNull(), 0).otherwise(1).alias("workspace_id"), F.col("conv_id").alias("vocab_id"), F.col("role").alias("context_type"), F.lit(1).alias("context_id"),
        F.lit("t").alias("surface_token"), F.when(F.col("turn") % 2 != 0, F.length("text") % 3).alias("char_start"),
    )
    have = merge.first_by(rows.filter("turn < 2") if "turn" in rows.columns else rows.filter("id < 2"), lexemes.OCCURRENCE, [F.col("id")])
    return lexemes.add_occurrences(rows.filter("id >= 2"), have).select("workspace_id", "vocab_id", "context_type", "char_start", "id")


def _runs(spark, sf_dir):
    """Two databases of runs out of orders and lines: priorities are experiments, line numbers cells."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderpriority").alias("experiment"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("cell"), F.col("l_orderkey").alias("sample_index"), F.col("l_quantity").alias("sentence"))
    names = orders.select(F.col("o_orderpriority").alias("name")).distinct()

    def one(sentences, has, status):
        low = F.col("name") == "5-LOW"
        return {
            "experiments": names.filter(has).select("name", F.when(~low, "b").alias("benchmark"), F.lit("m").alias("method"), F.lit(status).alias("status"), F.lit(status).alias("completed_at")),
            "sentences": sentences,
            "evaluations": sentences.filter("cell <> 'c2'").select("experiment", "cell", "sample_index", F.lit("judge").alias("evaluator"), F.lit(1.0).alias("score")),
            "metrics": sentences.select("experiment", F.lit("mean").alias("metric_name"), F.lit("experiment").alias("scope"), F.lit(None).cast("string").alias("cell")).distinct(),
        }

    source = one(rows.filter("sample_index % 2 = 0"), F.lit(True), "done")
    return source, one(rows.filter("sample_index % 3 = 0 and experiment <> '1-URGENT'"), F.col("name") != "1-URGENT", "running")


@register("g_01_merge_runs", """
WITH r AS (SELECT o_orderpriority AS e, l_linenumber AS c, l_orderkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey), f AS (SELECT * FROM r WHERE s % 2 = 0 AND e <> '5-LOW' AND NOT (s % 3 = 0 AND e <> '1-URGENT'))
SELECT 'first' AS run, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority <> '5-LOW') AS merged, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority = '5-LOW') AS skipped,
  (SELECT count(*) FROM f) AS sentences_added, (SELECT count(*) FROM f WHERE c <> 2) AS evaluations_added,
  (SELECT count(DISTINCT e) FROM r WHERE s % 2 = 0 AND e <> '5-LOW' AND e NOT IN (SELECT e FROM r WHERE s % 3 = 0 AND e <> '1-URGENT')) AS metrics_added
UNION ALL SELECT 'again', (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority <> '5-LOW'), (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_orderpriority = '5-LOW'), 0, 0, 0""")
def g_01(spark, sf_dir):
    source, target = _runs(spark, sf_dir)
    merged, counts = merge.merge_runs(source, target)
    again = merge.merge_runs(source, merged)[1]
    return counts.withColumn("run", F.lit("first")).unionByName(again.withColumn("run", F.lit("again")))


# selections --------------------------------------------------------------------------------------------------------------------
_TIERS = "CASE WHEN p_size < 17 THEN 'low' WHEN p_size >= 34 THEN 'high' ELSE 'mid' END"


@register("h_12_head_then_rounds", f"""
WITH a AS (SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS place FROM part),
b AS (SELECT *, CASE WHEN place <= 3 THEN 0 ELSE row_number() OVER (PARTITION BY p_brand, p_type, place <= 3 ORDER BY place) END AS turn FROM a)
SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY turn, CASE WHEN place <= 3 THEN place ELSE 0 END, p_type, p_partkey) AS INT) AS rank FROM b) WHERE rank <= 10""")
def h_12(spark, sf_dir):
    return sampling.head_then_rounds(table(spark, sf_dir, "part"), 3, 10, "p_retailprice", "p_type", "p_partkey", "p_brand").select("p_brand", "p_partkey", "rank")


@register("h_16_match_quotas", f"""
WITH r AS (SELECT p_partkey, p_brand, {_TIERS} AS tier, md5('5:' || p_partkey) AS h FROM part), w AS (SELECT p_brand, count(*) AS want FROM part WHERE p_size % 7 = 0 GROUP BY p_brand),
s AS (SELECT r.p_brand, tier, count(*) AS size, any_value(want) AS want FROM r JOIN w ON r.p_brand = w.p_brand GROUP BY r.p_brand, tier),
x AS (SELECT *, least(want, sum(size) OVER (PARTITION BY p_brand)) AS n, least(want, sum(size) OVER (PARTITION BY p_brand)) * size / CAST(sum(size) OVER (PARTITION BY p_brand) AS DOUBLE) AS exact FROM s),
q AS (SELECT p_brand, tier, floor(exact) + CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY round(exact - floor(exact), 9) DESC, tier) <= n - sum(floor(exact)) OVER (PARTITION BY p_brand) THEN 1 ELSE 0 END AS quota FROM x)
SELECT p_brand, tier, p_partkey FROM (SELECT r.*, quota, row_number() OVER (PARTITION BY r.p_brand, r.tier ORDER BY h, p_partkey) AS k FROM r JOIN q ON r.p_brand = q.p_brand AND r.tier = q.tier) WHERE k <= quota""")
def h_16(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("tier", F.expr(_TIERS))
    return sampling.match_quotas(part, part.filter("p_size % 7 = 0"), 5, "p_partkey", ["p_brand"], "tier").select("p_brand", "tier", "p_partkey")


@register("h_24_diverse", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_extendedprice DESC, l_linenumber) AS turn, max(l_extendedprice) OVER (PARTITION BY l_orderkey, l_returnflag) AS best FROM lineitem)
SELECT l_orderkey, l_linenumber, rank FROM (SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY turn, best DESC, l_returnflag) AS INT) AS rank FROM a) WHERE rank <= 3""")
def h_24(spark, sf_dir):
    return sampling.diverse(table(spark, sf_dir, "lineitem"), 3, "l_returnflag", "l_extendedprice", "l_linenumber", "l_orderkey").select("l_orderkey", "l_linenumber", "rank")


@register("h_25_final_pick", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_discount DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def h_25(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return sampling.best_per_cell(rows, ["l_orderkey"], [F.col("l_quantity"), F.col("l_discount")], "l_linenumber").select("l_orderkey", "l_linenumber")


@register("h_26_distractors", """
WITH p AS (SELECT p_partkey AS id, p_name || p_partkey AS word, CASE WHEN p_size < 4 THEN 'rare' || p_partkey % 40 ELSE p_brand END AS tag, md5('9:' || p_partkey) AS h FROM part), q AS (SELECT * FROM p WHERE h < '2'),
n AS (SELECT q.id, p.id AS distractor, row_number() OVER (PARTITION BY q.id ORDER BY p.h, p.id) AS rank, count(*) OVER (PARTITION BY q.id) AS have FROM q JOIN p ON q.tag = p.tag AND p.id <> q.id),
e AS (SELECT id, h, row_number() OVER (ORDER BY h, id) AS place FROM p), f AS (SELECT q.id, e.id AS distractor, row_number() OVER (PARTITION BY q.id ORDER BY e.h, e.id) AS rank FROM q JOIN e ON e.place <= 4 AND e.id <> q.id WHERE q.id NOT IN (SELECT id FROM n WHERE have >= 3))
SELECT id, distractor, CAST(rank AS INT) AS rank FROM n WHERE have >= 3 AND rank <= 3 UNION ALL SELECT id, distractor, CAST(rank AS INT) FROM f WHERE rank <= 3""")
def h_26(spark, sf_dir):
    tag = F.when(F.col("p_size") < 4, F.concat(F.lit("rare"), F.col("p_partkey") % 40)).otherwise(F.col("p_brand"))
    pool = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.col("p_partkey")).alias("word"), tag.alias("tag"))
    return sampling.distractors(pool.filter(sampling.hash_order(9, "id") < "2"), pool, 9)


@register("h_28_pending_jobs", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def h_28(spark, sf_dir):
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


# ranks -------------------------------------------------------------------------------------------------------------------------
@register("l_01_average_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2e0 AS avg_rank FROM part")
def l_01(spark, sf_dir):
    return ranks.with_average_rank(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "avg_rank")


@register("e_17_spearman", "SELECT round(corr(rx, ry), 6) AS rho FROM (SELECT rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2e0 AS rx, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2e0 AS ry FROM (SELECT c.c_custkey, c.c_acctbal, count(*) AS n FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey, c.c_acctbal) x) y")
def e_17(spark, sf_dir):
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return ranks.spearman(table(spark, sf_dir, "customer").join(counts, "c_custkey"), "c_acctbal", "n")


@register("e_18_two_samples", """
WITH r AS (SELECT l.quality AS g, d.n_chars AS v FROM documents d JOIN labels l ON d.doc_id = l.doc_id), k AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM r)
SELECT count(CASE WHEN g = 1 THEN 1 END) AS n1, count(CASE WHEN g = 0 THEN 1 END) AS n0, CAST(sum(CASE WHEN g = 1 THEN rk END) - count(CASE WHEN g = 1 THEN 1 END) * (count(CASE WHEN g = 1 THEN 1 END) + 1) / 2.0 AS DOUBLE) AS u, round(corr(g, v), 6) AS point_biserial FROM k""")
def e_18(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return ranks.two_samples(rows, "n_chars", F.col("quality") == 1)
