"""State kept along tokens, jobs, runs and configurations (N, G, M, J), each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..functions import automata, forms
from ..functions import text as T
from ..operators import jobs, rescoring, views, welsh
from .q_operators import _mutation_sql
from .tables import EVALUATIONS, dealt, evaluations, sentences, sql_tokens, table

QUERIES, SQL = {}, {}


def register(name: str, sql: str):
    def add(run):
        QUERIES[name] = run
        SQL[name] = sql
        return run

    return add


# token streams ---------------------------------------------------------------------------------------------------------------
_GOLD = (("the", "of", "the"), ("and", "in", "and", "of"), ())
_BANNED = (("that", "the"), ("to", "is", "of"))


def _sql_fed(at: str, sequence: tuple[str, ...], stopped: str) -> str:
    return f"CASE WHEN {stopped} OR {at} >= {len(sequence)} THEN {at} WHEN ({list(sequence)})[{at} + 1] = tok[k + 1] THEN {at} + 1 WHEN tok[k + 1] = '{sequence[0]}' THEN 1 ELSE 0 END"


def _streams(spark, sf_dir):
    variants = lambda sequences: F.array(*[F.array(*[F.lit(w) for w in s]).cast("array<string>") for s in sequences])
    rows = dealt(spark, sf_dir, "conversations").select("conv_id", "turn", T.words(F.col("text")).alias("tok"))
    return rows.withColumns({"gold": variants(_GOLD), "banned": variants(_BANNED)})


_TRACES = f"""
RECURSIVE t AS (SELECT conv_id, turn, {sql_tokens()} AS tok FROM conversations),
bans AS (
  SELECT conv_id, turn, tok, 0 AS k, 0 AS g1, 0 AS g2, 0 AS b1, 0 AS b2, false AS sat, false AS vio FROM t
  UNION ALL
  SELECT conv_id, turn, tok, k + 1, {_sql_fed('g1', _GOLD[0], 'sat OR nv')}, {_sql_fed('g2', _GOLD[1], 'sat OR nv')}, n1, n2,
    sat OR (NOT nv AND ({_sql_fed('g1', _GOLD[0], 'sat')} >= {len(_GOLD[0])} OR {_sql_fed('g2', _GOLD[1], 'sat')} >= {len(_GOLD[1])})), nv
  FROM (SELECT *, vio OR n1 >= {len(_BANNED[0])} OR n2 >= {len(_BANNED[1])} AS nv FROM (
    SELECT *, {_sql_fed('b1', _BANNED[0], 'vio')} AS n1, {_sql_fed('b2', _BANNED[1], 'vio')} AS n2 FROM bans WHERE k < len(tok)))
)"""


@register("n_07_tracker_trace", f"""
WITH {_TRACES}
SELECT conv_id, turn, k AS at, sat AS satisfied, vio AS violated, CASE WHEN sat THEN 1.0 ELSE greatest(g1 / {len(_GOLD[0])}::DOUBLE, g2 / {len(_GOLD[1])}::DOUBLE) END::DOUBLE AS progress,
  CAST(sat AS INT) + CAST(NOT vio AS INT) AS clauses FROM bans WHERE k > 0""")
def n_07_trace(spark, sf_dir):
    """The tracker after each word of every turn."""
    rows = _streams(spark, sf_dir)
    states = rows.select("conv_id", "turn", "gold", F.posexplode(automata.trace(F.col("tok"), F.col("gold"), F.col("banned"))).alias("at", "state"))
    state = F.col("state")
    return states.select("conv_id", "turn", (F.col("at") + 1).alias("at"), state["satisfied"].alias("satisfied"), state["violated"].alias("violated"), automata.progress(state, F.col("gold")).alias("progress"), automata.clauses(state).alias("clauses"))


@register("n_07_beam_groups", f"""
WITH {_TRACES}, ends AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k DESC) AS r FROM bans)
SELECT array_to_string(list_filter([CASE WHEN sat THEN 'gold' END, CASE WHEN b1 BETWEEN 1 AND {len(_BANNED[0]) - 1} THEN 'neg_partial:0' END, CASE WHEN b2 BETWEEN 1 AND {len(_BANNED[1]) - 1} THEN 'neg_partial:1' END], lambda x: x IS NOT NULL), ' ') AS key,
  count(*) AS n, sum(CASE WHEN vio THEN 0 ELSE 1 END)::BIGINT AS alive, round(sum(-0.5 * len(tok) + 0.1 * CASE WHEN sat THEN 0.0 ELSE greatest(g1 / {len(_GOLD[0])}::DOUBLE, g2 / {len(_GOLD[1])}::DOUBLE) END), 6) AS score
FROM ends WHERE r = 1 GROUP BY 1""")
def n_07_groups(spark, sf_dir):
    """Turns as hypotheses by what their trackers share at the end, with those that no ban has ended and their scores."""
    rows = _streams(spark, sf_dir).withColumn("state", automata.last(F.col("tok"), F.col("gold"), F.col("banned")))
    state = F.col("state")
    score = automata.score(-0.5 * F.size("tok"), state, F.col("gold"), 0.1)
    keyed = rows.select(F.array_join(automata.beam_key(state, F.col("banned")), " ").alias("key"), state["violated"].alias("violated"), score.alias("score"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.count_if(~F.col("violated")).alias("alive"), F.round(F.sum("score"), 6).alias("score"))


# jobs ------------------------------------------------------------------------------------------------------------------------
def _queue(spark, sf_dir):
    """(jobs, lexemes, vocab, results): orders as jobs, parts as lexemes, customers as vocabulary."""
    size, key = F.col("p_size"), F.col("p_partkey")
    part = table(spark, sf_dir, "part").withColumn("first", F.lower(F.split("p_name", " ")[0]))
    lex = part.select(
        key.alias("id"), F.lit("es").alias("language"), F.col("first").alias("lemma"), F.when(key % 7 != 0, "noun").otherwise("verb").alias("pos"), F.array("p_type").alias("tags"),
        F.when(size % 4 == 0, F.lower("p_brand")).otherwise("").alias("gloss_primary"), F.when(size % 3 == 0, "pending").when(size % 3 == 1, "enriched").otherwise("complete").alias("enrichment_status"),
    )
    results = part.filter(size % 5 != 0).select(
        key.alias("lexeme_id"), F.concat(F.lit(" "), F.upper("first")).alias("lemma"), F.when(size % 2 == 0, "noun").otherwise("").alias("pos"), F.array(F.lit("Noun"), F.lit("noun "), F.lit("")).alias("tags"),
        F.when(size % 7 != 0, F.col("p_brand")).otherwise("").alias("gloss_primary"), F.lit(0.9).alias("confidence"), F.when(size == 11, "timeout").alias("error"),
    )
    lexeme = F.when(F.col("o_orderkey") % 11 == 0, -F.col("o_custkey")).otherwise(F.col("o_custkey"))
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), lexeme.alias("lexeme_id"), F.lit(None).cast("long").alias("vocab_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    vocab = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("workspace_id"), F.col("c_custkey").alias("lexeme_id"))
    return jobs, lex, vocab, results


_PROCESSED = """
lex AS (
  SELECT p_partkey AS id, lower(string_split(p_name, ' ')[1]) AS lemma, CASE WHEN p_partkey % 7 <> 0 THEN 'noun' ELSE 'verb' END AS pos,
    CASE WHEN p_size % 4 = 0 THEN lower(p_brand) ELSE '' END AS gloss, CASE p_size % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'enriched' ELSE 'complete' END AS st, p_size, p_brand FROM part
), jobs AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN -o_custkey ELSE o_custkey END AS lexeme_id, CASE WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'done' END AS status FROM orders
), lead AS (
  SELECT lexeme_id, min(id) AS job_id FROM jobs WHERE status = 'pending' GROUP BY lexeme_id
), cached AS (
  SELECT lemma, pos, gloss, min(id) AS target FROM lex WHERE st = 'enriched' GROUP BY ALL
), kinds AS (
  SELECT lead.*, lex.*, c.target AS cached, CASE WHEN lex.id IS NULL THEN 'failed' WHEN st = 'enriched' THEN 'none' WHEN st = 'pending' AND c.target IS NOT NULL THEN 'cache'
    WHEN p_size % 5 = 0 OR p_size = 11 THEN 'waiting' ELSE 'apply' END AS kind
  FROM lead LEFT JOIN lex ON lex.id = lead.lexeme_id LEFT JOIN cached c ON c.lemma = lex.lemma AND c.pos = lex.pos AND c.gloss = lex.gloss
), applied AS (
  SELECT lexeme_id, job_id, lemma, CASE WHEN p_size % 2 = 0 THEN 'noun' ELSE pos END AS pos, CASE WHEN p_size % 7 <> 0 THEN lower(p_brand) ELSE gloss END AS gloss FROM kinds WHERE kind = 'apply'
), still AS (
  SELECT lemma, pos, gloss, min(id) AS target FROM lex WHERE id NOT IN (SELECT lexeme_id FROM kinds WHERE kind IN ('apply', 'cache')) GROUP BY ALL
), ranked AS (
  SELECT a.*, s.target AS other, first_value(lexeme_id) OVER (PARTITION BY a.lemma, a.pos, a.gloss ORDER BY job_id) AS leader
  FROM applied a LEFT JOIN still s ON s.lemma = a.lemma AND s.pos = a.pos AND s.gloss = a.gloss
), found AS (
  SELECT k.lexeme_id, k.job_id, CASE WHEN kind <> 'apply' THEN kind WHEN coalesce(other, leader) <> k.lexeme_id THEN 'dedupe' ELSE 'enriched' END AS outcome,
    CASE WHEN kind = 'cache' THEN cached WHEN kind = 'apply' AND coalesce(other, leader) <> k.lexeme_id THEN coalesce(other, leader) END AS target
  FROM kinds k LEFT JOIN ranked r ON r.lexeme_id = k.lexeme_id
)"""


@register("n_04_process", f"""
WITH {_PROCESSED}
SELECT j.id, CASE WHEN status = 'pending' AND outcome = 'failed' THEN 'failed' WHEN status = 'pending' AND outcome <> 'waiting' THEN 'done' ELSE status END AS status,
  CASE WHEN status = 'pending' AND j.id = job_id THEN CASE outcome WHEN 'cache' THEN 'cache' WHEN 'dedupe' THEN 'dedupe' WHEN 'enriched' THEN 'model' END END AS source,
  CASE WHEN status = 'pending' AND j.id = job_id THEN CASE WHEN outcome IN ('cache', 'dedupe') THEN target WHEN outcome = 'enriched' THEN j.lexeme_id END END AS result_id,
  CASE WHEN status = 'pending' AND j.id = job_id THEN CASE outcome WHEN 'cache' THEN 1.0 WHEN 'dedupe' THEN 0.9 WHEN 'enriched' THEN 0.9 END END::DOUBLE AS confidence
FROM jobs j LEFT JOIN found f ON f.lexeme_id = j.lexeme_id""")
def n_04_process(spark, sf_dir):
    """The jobs after one pass over the queue."""
    queue, lex, _, results = _queue(spark, sf_dir)
    return jobs.finished_jobs(queue, jobs.outcomes(queue, lex, results)).select("id", "status", "source", "result_id", "confidence")


@register("n_04_repointed", f"""
WITH {_PROCESSED}, v AS (
  SELECT c_custkey AS id, c_nationkey AS workspace_id, c_custkey AS lexeme_id, target FROM customer LEFT JOIN found ON found.lexeme_id = c_custkey
), moved AS (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, target ORDER BY id) AS r FROM v
  WHERE target IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v x WHERE x.target IS NULL AND x.workspace_id = v.workspace_id AND x.lexeme_id = v.target)
)
SELECT id, workspace_id, lexeme_id FROM v WHERE target IS NULL UNION ALL SELECT id, workspace_id, target FROM moved WHERE r = 1""")
def n_04_repointed(spark, sf_dir):
    """The vocabulary after one pass over the queue."""
    queue, lex, vocab, results = _queue(spark, sf_dir)
    return jobs.repointed_vocab(vocab, jobs.outcomes(queue, lex, results)).select("id", "workspace_id", "lexeme_id")


# runs that go on -------------------------------------------------------------------------------------------------------------
def _evaluations(spark, sf_dir):
    """Evaluations with errors: the length scores of 0 are failures of their scorer."""
    rows = evaluations(spark, sf_dir)
    return rows.withColumn("error", F.when((F.col("evaluator") == "length_in_band") & (F.col("score") == 0), "timeout"))


def _length_score(docs):
    n = F.size(T.words(F.col("text")))
    return docs.select("sentence_id", "arm", "cell", F.lit("length_in_band").alias("evaluator"), n.between(50, 700).cast("double").alias("score"), F.when(n > 3000, "too long").alias("error"))


def _resumed(spark, sf_dir):
    """(evaluations before, rows of a run that was stopped after five pieces and went on)."""
    old, path = _evaluations(spark, sf_dir), shared_folder(spark, "rescore")
    rescoring.stage(path, sentences(spark, sf_dir), old, "length_in_band")
    rescoring.score_pieces(spark, path, _length_score, most=5)
    assert not rescoring.score_pieces(spark, path, _length_score)
    return old, rescoring.scored(spark, path)


_RESCORED = f"""
{EVALUATIONS.strip()}, e AS (SELECT *, CASE WHEN evaluator = 'length_in_band' AND score = 0 THEN 'timeout' END AS error FROM ev),
fresh AS (
  SELECT doc_id AS sentence_id, source AS arm, lang AS cell, 'length_in_band' AS evaluator, CAST(len(tok) BETWEEN 50 AND 700 AS INT)::DOUBLE AS score, CASE WHEN len(tok) > 3000 THEN 'too long' END AS error
  FROM (SELECT *, {sql_tokens()} AS tok FROM documents) WHERE doc_id IN (SELECT sentence_id FROM e WHERE error IS NOT NULL)
), now AS (SELECT * FROM e WHERE error IS NULL UNION ALL SELECT * FROM fresh)"""


@register("n_06_rescored", f"WITH {_RESCORED} SELECT sentence_id, arm, cell, evaluator, score, error FROM now")
def n_06_rescored(spark, sf_dir):
    """Evaluations after a rescoring run that stopped and went on: rows with an error are scored again."""
    old, fresh = _resumed(spark, sf_dir)
    return rescoring.replaced(old, fresh, "length_in_band")


@register("n_06_rollups", f"WITH {_RESCORED} SELECT arm, cell, evaluator, round(avg(score) FILTER (error IS NULL), 9) AS mean, count(*) FILTER (error IS NULL) AS n, count(error) AS errors FROM now GROUP BY ALL")
def n_06_rollups(spark, sf_dir):
    """Roll-ups after the run, refreshed where it has changed something."""
    old, fresh = _resumed(spark, sf_dir)
    group = ["arm", "cell"]
    return rescoring.refreshed(rescoring.rolled(old, group), rescoring.replaced(old, fresh, "length_in_band"), fresh, "length_in_band", group)


@register("j_09_cached_results", """
WITH d AS (SELECT 'document' AS kind, doc_id AS id, lang, text FROM documents UNION ALL SELECT 'item', item_id, 'en', text FROM benchmark),
first AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents)
SELECT kind, id, CASE WHEN d.text LIKE '%#%' THEN NULL ELSE length(coalesce(d.text, '')) END::DOUBLE AS result, CASE WHEN d.text LIKE '%#%' THEN 'refused' END AS error,
  f.text IS NOT NULL AND d.text NOT LIKE '%#%' AS cached
FROM d LEFT JOIN first f ON f.lang = coalesce(d.lang, '') AND f.text = coalesce(d.text, '')""")
def j_09_cached(spark, sf_dir):
    """A second run over documents and benchmark items: what the first one had over documents isn't scored again, errors are."""
    path = shared_folder(spark, "results")

    def score(rows):
        bad = F.col("text").contains("#")
        return rows.select("digest", F.when(~bad, F.length(F.coalesce("text", F.lit("")))).alias("result"), F.when(bad, "refused").alias("error"))

    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "lang", "text")
    items = table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.lit("en").alias("lang"), "text")
    rescoring.cached_results(docs, path, score)
    return rescoring.cached_results(docs.unionByName(items), path, score).select("kind", "id", "result", "error", "cached")


# stored views ----------------------------------------------------------------------------------------------------------------
def _stored(spark, sf_dir):
    """(views, added, moved, deleted): orders as the views of their customers, and a new one for each customer."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    views_ = orders.select(key.alias("id"), F.col("o_custkey").alias("workspace_id"), (key % 7).cast("int").alias("position"))
    added = table(spark, sf_dir, "customer").filter("c_nationkey < 12").select((-1 - F.col("c_custkey")).alias("id"), F.col("c_custkey").alias("workspace_id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 4).cast("int").alias("position"))
    moved = orders.filter("o_totalprice < 100000").select(key.alias("id"), (key % 4).cast("int").alias("position"))
    return views_, added, moved, orders.filter("o_orderstatus <> 'P'").select(key.alias("id"), (key % 100).alias("seq"))


_STORED = """
v AS (
  SELECT o_orderkey AS id, o_custkey AS ws, o_orderkey % 7 AS pos, CASE WHEN o_totalprice < 100000 THEN o_orderkey % 4 END AS moved, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey % 100 END AS seq, false AS added FROM orders
  UNION ALL SELECT -1 - c_custkey, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 4 END, NULL, NULL, true FROM customer WHERE c_nationkey < 12
), k AS (
  SELECT *, coalesce(moved, CASE WHEN added THEN pos END) AS wanted, count(*) FILTER (seq IS NULL) OVER (PARTITION BY ws) AS remain, row_number() OVER (PARTITION BY ws ORDER BY seq DESC NULLS LAST, id DESC) AS r FROM v
), kept AS (SELECT * FROM k WHERE seq IS NULL OR remain = 0 AND r = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY ws, wanted IS NULL ORDER BY added, pos, id) - 1 AS rest FROM kept)"""


@register("m_04_positions", f"""
WITH {_STORED} SELECT id, ws AS workspace_id, CAST(row_number() OVER (PARTITION BY ws ORDER BY coalesce(wanted, rest), wanted IS NULL, id) - 1 AS INTEGER) AS position FROM ranked""")
def m_04_positions(spark, sf_dir):
    """Positions without gaps after inserts, moves and deletes."""
    return views.rearranged(*_stored(spark, sf_dir))[0]


@register("m_04_refused", f"WITH {_STORED} SELECT id, ws AS workspace_id FROM kept WHERE seq IS NOT NULL")
def m_04_refused(spark, sf_dir):
    """Deletes of a workspace's last view."""
    return views.rearranged(*_stored(spark, sf_dir))[1]


def _configured(spark, sf_dir):
    """Customers as views of eight shapes."""
    k = F.col("c_custkey") % 8
    name = F.when(k < 3, "All words").when(k < 5, "Review queue").when(k == 5, "Gallery").otherwise("Mine")
    layout = F.when(F.col("c_custkey") % 3 == 0, "gallery").otherwise("table")
    shapes = (
        '{"query":{"search":"@"},"sorts":[{"field":"word","direction":"asc"}],"visibleProperties":["word","box","word"],"propertyOrder":["box"]}', '{"sorts":[],"visibleProperties":["word","tags"],"own":"@"}',
        '{"sorts":[{"field":"createdAt","direction":"desc"}],"visibleProperties":["word","createdAt"],"propertyOrder":["word"]}', '{"query":{"learned":"not_learned","due":"due_now","search":"@"},"visibleProperties":["word"]}',
        '{"query":{"learned":"not_learned","due":"due_now","statusMatch":"any"},"visibleProperties":["word","box","word"]}', '{"own":"@"}', '{"visibleProperties":["a","b","a","@","@"],"propertyOrder":["b"]}', None,
    )
    config = F.element_at(F.array(*[F.lit(s) for s in shapes]), (k + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), layout.alias("layout"), F.replace(config, F.lit("@"), F.col("c_mktsegment")).alias("config"))


@register("g_18_migrated", f"""
WITH v AS (SELECT c_custkey, c_mktsegment, c_custkey % 8 AS k, c_custkey % 3 = 0 AS cards FROM customer)
SELECT c_custkey, CASE WHEN k < 3 THEN 'All words' WHEN k < 5 THEN 'Review queue' WHEN k = 5 THEN CASE WHEN cards THEN 'Cards' ELSE 'Gallery' END ELSE 'Mine' END AS name,
  CASE k WHEN 0 THEN 'word,createdAt,box' WHEN 1 THEN 'word,tags,createdAt' WHEN 2 THEN 'word,createdAt' WHEN 3 THEN 'word' WHEN 4 THEN 'word,box' WHEN 6 THEN 'a,b,' || c_mktsegment END AS visible,
  CASE k WHEN 0 THEN 'createdAt,box' WHEN 1 THEN 'word,tags,createdAt' WHEN 2 THEN 'word' WHEN 4 THEN '' WHEN 6 THEN 'b' END AS ordered,
  CASE WHEN k IN (0, 1, 2) THEN 'createdAt' END AS sorted, CASE WHEN k IN (3, 4) THEN 'any' END AS status_match, CASE WHEN k IN (0, 3) THEN c_mktsegment END AS search, CASE WHEN k IN (1, 5) THEN c_mktsegment END AS own,
  CASE k WHEN 0 THEN 'all_words' WHEN 1 THEN 'all_words' WHEN 3 THEN 'review_queue' WHEN 4 THEN 'dedupe' WHEN 5 THEN CASE WHEN cards THEN 'cards' ELSE '' END WHEN 6 THEN 'dedupe' ELSE '' END AS migrations
FROM v""")
def g_18_migrated(spark, sf_dir):
    """Views brought up to date, some of their entries."""
    rows = views.migrated(_configured(spark, sf_dir))
    names = lambda key: F.array_join(F.from_json(F.get_json_object("config", f"$.{key}"), "array<string>"), ",")
    get = lambda path: F.get_json_object("config", path)
    return rows.select(
        "c_custkey", "name", names("visibleProperties").alias("visible"), names("propertyOrder").alias("ordered"), get("$.sorts[0].field").alias("sorted"), get("$.query.statusMatch").alias("status_match"),
        get("$.query.search").alias("search"), get("$.own").alias("own"), F.array_join("migrations", ",").alias("migrations"),
    )


# Welsh cases -----------------------------------------------------------------------------------------------------------------
_TENSES = ("pres", "past", "imperf", "fut")


def _lexicon(spark, sf_dir):
    """(verbs, lexicon): parts as verbs; some lack a form, some have a spoken or short one besides, all forms twice."""
    part = dealt(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lower(F.split("p_name", " ")[0]), F.col("p_partkey").cast("string")).alias("lemma"))
    verbs = part.select("lemma", F.when(F.col("p_size") % 3 == 0, F.concat("lemma", F.lit("io"))).otherwise("").alias("verbnoun"))
    aux = spark.createDataFrame([("bod",), ("gwneud",)], "lemma string").select(F.lit(1).alias("p_partkey"), F.lit(1).alias("p_size"), "lemma")
    cell = F.array(*[F.struct(F.lit(t).alias("tense"), F.lit(p).alias("person"), F.lit(k).alias("k")) for t in _TENSES for k, p in enumerate(forms.SLOTS)], F.struct(F.lit("infin").alias("tense"), F.lit(None).cast("string").alias("person"), F.lit(9).alias("k")))
    rows = part.unionByName(aux).select("*", F.inline(cell)).filter(~((F.col("p_size") % 10 == 3) & (F.col("tense") == "past") & (F.col("k") == 2)) & ~((F.col("p_size") == 7) & (F.col("tense") == "infin")))
    plain = F.concat("lemma", "tense", F.coalesce("person", F.lit("")))
    surface = F.array(
        F.struct(F.lit(1).alias("place"), plain.alias("surface"), F.lit("literary").alias("notes")), F.struct(F.lit(2).alias("place"), F.concat(plain, F.lit("x")).alias("surface"), F.when(F.col("p_size") % 4 == 0, "short").alias("notes")),
        F.struct(F.lit(3).alias("place"), F.concat(plain, F.lit("y")).alias("surface"), F.when(F.col("p_size") % 5 == 0, "spoken").when(F.col("p_size") % 2 == 0, "short").alias("notes")), F.struct(F.lit(4).alias("place"), plain.alias("surface"), F.lit(None).cast("string").alias("notes")),
    )
    return verbs, rows.select("lemma", "tense", "person", F.inline(surface))


def _sql_surfaces(plain: str, size: str) -> str:
    """The alternatives of the lexicon's four rows, as its rules have them."""
    ordered = f"[{plain}, {plain} || 'x', {plain} || 'y']"
    best = f"CASE WHEN {size} % 5 = 0 THEN 3 WHEN {size} % 4 = 0 THEN 2 WHEN {size} % 2 = 0 THEN 3 ELSE 2 END"
    return f"list_concat([({ordered})[{best}]], list_filter({ordered}, lambda w: w <> ({ordered})[{best}]))"


_CASES = f"""
p AS (SELECT lower(string_split(p_name, ' ')[1]) || CAST(p_partkey AS VARCHAR) AS lemma, p_size FROM part),
v AS (SELECT *, CASE WHEN p_size % 3 = 0 THEN list_concat([lemma || 'io'], {_sql_surfaces("(lemma || 'infin')", 'p_size')}) ELSE {_sql_surfaces("(lemma || 'infin')", 'p_size')} END AS nouns FROM p WHERE p_size <> 7),
g AS (SELECT unnest([{', '.join(str({'construction': c, 'tense': t, 'aux': a, 'look': x, 'particle': q}) for c, t, a, x, q in welsh.GRID)}]) AS c),
n AS (SELECT unnest([{', '.join(str({'person': a, 'pp': b, 'pn': c}) for a, b, c in welsh.PERSONS)}]) AS n),
r AS (SELECT v.*, c.construction, c.tense, c.aux, c.look, c.particle, n.person, n.pp, n.pn, c.construction || '_' || c.tense || '_' || n.person AS cell_id, c.aux = '' AND c.look = 'past' AND n.person = '3s' AND p_size % 10 = 3 AS gap FROM v, g, n),
s AS (SELECT *, CASE WHEN aux = '' THEN {_sql_surfaces("(lemma || look || person)", 'p_size')} ELSE {_sql_surfaces("(aux || look || person)", '1')} END AS surfaces, list_transform(nouns, lambda w: {_mutation_sql('w', forms.SOFT)}) AS soft FROM r WHERE NOT gap),
t AS (SELECT *, aux <> '' AND tense = 'past' AS is_past, CASE WHEN aux = '' THEN surfaces WHEN tense = 'past' THEN list_concat(soft, list_filter(nouns, lambda w: NOT list_contains(soft, w))) ELSE nouns END AS words FROM s)"""


@register("d_22_cases", f"""
WITH {_CASES}
SELECT lemma, nouns[1] AS verbnoun, cell_id, construction, tense, person, pp AS probed_person, pn AS probed_number, particle, is_past AS requires_soft_mutation, aux AS aux_lemma,
  CASE WHEN aux = '' THEN '' ELSE surfaces[1] END AS aux_gold, CASE WHEN aux = '' THEN '' ELSE array_to_string(surfaces[2:], '|') END AS aux_gold_alts, words[1] AS gold, array_to_string(words[2:], '|') AS gold_alts,
  array_to_string(CASE WHEN aux = '' THEN words ELSE list_concat(surfaces, words) END, '|') AS match_forms FROM t""")
def d_22_cases(spark, sf_dir):
    """The 42 cells of every verb with the alternatives in their order."""
    return welsh.cases(*_lexicon(spark, sf_dir))[0]


@register("d_22_gaps", f"""
WITH {_CASES}
SELECT lemma, NULL AS cell_id, 'infin' AS missing FROM p WHERE p_size = 7 UNION ALL SELECT lemma, cell_id, lemma || '/' || look || '/' || person FROM r WHERE gap""")
def d_22_gaps(spark, sf_dir):
    """What the lexicon lacks."""
    return welsh.cases(*_lexicon(spark, sf_dir))[1]


# paradigms -------------------------------------------------------------------------------------------------------------------
def _paradigms(spark, sf_dir):
    """(p_partkey, verb, participle, cells): regular paradigms of the parts' first words, some of them spoilt."""
    k, word = F.col("p_size") % 11, F.lower(F.split("p_name", " ")[0])
    ending = F.when(k == 7, "ajear").when(k == 8, "cer").otherwise(F.element_at(F.array(*[F.lit(e) for e in ("ar", "er", "ir")]), (F.col("p_partkey") % 3 + 1).cast("int")))
    rows = dealt(spark, sf_dir, "part").withColumn("verb", F.concat(word, ending))
    spoilt = {
        "future/2nd/plural": lambda f: F.when(k != 1, f), "imperfect/1st/plural": lambda f: F.when(k == 2, F.concat(f, F.lit("1"))).otherwise(f), "preterite/1st/singular": lambda f: F.when(k == 5, F.concat(word, F.lit("ía"))).otherwise(f),
        "present/1st/singular": lambda f: F.when(k == 6, F.col("verb")).otherwise(f), "conditional/3rd/singular": lambda f: F.when(k == 8, F.concat(f, F.lit("acho"))).otherwise(f),
    }
    slots = {"1st/singular": "1s", "2nd/singular": "2s", "3rd/singular": "3s", "1st/plural": "1p", "2nd/plural": "2p", "3rd/plural": "3p"}
    cells = []
    for name in forms.PARADIGM:
        tense, _, slot = name.partition("/")
        form = forms.spanish_regular(F.col("verb"), tense, slots[slot])
        cells += [F.lit(name), spoilt.get(name, lambda f: f)(form)]
    participle = F.when(k == 3, "incluso").when(k == 4, "").when(k == 9, F.concat(word, F.lit("xyz"))).otherwise(F.concat(word, F.lit("ado")))
    return rows.select("p_partkey", "verb", participle.alias("participle"), F.create_map(*cells).alias("cells"))


_SQL_CELLS = "[" + ", ".join(f"{{'name': '{name}', 'ends': {[forms.SPANISH_ENDINGS[name.split('/')[0]][c].split()[k % 6] for c in ('ar', 'er', 'ir')]}}}" for k, name in enumerate(forms.PARADIGM)) + "]"


@register("c_21_paradigm_reasons", f"""
WITH p AS (
  SELECT p_partkey, p_size % 11 AS k, lower(string_split(p_name, ' ')[1]) AS w, CASE p_size % 11 WHEN 7 THEN 'ajear' WHEN 8 THEN 'cer' ELSE ['ar', 'er', 'ir'][p_partkey % 3 + 1] END AS e FROM part
), v AS (
  SELECT *, w || e AS verb, (w || e)[:-3] AS stem, CASE right(e, 2) WHEN 'ar' THEN 1 WHEN 'er' THEN 2 ELSE 3 END AS c, CASE k WHEN 3 THEN 'incluso' WHEN 4 THEN '' WHEN 9 THEN w || 'xyz' ELSE w || 'ado' END AS part FROM p
), f AS (
  SELECT *, unnest({_SQL_CELLS}) AS cell, unnest(range(30)) AS i FROM v
), g AS (
  SELECT *, cell.name AS name, CASE WHEN k = 1 AND cell.name = 'future/2nd/plural' THEN NULL WHEN k = 2 AND cell.name = 'imperfect/1st/plural' THEN stem || cell.ends[c] || '1' WHEN k = 5 AND cell.name = 'preterite/1st/singular' THEN w || 'ía'
    WHEN k = 6 AND cell.name = 'present/1st/singular' THEN verb WHEN k = 8 AND cell.name = 'conditional/3rd/singular' THEN stem || cell.ends[c] || 'acho' ELSE stem || cell.ends[c] END AS form FROM f
), h AS (
  SELECT *, CASE WHEN coalesce(form, '') = '' THEN 'missing:' || name WHEN NOT regexp_full_match(form, '[A-Za-zÁÉÍÓÚÜáéíóúüñÑ]+') THEN 'junk_form:' || name || ':' || form
    WHEN contains(form, 'ach') AND verb LIKE '%cer' AND verb NOT LIKE '%ach%' THEN 'verbecc_garbage:' || form END AS bad FROM g
), r AS (
  SELECT p_partkey, verb, part, min(i) FILTER (bad IS NOT NULL) AS first_bad, arg_min(bad, i) FILTER (bad IS NOT NULL) AS bad, max(form) FILTER (name = 'present/1st/singular') AS yo, max(form) FILTER (name = 'preterite/1st/singular') AS pret FROM h GROUP BY ALL
)
SELECT CASE WHEN verb LIKE '%ajear' THEN 'noun_adj_like' WHEN pret IS NULL OR pret LIKE '%ía' THEN 'bad_preterite_1sg' WHEN NOT regexp_full_match(part, '[A-Za-zÁÉÍÓÚÜáéíóúüñÑ]+') THEN 'bad_participle'
  WHEN NOT regexp_matches(part, '(ado|ido|to|so|cho)$') OR part = 'incluso' THEN 'bad_participle_surface:' || part WHEN bad IS NOT NULL THEN bad WHEN yo = verb THEN 'present_1sg_eq_infinitive' ELSE 'ok' END AS reason, count(*) AS n
FROM r GROUP BY 1""")
def c_21_reasons(spark, sf_dir):
    """Paradigms by the first reason against them."""
    rows = _paradigms(spark, sf_dir).select(forms.paradigm_reason(F.col("verb"), F.col("participle"), F.col("cells")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))
