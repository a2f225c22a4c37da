"""Evaluators: DataFrame in, rows of (sentence_id, evaluator, score, details) out; results are unions of these."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import forms, judge
from ..functions import text as T

# Token counts of the length labels.
BANDS = {"short": (2, 5), "short_expanded": (4, 8), "medium": (5, 9), "long": (10, 16)}
# A checker's categories that count as grammar.
GRAMMAR_CATEGORIES = ("AGREEMENT_VERBS", "AGREEMENT_NOUNS", "GRAMMAR", "MISSPELLING", "CONFUSIONS")


def _norm(tokens: Column) -> Column:
    return F.transform(T.with_clitic_heads(tokens), T.casefold)


def _alternatives(first: Column, alts: Column) -> Column:
    own = F.concat(F.array(first), F.split(F.coalesce(alts, F.lit("")), "\\|"))
    return F.filter(F.transform(own, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def expected_form(text: Column, form: Column, alts: Column, aux: Column, particle: Column, soft: Column) -> Column:
    """score and reason: a form, and the auxiliary and particle where given, as whole tokens; forms may be soft-mutated if ``soft``."""
    tokens = T.edge_words(text)
    listed = _alternatives(F.trim(form), alts)
    cands = F.array_distinct(F.transform(F.when(soft, F.concat(listed, F.transform(listed, lambda w: forms.mutated(w)))).otherwise(listed), T.casefold))
    has = lambda wanted: F.arrays_overlap(_norm(tokens), wanted)
    given = lambda x: F.coalesce(F.trim(x), F.lit("")) != ""
    aux_ok = ~given(aux) | has(F.transform(_alternatives(aux, F.lit("")), T.casefold))
    yn = (T.casefold(particle) == "yn") & soft
    part_ok = ~given(particle) | has(F.array(T.casefold(particle))) | (yn & F.exists(tokens, lambda t: F.lower(t).endswith("'n") | F.lower(t).endswith("’n")))
    reason = (
        F.when(~given(form), "missing_expected_form")
        .when(~F.coalesce(has(cands), F.lit(False)), "missing_expected_form_token")
        .when(~F.coalesce(aux_ok, F.lit(False)), "missing_expected_aux")
        .when(~F.coalesce(part_ok, F.lit(False)), "missing_particle")
    )
    return F.struct(F.when(reason.isNull(), 1.0).otherwise(0.0).alias("score"), reason.alias("reason"))


def band(label: Column, construction: Column | None = None) -> Column:
    """The label with by_construction resolved."""
    kind = F.when(T.key(construction) == "periphrastic", "short_expanded").otherwise("short") if construction is not None else F.lit("short")
    return F.when(label == "by_construction", kind).otherwise(F.coalesce(F.nullif(label, F.lit("")), F.lit("short")))


def in_band(n: Column, label: Column) -> Column:
    """1 within the label's band, 0 outside; null for an unknown label."""
    return reduce(lambda rest, b: F.when(label == b[0], n.between(*b[1]).cast("double")).otherwise(rest), BANDS.items(), F.lit(None).cast("double"))


def length_in_band(rows: DataFrame) -> DataFrame:
    n = F.size(T.words(F.col("text")))
    score = in_band(n, F.col("length_label"))
    details = F.to_json(F.struct(n.alias("token_count"), score.isNotNull().alias("known")))
    return rows.select("sentence_id", F.lit("length_in_band").alias("evaluator"), F.coalesce(score, F.lit(0.0)).alias("score"), details.alias("details"))


def clause_count(rows: DataFrame) -> DataFrame:
    """From a parse, array<struct<pos, dep, head_pos>>: root verbs, clausal dependents and verbs joined to verbs; min(c, 4) / 4."""
    verb = lambda t: t["pos"].isin("VERB", "AUX")
    hit = lambda t: ((t["dep"] == "ROOT") & verb(t)) | t["dep"].isin("ccomp", "xcomp", "advcl", "relcl") | ((t["dep"] == "conj") & verb(t) & t["head_pos"].isin("VERB", "AUX"))
    n = F.size(F.filter("parse", hit))
    return rows.select("sentence_id", F.lit("clause_count").alias("evaluator"), (F.least(n, F.lit(4)) / 4).alias("score"), F.to_json(F.struct(n.alias("clause_count"))).alias("details"))


def of_categories(matches: Column, categories: tuple[str, ...] = GRAMMAR_CATEGORIES) -> Column:
    """The matches of these categories."""
    return F.filter(matches, lambda m: m["category"].isin(*categories))


def grammar(rows: DataFrame, categories: tuple[str, ...] = GRAMMAR_CATEGORIES) -> DataFrame:
    """From a checker's matches, array<struct<category, message>>: 1 without a match of the categories."""
    kept = of_categories(F.col("matches"), categories)
    details = F.struct(F.size(kept).alias("match_count"), F.size("matches").alias("total_match_count"), F.size(T.words(F.col("text"))).alias("token_count"))
    return rows.select("sentence_id", F.lit("grammar").alias("evaluator"), (F.size(kept) == 0).cast("double").alias("score"), F.to_json(details).alias("details"))


def perplexity(rows: DataFrame) -> DataFrame:
    """From a model's mean_nll: exp(-nll) within 0 and 1, and the perplexity; 0 with an error without one."""
    details = F.struct(F.round(F.exp("mean_nll"), 6).alias("perplexity"), F.when(F.col("mean_nll").isNull(), "no_scoreable_tokens").alias("error"))
    score = F.when(F.col("mean_nll").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.exp(-F.col("mean_nll"))))  # least() skips nulls
    return rows.select("sentence_id", F.lit("fluency_perplexity").alias("evaluator"), score.alias("score"), F.to_json(details).alias("details"))


def naturalness(rows: DataFrame) -> DataFrame:
    """From a judge's reply: naturalness / 5, or 0 with the error code."""
    error = judge.judge_error(F.col("raw"))
    score = F.when(error.isNull(), F.get_json_object("raw", "$.naturalness").cast("double") / 5).otherwise(0.0)
    return rows.select("sentence_id", F.lit("naturalness_llm_judge").alias("evaluator"), score.alias("score"), F.to_json(F.struct(error.alias("error"))).alias("details"))


def grammar_stub(rows: DataFrame) -> DataFrame:
    """The mean of three tests: the keyword's first three letters occur (without a keyword they do), a translation, a sentence."""
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    tests = {
        "has_keyword_stem": F.contains(F.lower(given("text")), F.lower(F.substring(given("keyword"), 1, 3))),
        "has_translation": F.rlike(given("translation"), F.lit("(?U)\\S")),
        "is_nonempty": F.rlike(given("text"), F.lit("(?U)\\S")),
    }
    score = F.round(sum((t.cast("double") for t in tests.values()), F.lit(0.0)) / 3, 4)
    details = F.to_json(F.struct(*[t.alias(name) for name, t in tests.items()]))
    return rows.select("sentence_id", F.lit("grammar_stub").alias("evaluator"), score.alias("score"), details.alias("details"))


def verb_morphology(rows: DataFrame) -> DataFrame:
    """From parsed tokens, array<struct<lemma, pos, tense, person, number>>: 1 if one agrees with the target in all; else why not."""
    verbs = F.filter("parse", lambda t: t["pos"].isin("VERB", "AUX"))
    lemma = F.filter(verbs, lambda t: t["lemma"] == F.col("lemma"))
    full = F.filter(lemma, lambda t: t["tense"].eqNullSafe(F.col("tense")) & t["person"].eqNullSafe(F.col("person")) & t["number"].eqNullSafe(F.col("number")))
    reason = F.when(F.size(verbs) == 0, "no_verb").when(F.size(lemma) == 0, "lemma_not_found").when(F.size(full) == 0, "features_differ")
    return rows.select("sentence_id", F.lit("verb_morphology").alias("evaluator"), reason.isNull().cast("double").alias("score"), F.to_json(F.struct(reason.alias("reason"))).alias("details"))


Evaluator = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, Evaluator] = {"length_in_band": length_in_band, "clause_count": clause_count, "fluency_perplexity": perplexity, "naturalness_llm_judge": naturalness, "grammar_stub": grammar_stub, "verb_morphology": verb_morphology}


def evaluate(rows: DataFrame, names: list[str], registry: dict[str, Evaluator] | None = None) -> DataFrame:
    """The tall table of these evaluators' scores; names that repeat count once."""
    known = registry or REGISTRY
    return reduce(DataFrame.unionByName, [known[n](rows) for n in dict.fromkeys(names)])
