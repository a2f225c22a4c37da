"""Replies of judges and models: JSON checks with ordered error codes, yes/no and candidate parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The judge's enums and function words of two languages.
TARGET_FORM_USE = ("correct_main_verb", "correct_but_not_main_verb", "wrong_agreement_or_role", "wrong_construction", "mentioned_or_quoted_only", "absent")
FLAGS = ("odd_collocation", "subject_verb_disagreement", "tense_context_conflict", "repetition_or_degeneration", "mixed_language_or_meta_output", "wrong_construction", "mutation_error")
AXES = ("grammaticality", "naturalness", "semantic_coherence")
ENGLISH = ("the and is are not with of to in a an that this would does for or but as it its on be was were has have verb subject sentence grammar agree").split()
SPANISH = ("el la los las un una unos unas y o es está están son no de del en que pero aunque porque con sin para por se su sus verbo palabra oración frase sujeto concuerda gramaticalmente").split()
_KEYS = (*AXES, "target_form_use", "flags", "rationale")


def mostly_spanish(text: Column) -> Column:
    """Whether more Spanish than English function words occur."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-záéíóúüñ]+)"), 1)
    count = lambda own: F.size(F.filter(tokens, lambda t: t.isin(own)))
    return count(SPANISH) > count(ENGLISH)


def judge_error(raw: Column) -> Column:
    """Null for a valid reply, else the first of the error codes that holds."""
    field = lambda k: F.get_json_object(raw, f"$.{k}")
    flags = F.from_json(field("flags"), "array<string>")
    whole = F.rlike(F.trim(raw), F.lit("(?s)^\\{.*\\}$"))
    keys = F.json_object_keys(F.when(whole, raw))
    missing = F.array_except(F.array(*[F.lit(k) for k in _KEYS]), keys)
    case = (
        F.when(raw.isNull() | F.try_parse_json(raw).isNull(), "json_decode_failed")
        .when(~whole, "top_level_not_object")
        .when((F.size(keys) == 1) & F.array_contains(keys, "error"), "judge_error")
        .when(F.size(missing) > 0, "missing_keys")
    )
    for axis in AXES:
        case = case.when(~F.coalesce(F.rlike(field(axis), F.lit("^[1-5]$")), F.lit(False)), f"{axis}_out_of_range")
    rationale = F.trim(F.coalesce(field("rationale"), F.lit("")))
    return (
        case.when(~F.coalesce(field("target_form_use").isin(*TARGET_FORM_USE), F.lit(False)), "bad_target_form_use")
        .when(~F.coalesce(field("flags").startswith("["), F.lit(False)), "flags_not_list")
        .when(F.exists(flags, lambda f: ~F.coalesce(f.isin(*FLAGS), F.lit(False))), "bad_flag")
        .when(F.size(flags) != F.size(F.array_distinct(flags)), "duplicate_flag")
        .when(rationale == "", "rationale_empty")
        .when(mostly_spanish(F.substring(rationale, 1, 240)), "rationale_not_english")
    )


def label_error(label: Column) -> Column:
    """The same for a human label: a struct with the axes, target_form_use and flags."""
    case = F.when(label.isNull(), "missing")
    for axis in AXES:
        case = case.when(~F.coalesce(label[axis].between(1, 5), F.lit(False)), f"{axis}_out_of_range")
    return (
        case.when(~F.coalesce(label["target_form_use"].isin(*TARGET_FORM_USE), F.lit(False)), "bad_target_form_use")
        .when(F.exists(label["flags"], lambda f: ~F.coalesce(f.isin(*FLAGS), F.lit(False))), "bad_flag")
    )


def yes_no(reply: Column) -> Column:
    """True or false, or null where both words or none occur."""
    low = F.lower(reply)
    word = lambda w: F.rlike(low, F.lit(f"(^|[^a-z]){w}([^a-z]|$)"))
    return F.when(word("yes") & ~word("no"), F.lit(True)).when(word("no") & ~word("yes"), F.lit(False))


def candidates(reply: Column) -> Column:
    """(mode, sentences) of a reply that lists candidates: whole JSON, the JSON block in it, quoted pairs, or failed."""
    schema = "struct<candidates: array<struct<sentence: string>>>"
    good = lambda parsed: F.when(F.size(F.coalesce(parsed["candidates"], F.array().cast("array<struct<sentence:string>>"))) > 0, F.filter(F.transform(parsed["candidates"], lambda c: F.trim(c["sentence"])), lambda s: s != ""))
    block = F.regexp_extract(reply, "(?s)(\\{.*\\})", 1)
    pairs = F.regexp_extract_all(reply, F.lit("\"sentence\"\\s*:\\s*\"([^\"]+)\""), 1)
    whole, part = good(F.from_json(F.trim(reply), schema)), good(F.from_json(block, schema))
    some = lambda a: a.isNotNull() & (F.size(a) > 0)
    starts = F.startswith(F.trim(reply), F.lit("{"))
    return F.struct(
        F.when(starts & some(whole), "json").when(some(part), "json_block").when(some(pairs), "pairs").otherwise("failed").alias("mode"),
        F.when(starts & some(whole), whole).when(some(part), part).when(some(pairs), pairs).otherwise(F.array().cast("array<string>")).alias("sentences"),
    )


def plain_sentence(reply: Column) -> Column:
    """The sentence in a model's reply: without thinking and chat marks, labels and quotes; the first line; null for JSON leaks."""
    text = F.regexp_replace(reply, "(?s)<think>.*?(</think>|$)", "")
    text = F.trim(F.regexp_replace(text, "<\\|[^|>]*\\|>", ""))
    line = F.trim(F.substring_index(text, "\n", 1))
    line = F.regexp_replace(line, "^(?i)(sentence|answer|oración|frase)\\s*:\\s*", "")
    line = F.regexp_replace(line, "^[\"“”'«]+|[\"“”'»]+$", "")
    return F.when(F.rlike(line, F.lit("^[\\{\\[]")) | (line == ""), None).otherwise(line)
