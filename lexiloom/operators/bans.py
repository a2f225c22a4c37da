"""Forms and pronouns that a sentence for one cell of a verb's paradigm must not have, and their hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Tenses, subjects by slot, slots of habitual fallbacks, and patterns of mentions and subjects.
TENSES = ("present", "preterite", "imperfect", "future", "conditional")
SUBJECTS = {"1s": ("yo",), "2s": ("tú", "tu"), "3s": ("él", "ella", "usted"), "1p": ("nosotros", "nosotras"), "2p": ("vosotros", "vosotras"), "3p": ("ellos", "ellas", "ustedes")}
THIN = ("1s", "3s")
_QUOTED = "(?s)[\"“”«»'].*?[\"“”«»']"
_MENTION = "(?iU)\\b(?:forma|palabra|verbo|conjugaci[oó]n)\\b[^\\n.!?]{0,40}\\b\\Q"
_SUBJECT = "(?iU)\\b(?:yo|t[uú]|[eé]l|ella|usted|nosotros|nosotras|vosotros|vosotras|ellos|ellas|ustedes)\\s+\\Q"
_LIGHT = "(?iU)\\b(?:es|incluye|menciona(?:mos)?|dij[oe]|llamad[oa])\\s+\\Q"
_WORD = "(?U)([\\p{L}]+)"


def surface(form: Column) -> Column:
    return T.casefold(F.trim(T.composed(form)))


def _pronouns(slot: Column) -> Column:
    every = F.array(*[F.lit(p) for own in SUBJECTS.values() for p in own])
    allowed = F.create_map(*[x for k, own in SUBJECTS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in own]))])
    own = F.try_element_at(allowed, slot)
    return F.when(own.isNotNull(), F.array_except(every, own)).otherwise(F.array().cast("array<string>"))


def ban_sets(cells: DataFrame, paradigms: DataFrame, mode: str = "full") -> DataFrame:
    """cells (lemma, tense, slot, expected) with the sorted arrays forms and pronouns that are banned.

    full: the other forms of the tense (for a participle: all forms of all tenses) and the infinitive, and the pronouns of
    other subjects; forms_only and pronouns_only: one of the two; agree: forms of other slots and pronouns; thin: only the
    habitual fallbacks and pronouns. The gold form is never banned. paradigms has (lemma, tense, slot, form); its forms are
    gathered by lemma and tense first, a few dozen at most.
    """
    if mode not in ("full", "forms_only", "pronouns_only", "thin", "agree"):
        raise ValueError(f"unknown mode: {mode}")
    forms = paradigms.filter(F.col("tense").isin(*TENSES) & F.col("form").isNotNull()).groupBy(surface(F.col("lemma")).alias("__lemma")).agg(F.collect_set(F.struct("tense", "slot", surface(F.col("form")).alias("form"))).alias("__forms"))
    rows = cells.join(forms, surface(F.col("lemma")) == F.col("__lemma"), "left").withColumn("__forms", F.coalesce("__forms", F.array().cast("array<struct<tense:string,slot:string,form:string>>")))
    tense, slot, gold = F.col("tense"), F.col("slot"), surface(F.col("expected"))
    if mode in ("full", "forms_only"):
        own = F.filter("__forms", lambda f: (tense == "participle") | (f["tense"] == tense))
        banned = F.concat(F.transform(own, lambda f: f["form"]), F.array(surface(F.col("lemma"))))
    elif mode == "pronouns_only":
        banned = F.array().cast("array<string>")
    else:
        own = F.filter("__forms", lambda f: (f["tense"] == tense) & (f["slot"] != slot) & (f["slot"].isin(*THIN) if mode == "thin" else F.lit(True)))
        banned = F.transform(own, lambda f: f["form"])
    pronouns = F.array().cast("array<string>") if mode == "forms_only" else F.when(tense == "participle", F.array().cast("array<string>")).otherwise(_pronouns(slot))
    return rows.select(*cells.columns, F.array_sort(F.array_distinct(F.filter(banned, lambda f: f != gold))).alias("forms"), F.array_sort(pronouns).alias("pronouns"))


def hits(text: Column, banned: Column) -> Column:
    """The banned surfaces among the words of the text, sorted."""
    return F.array_sort(F.array_intersect(F.transform(F.regexp_extract_all(text, F.lit(_WORD), 1), surface), banned))


def audit(sets: DataFrame) -> DataFrame:
    """(surface, cells, ambiguous): in how many cells each form is banned, and whether it's the gold form of another."""
    gold = sets.select(surface(F.col("expected")).alias("surface")).distinct().withColumn("ambiguous", F.lit(True))
    counts = sets.select(F.explode("forms").alias("surface")).groupBy("surface").agg(F.count("*").alias("cells"))
    return counts.join(gold, "surface", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def main_verb(text: Column, form: Column) -> Column:
    """Whether the form stands unquoted as a word and isn't only mentioned; a subject before it is strong evidence."""
    bare = F.trim(form)
    words = F.transform(F.regexp_extract_all(F.regexp_replace(text, _QUOTED, " "), F.lit("(?U)([^\\W\\d_]+)"), 1), surface)
    quoted = lambda pattern: F.rlike(text, F.concat(F.lit(pattern), bare, F.lit("\\E\\b")))
    there = F.coalesce(F.array_contains(words, surface(bare)), F.lit(False))
    return F.when(~there | F.coalesce(bare == "", F.lit(True)), False).when(quoted(_MENTION), False).when(quoted(_SUBJECT), True).otherwise(~quoted(_LIGHT))
