"""Shared dictionary entries: find or create by sense, backfill of vocabulary, occurrences, token candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .merge import first_by, new_rows

# Parts of speech, and the fields that an entry must have.
VALID_POS = ("noun", "verb", "adjective", "adverb", "preposition", "other")
REQUIRED = ("lemma", "pos", "tags", "gloss_primary")
SENSE = ["language", "lemma", "pos", "gloss_primary"]
OCCURRENCE = ["workspace_id", "vocab_id", "context_type", "context_id", "surface_token", "char_start"]


def coerced_pos(pos: Column, tags: Column) -> Column:
    """A valid part of speech, else the first valid tag, else ""."""
    first = F.get(F.filter(tags, lambda t: t.isin(*VALID_POS)), F.lit(0))
    return F.coalesce(F.when(pos.isin(*VALID_POS), pos), first, F.lit(""))


def clean_tags(tags: Column) -> Column:
    """Trimmed, case-folded, without blanks and repeats; the order stays."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: T.casefold(F.trim(t))), lambda t: t != ""))


def missing_fields(rows: DataFrame) -> Column:
    """The required fields that are null or empty, in a fixed order."""
    kinds = dict(rows.dtypes)
    blank = lambda c: F.coalesce(F.size(c) == 0 if kinds[c].startswith("array") else F.col(c) == "", F.lit(True))
    return F.array_compact(F.array(*[F.when(blank(c), c) for c in REQUIRED]))


def needs_enrichment(status: Column) -> Column:
    return F.coalesce(status.isin("pending", "complete"), F.lit(False))


def sensed(rows: DataFrame) -> DataFrame:
    """Rows with the sense key in its normal form."""
    lemma = T.key(F.col("lemma"))
    return rows.withColumns({"lemma": F.when(lemma != "", lemma).otherwise(F.trim("lemma")), "pos": coerced_pos(F.col("pos"), F.col("tags")), "gloss_primary": T.key(F.coalesce("gloss_primary", F.lit("")))})


def find_or_create(incoming: DataFrame, lexemes: DataFrame, order: str = "seq") -> DataFrame:
    """The lexemes after the incoming entries; new ones have a null id and the status pending.

    Entries go by language, lemma, pos and primary gloss. Values of an entry that aren't empty replace those of the lexeme, the
    last entry (by ``order``) wins; tags lose their repeats. Entries of one sense meet as one before they meet the lexemes.
    """
    more = [c for c in lexemes.columns if c not in (*SENSE, "id", "enrichment_status")]
    kinds = dict(lexemes.dtypes)
    given = lambda c: F.col(c).isNotNull() & ((F.size(c) > 0) if kinds[c].startswith("array") else (F.col(c) != "") if kinds[c] == "string" else F.lit(True))
    latest = sensed(incoming).groupBy(*SENSE).agg(*[F.max_by(F.col(c), F.when(given(c), F.col(order))).alias(f"__{c}") if c in incoming.columns else F.lit(None).alias(f"__{c}") for c in more])
    same = [lexemes[k].eqNullSafe(latest[k]) for k in SENSE]
    joined = lexemes.join(latest, same, "full")
    value = lambda c: F.coalesce(F.array_distinct(f"__{c}") if c == "tags" else F.col(f"__{c}"), lexemes[c])
    own = {k: F.coalesce(lexemes[k], latest[k]) for k in SENSE} | {c: value(c) for c in more} | {"id": lexemes["id"], "enrichment_status": F.coalesce(lexemes["enrichment_status"], F.lit("pending"))}
    return joined.select(*[own[c].alias(c) for c in lexemes.columns])


def backfill(vocab: DataFrame, lexemes: DataFrame) -> DataFrame:
    """Vocabulary linked to the lexeme of its sense; a null surface form becomes the word, another gloss an override.

    Rows that are linked already stay as they are; rows without a lexeme of their sense keep a null lexeme_id.
    """
    lex = lexemes.select(F.col("id").alias("__lexeme"), *[F.col(k).alias(f"__{k}") for k in SENSE])
    keyed = sensed(vocab.withColumns({"lemma": F.col("word"), "gloss_primary": F.col("translation")})).select("id", "language", "lemma", "pos", "gloss_primary")
    links = keyed.join(lex, [F.col(k) == F.col(f"__{k}") for k in SENSE]).groupBy("id").agg(F.min("__lexeme").alias("__lexeme"), F.max("__gloss_primary").alias("__gloss"))
    rows = vocab.join(links, "id", "left")
    linked = F.col("lexeme_id").isNull() & F.col("__lexeme").isNotNull()
    surface = F.coalesce(F.nullif("surface_form", F.lit("")), "word")
    override = F.when((F.col("translation") != "") & (F.col("translation") != F.col("__gloss")), F.col("translation"))
    return rows.select(
        *[c for c in vocab.columns if c not in ("lexeme_id", "surface_form")],
        F.when(linked, F.col("__lexeme")).otherwise(F.col("lexeme_id")).alias("lexeme_id"),
        F.when(linked, surface).otherwise(F.col("surface_form")).alias("surface_form"),
        F.when(linked, override).alias("gloss_override"),
    )


def insert_unique(incoming: DataFrame, rows: DataFrame, keys: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts): the first incoming row of each key that the table doesn't have, and all others."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    have = rows.select(*keys).distinct().withColumn("__have", F.lit(True))
    marked = incoming.withColumn("__r", place).join(have, keys, "left")
    ok = F.col("__have").isNull() & (F.col("__r") == 1)
    return marked.filter(ok).drop("__have", "__r"), marked.filter(~ok).drop("__have", "__r")


def add_occurrences(incoming: DataFrame, occurrences: DataFrame, order: str = "id") -> DataFrame:
    """Occurrences with the incoming ones that are new by six columns, nulls equal to nulls; of equal ones the first stays."""
    return occurrences.unionByName(new_rows(first_by(incoming, OCCURRENCE, [F.col(order)]), occurrences, OCCURRENCE).select(*occurrences.columns))


def resolved_spans(texts: DataFrame, vocab: DataFrame, id_: str = "text_id") -> DataFrame:
    """(id, token, start, end, normalized, vocab_id, candidates, confidence) of every word of the texts.

    A vocabulary item (id, forms) is a candidate if one of its forms is the normalised token. One candidate: confidence 1.0 and
    its id; several: 0.5; none: 0.0. Forms are counted once for each token before tokens join them.
    """
    tokens = texts.select(id_, F.explode(T.spans(F.col("text"))).alias("s")).filter("s.word").select(id_, "s.token", "s.start", "s.end", T.key(F.col("s.token")).alias("normalized"))
    forms = vocab.select("id", F.explode(F.array_distinct(F.transform("forms", T.key))).alias("normalized"))
    owners = forms.groupBy("normalized").agg(F.array_sort(F.collect_set("id")).alias("candidates"))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    joined = tokens.join(owners, "normalized", "left")
    return joined.select(
        id_, "token", "start", "end", "normalized", F.when(F.size("candidates") == 1, F.col("candidates")[0]).alias("vocab_id"),
        F.coalesce("candidates", F.array().cast("array<bigint>")).alias("candidates"), F.when(F.size("candidates") == 1, 1.0).when(n > 1, 0.5).otherwise(0.0).alias("confidence"),
    )


def enqueue(lexemes: DataFrame, jobs: DataFrame) -> DataFrame:
    """New enrichment jobs (lexeme_id, status, requested_fields): of lexemes that need one and have none pending."""
    waiting = jobs.filter("status = 'pending'").select(F.col("lexeme_id").alias("id"))
    open_ = lexemes.filter(needs_enrichment(F.col("enrichment_status"))).join(waiting, "id", "left_anti")
    return open_.select(F.col("id").alias("lexeme_id"), F.lit("pending").alias("status"), missing_fields(open_).alias("requested_fields"))
