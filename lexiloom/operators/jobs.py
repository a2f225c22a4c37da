"""Queued enrichment jobs: what becomes of them, of their lexemes and of the vocabulary that points there, as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .lexemes import SENSE, clean_tags, needs_enrichment

#: The confidence of a job that another lexeme's entry has answered.
CACHED = 1.0


def _applied(rows: DataFrame) -> dict[str, Column]:
    """A lexeme's fields with those that the result (columns r_*) has a value for."""
    lemma, gloss = T.key(F.col("r_lemma")), T.key(F.col("r_gloss_primary"))
    return {
        "lemma": F.when(F.col("r_lemma") != "", F.when(lemma != "", lemma).otherwise(F.trim("r_lemma"))).otherwise(F.col("lemma")),
        "pos": F.when(F.col("r_pos") != "", F.col("r_pos")).otherwise(F.col("pos")),
        "tags": F.when(F.size("r_tags") > 0, clean_tags(F.col("r_tags"))).otherwise(F.col("tags")),
        "gloss_primary": F.when(F.col("r_gloss_primary") != "", gloss).otherwise(F.col("gloss_primary")),
    }


def outcomes(jobs: DataFrame, lexemes: DataFrame, results: DataFrame) -> DataFrame:
    """What the pending jobs do to each lexeme that they name: (lexeme_id, job_id, outcome, target, confidence, and its fields).

    outcome is, in this order: ``failed`` (no such lexeme), ``none`` (needs nothing), ``cache`` (it's pending, and an enriched
    lexeme has its sense), ``waiting`` (no result came, or one with an error), ``dedupe`` (with the result it has the sense of
    another one) or ``enriched``. target is the lexeme that takes it over: the least id of those with the sense that this batch
    leaves as they are, else the one of the batch with the least job. results: (lexeme_id, lemma, pos, tags, gloss_primary,
    confidence, error). Null senses equal no others. The first of a lexeme's jobs leads.
    """
    lead = jobs.filter("status = 'pending' and lexeme_id is not null").groupBy("lexeme_id").agg(F.min("id").alias("job_id"))
    own = lexemes.select(F.col("id").alias("lexeme_id"), *SENSE, "tags", "enrichment_status", F.lit(True).alias("found"))
    given = results.filter("error is null").groupBy("lexeme_id").agg(*[F.max_by(c, F.xxhash64("lemma", "pos", "tags", "gloss_primary", "confidence")).alias(f"r_{c}") for c in ("lemma", "pos", "tags", "gloss_primary", "confidence")]).withColumn("has", F.lit(True))
    enriched = lexemes.filter("enrichment_status = 'enriched'").groupBy(*SENSE).agg(F.min("id").alias("cached"))
    rows = lead.join(own, "lexeme_id", "left").join(given, "lexeme_id", "left").join(enriched, SENSE, "left")
    first = (
        F.when(F.col("found").isNull(), "failed").when(~needs_enrichment(F.col("enrichment_status")), "none")
        .when((F.col("enrichment_status") == "pending") & F.col("cached").isNotNull(), "cache").when(F.col("has").isNull(), "waiting").otherwise("apply")
    )
    rows = rows.withColumn("outcome", first)
    changed = {c: F.when(F.col("outcome") == "apply", v).otherwise(F.col(c)) for c, v in _applied(rows).items()}
    rows = rows.select("lexeme_id", "job_id", "outcome", "cached", "language", *[v.alias(c) for c, v in changed.items()], F.col("r_confidence").alias("confidence"))

    moved = rows.filter("outcome in ('apply', 'cache')").select(F.col("lexeme_id").alias("id"))
    still = lexemes.join(moved, "id", "left_anti").groupBy(*SENSE).agg(F.min("id").alias("other"))
    best = rows.filter("outcome = 'apply'").groupBy(*SENSE).agg(F.min_by("lexeme_id", "job_id").alias("leader"))
    rows = rows.join(still, SENSE, "left").join(best, SENSE, "left")
    target = F.coalesce("other", F.when(F.col("leader") != F.col("lexeme_id"), F.col("leader")))
    last = F.when(F.col("outcome") == "apply", F.when(target.isNotNull(), "dedupe").otherwise("enriched")).otherwise(F.col("outcome"))
    return rows.select(
        "lexeme_id", "job_id", last.alias("outcome"), F.when(F.col("outcome") == "cache", F.col("cached")).when(F.col("outcome") == "apply", target).alias("target"),
        F.when(F.col("outcome") == "cache", F.lit(CACHED)).when(F.col("outcome") == "apply", F.col("confidence")).alias("confidence"), *SENSE, "tags",
    )


def finished_jobs(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """The jobs after ``outcomes``: status, source (cache, dedupe or model), result_id and confidence; jobs that wait stay pending.

    Further jobs of a lexeme find that it needs nothing any more: they are done, without a source.
    """
    one = found.select("lexeme_id", "job_id", "outcome", "target", "confidence")
    rows = jobs.join(one, "lexeme_id", "left")
    mine, open_ = F.col("id") == F.col("job_id"), (F.col("status") == "pending") & F.col("outcome").isNotNull()
    status = F.when(open_ & (F.col("outcome") == "failed"), "failed").when(open_ & (F.col("outcome") != "waiting"), "done").otherwise(F.col("status"))
    source = F.when(open_ & mine, F.when(F.col("outcome").isin("cache", "dedupe"), F.col("outcome")).when(F.col("outcome") == "enriched", "model"))
    result = F.when(source.isin("cache", "dedupe"), F.col("target")).when(source == "model", F.col("lexeme_id"))
    return rows.select(*[status.alias(c) if c == "status" else rows[c] for c in jobs.columns], source.alias("source"), result.alias("result_id"), F.when(source.isNotNull(), F.col("confidence")).alias("confidence"))


def updated_lexemes(lexemes: DataFrame, found: DataFrame) -> DataFrame:
    """The lexemes after ``outcomes``: taken-over ones are gone, those with a result of their own are enriched."""
    names = [*SENSE, "tags"]
    one = found.filter("outcome in ('enriched', 'cache', 'dedupe')").select(F.col("lexeme_id").alias("id"), "outcome", *[F.col(c).alias(f"r_{c}") for c in names])
    rows = lexemes.join(one, "id", "left").filter("outcome is null or outcome = 'enriched'")
    new = {c: F.when(F.col("outcome").isNotNull(), F.col(f"r_{c}")).otherwise(F.col(c)) for c in names} | {"enrichment_status": F.when(F.col("outcome").isNotNull(), "enriched").otherwise(F.col("enrichment_status"))}
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in lexemes.columns])


def repointed_vocab(vocab: DataFrame, found: DataFrame) -> DataFrame:
    """The vocabulary after ``outcomes``: rows of a lexeme that was taken over point to the one that took it.

    A row goes if its workspace has that lexeme already; of several rows that come to one lexeme of a workspace the least id stays.
    """
    merges = found.filter("target is not null").select("lexeme_id", "target")
    rows = vocab.join(merges, "lexeme_id", "left")
    have = rows.filter("target is null and lexeme_id is not null").select("workspace_id", F.col("lexeme_id").alias("target")).distinct()
    fresh = rows.filter("target is not null").join(have, ["workspace_id", "target"], "left_anti")
    kept = fresh.groupBy("workspace_id", "target").agg(F.min_by(F.struct(*vocab.columns), "id").alias("row"))
    moved = kept.select(*[F.col("target").alias(c) if c == "lexeme_id" else F.col(f"row.{c}").alias(c) for c in vocab.columns])
    return rows.filter("target is null").select(*vocab.columns).unionByName(moved)
