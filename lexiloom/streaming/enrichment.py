"""Enrichment jobs as a stream: each micro-batch is claimed, processed against the tables as they were before it, and published."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..operators import jobs as J
from . import upsert

TABLES = ("lexemes", "vocab", "jobs")


def load(path: str, lexemes: DataFrame, vocab: DataFrame) -> None:
    """Makes the tables of a queue below ``path``; each row has a ``version``, the batch that wrote it."""
    for name, rows in (("lexemes", lexemes), ("vocab", vocab)):
        upsert.upsert(f"{path}/{name}", rows.withColumn("version", F.lit(-1).cast("long")), ["id"], "version")


def process_into(path: str, enrich: Callable[[DataFrame], DataFrame]):
    """A function for foreachBatch over jobs (id, lexeme_id, vocab_id, status).

    ``enrich`` gives results (lexeme_id, lemma, pos, tags, gloss_primary, confidence, error) for the lexemes that need one; it's
    asked for these only, and once for each batch. A job's id makes it one: a job that comes again, or that is done, isn't
    claimed. Jobs that wait (no result, or an error) are claimed again by the next batch. The three tables are published one
    after the other; a batch that failed between two of them, and any batch that runs again, is computed from the versions before
    it, so it gives the same, and tables that have it already stay as they are.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        source = upsert.batch_source(spark)
        old = {t: upsert.before(f"{path}/{t}", spark, source, number) for t in TABLES}
        fresh = batch.select("id", "lexeme_id", "vocab_id", "status").dropDuplicates(["id"])
        known = old["jobs"]
        if known is not None:
            fresh = fresh.join(known.select("id"), "id", "left_anti").unionByName(known.filter("status = 'pending'").select(*fresh.columns))
        fresh = checkpointed(fresh)
        lexemes, vocab = (old[t].drop("version") for t in ("lexemes", "vocab"))
        named = lexemes.join(fresh.filter("status = 'pending'").select(F.col("lexeme_id").alias("id")).distinct(), "id", "left_semi")
        # what needs no model isn't given to it: outcomes without results say so
        open_ = J.outcomes(fresh, lexemes, enrich(named.limit(0))).filter("outcome = 'waiting'").select(F.col("lexeme_id").alias("id"))
        results = checkpointed(enrich(named.join(open_, "id", "left_semi")))
        found = checkpointed(J.outcomes(fresh, lexemes, results))
        stamp = F.lit(number).cast("long").alias("version")
        after = {"lexemes": J.updated_lexemes(lexemes, found), "vocab": J.repointed_vocab(vocab, found)}
        for table, rows in after.items():
            changed = rows.exceptAll(old[table].drop("version"))
            gone = old[table].select("id").join(rows.select("id"), "id", "left_anti")
            upsert.upsert(f"{path}/{table}", changed.select("*", stamp), ["id"], "version", source, number, gone)
        upsert.upsert(f"{path}/jobs", J.finished_jobs(fresh, found).select("*", stamp), ["id"], "version", source, number)

    return write
