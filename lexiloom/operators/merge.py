"""Merges, upserts, resumption and archiving as set operations on natural keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equal keys, nulls equal to nulls."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def new_rows(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows whose key the target doesn't have."""
    have = target.select(*[F.col(k).alias(f"__{k}") for k in keys])
    return source.join(have, reduce(lambda a, b: a & b, [source[k].eqNullSafe(have[f"__{k}"]) for k in keys]), "left_anti")


def insert_absent(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The target and the source rows that it lacks; rows of the target are never refreshed."""
    return target.unionByName(new_rows(source, target, keys).select(*target.columns))


def upsert(source: DataFrame, target: DataFrame, keys: list[str], synced: list[str]) -> DataFrame:
    """One row for each key; ``synced`` columns come from the source where it has a value, the rest from the target first."""
    s, t = source.alias("s"), target.alias("t")
    joined = s.join(t, [F.col(f"s.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys], "full")
    new = lambda c: F.coalesce(F.col(f"s.{c}"), F.col(f"t.{c}"))
    old = lambda c: F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}"))
    return joined.select(*[(new(c) if c in synced else old(c)).alias(c) for c in target.columns])


def remap(rows: DataFrame, source_dim: DataFrame, target_dim: DataFrame, fk: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``fk`` changed to the target's id of the same natural key, and the source keys without one (an error if any)."""
    pairs = source_dim.select(F.col("id").alias("__old"), *keys).join(target_dim.select(F.col("id").alias("__new"), *[F.col(k).alias(f"__{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left")
    found = rows.join(pairs.select("__old", "__new").filter("__new is not null"), F.col(fk) == F.col("__old")).withColumn(fk, F.col("__new")).drop("__old", "__new")
    return found, pairs.filter("__new is null").select(*keys)


def recompute(target: DataFrame, fresh: DataFrame, replaced: Column) -> DataFrame:
    """Delete, then insert: what doesn't match ``replaced``, and the fresh rows."""
    return target.filter(~F.coalesce(replaced, F.lit(False))).unionByName(fresh)


def to_score(items: DataFrame, done: DataFrame, key: str, failed: Column) -> DataFrame:
    """Items without a row that succeeded."""
    return items.join(done.filter(~F.coalesce(failed, F.lit(False))).select(key), key, "left_anti")


def work_queue(cells: DataFrame, rows: DataFrame, key: str, needed: int) -> DataFrame:
    """(key, have, missing) of cells with fewer rows than needed."""
    counts = rows.groupBy(key).agg(F.count("*").alias("have"))
    return cells.join(counts, key, "left").select(key, F.coalesce("have", F.lit(0)).alias("have")).filter(F.col("have") < needed).withColumn("missing", needed - F.col("have"))


def archive_replace(live: DataFrame, fresh: DataFrame, keys: list[str], name: str, version: str, current: str) -> DataFrame:
    """Rows of an old version move to ``<name>_superseded`` (unless archived before); fresh rows take their place; current ones stay."""
    stale = (F.col("evaluator") == name) & (F.coalesce(F.col(version), F.lit("")) != current)
    old = live.filter(stale)
    archived = new_rows(old.withColumn("evaluator", F.lit(f"{name}_superseded")), live, [*keys, "evaluator"])
    ready = fresh.join(old.select(*keys), keys, "left_semi")
    return live.filter(~F.coalesce(stale, F.lit(False))).unionByName(archived).unionByName(ready.select(*live.columns))


def canonical(rows: DataFrame, sense: list[Column], id_: str = "id") -> DataFrame:
    """(id, canonical): the least id with the same sense key."""
    keyed = rows.select(F.col(id_), F.xxhash64(*sense).alias("__h"), *[s.alias(f"__k{i}") for i, s in enumerate(sense)])
    names = ["__h", *[f"__k{i}" for i in range(len(sense))]]
    least = keyed.groupBy(*names).agg(F.min(id_).alias("canonical"))
    other = least.select("canonical", *[F.col(n).alias(f"{n}_") for n in names])
    return keyed.join(other, [F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]).select(id_, "canonical")


def repoint(links: DataFrame, canon: DataFrame, owner: str, fk: str) -> DataFrame:
    """Links moved to canonical ids; of several links of one owner to one canonical the least link id stays."""
    moved = links.join(canon.withColumnRenamed("id", "__id"), F.col(fk) == F.col("__id"), "left").withColumn(fk, F.coalesce("canonical", fk)).drop("__id", "canonical")
    return moved.groupBy(owner, fk).agg(F.min("id").alias("id"), F.count("*").alias("merged"))


def first_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key: order-preserving dedupe."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def cascade(children: DataFrame, fk: str, deleted: DataFrame, id_: str = "id") -> DataFrame:
    """Children whose parent wasn't deleted."""
    return children.join(deleted.select(F.col(id_).alias(fk)), fk, "left_anti")


def merge_runs(source: dict[str, DataFrame], target: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The target's experiments, sentences, evaluations and metrics after a merge of the source's, and its counts.

    Tables name their rows by natural keys: experiments by name; sentences by (experiment, cell, sample_index); evaluations by
    that and the evaluator; metrics by (experiment, metric_name, scope, cell), nulls equal to nulls. Rows of the target are
    never refreshed, but an experiment takes the source's status and completed_at. Experiments without a benchmark or a method
    are skipped with all their rows. Merging again adds nothing. (merged, skipped, sentences, evaluations and metrics added)
    """
    known = source["experiments"].filter("benchmark is not null and method is not null")
    out = {"experiments": upsert(known, target["experiments"], ["name"], ["status", "completed_at"])}
    keys = {"sentences": ["experiment", "cell", "sample_index"], "evaluations": ["experiment", "cell", "sample_index", "evaluator"], "metrics": ["experiment", "metric_name", "scope", "cell"]}
    names = known.select(F.col("name").alias("experiment"))
    counts = known.agg(F.count("*").alias("merged")).join(source["experiments"].agg(F.count_if(F.col("benchmark").isNull() | F.col("method").isNull()).alias("skipped")))
    for table, own in keys.items():
        fresh = new_rows(source[table].join(names, "experiment", "left_semi"), target[table], own)
        out[table] = target[table].unionByName(fresh.select(*target[table].columns))
        counts = counts.join(fresh.agg(F.count("*").alias(f"{table}_added")))
    return out, counts
