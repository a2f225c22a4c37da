"""Reproducible samples, quotas and rankings. Order is by a hash of the seed and the key, which every engine can repeat."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed


def hash_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys]))


def per_cell(rows: DataFrame, n: int | Column, seed: int, key: str, *cell: str) -> DataFrame:
    """The first n rows of each cell in hash order."""
    place = Window.partitionBy(*cell).orderBy(hash_order(seed, key), key)
    return rows.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= n)


def best_per_cell(rows: DataFrame, cell: list[str], scores: list[Column], seq: str) -> DataFrame:
    """The row with the highest score tuple of each cell; the first by ``seq`` on ties. The highest is kept before any exchange."""
    negative = [(-s).alias(f"s{i}") for i, s in enumerate(scores)]
    best = rows.groupBy(*cell).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in cell]), F.struct(*negative, F.col(seq))).alias("best"))
    return best.select(*cell, "best.*")


def balanced(rows: DataFrame, n: int, groups: int, seed: int, key: str, cell: list[str], group: str) -> DataFrame:
    """n of each cell: n div ``groups`` of each group, and the rest by hash order from what is left."""
    own = Window.partitionBy(*cell, group).orderBy(hash_order(seed, key), key)
    ranked = rows.withColumn("own", F.row_number().over(own))
    place = Window.partitionBy(*cell).orderBy((F.col("own") > n // groups).cast("int"), hash_order(seed, key), key)
    return ranked.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= n)


def round_robin(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first of each group, then the second of each, and so on, k in all."""
    own = rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return own.orderBy("turn", group).limit(k)


def terciles(rows: DataFrame, order: list[Column], *cell: str) -> DataFrame:
    """Equal-count thirds by rank: rank <= n div 3, then <= 2n div 3, then the rest.

    Ranks of a whole table come from a range-sorted count per partition, so no task sees all rows.
    """
    ranked = global_rank(rows, order) if not cell else rows.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy(*order))).withColumn("n", F.count("*").over(Window.partitionBy(*cell)))
    third = F.when(F.col("rank") <= F.floor(F.col("n") / 3), "low").when(F.col("rank") <= F.floor(2 * F.col("n") / 3), "mid").otherwise("high")
    return ranked.withColumn("tercile", third)


def global_rank(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rank (1..n over the whole table) and n, without a window over one partition: sorted ranges are counted, then offset."""
    ordered = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = ordered.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # one row for each partition: a window over them is small at any size
    starts = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("n"))
    return ordered.withColumn("__part", part).join(F.broadcast(starts), "__part").withColumn("rank", F.col("__start") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__part", "__id", "__start")


def largest_remainder(rows: DataFrame, n: int, *strata: str) -> DataFrame:
    """(strata, n, quota): proportional quotas that sum to n (or to all rows, if fewer). The strata are few: their table is small."""
    counts = rows.groupBy(*strata).agg(F.count("*").alias("size"))
    every = Window.partitionBy()
    share = counts.withColumn("exact", F.least(F.lit(n), F.sum("size").over(every)) * F.col("size") / F.sum("size").over(every)).withColumn("base", F.floor("exact"))
    left = share.withColumn("left", F.least(F.lit(n), F.sum("size").over(every)) - F.sum("base").over(every))
    place = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), *strata))
    return left.withColumn("quota", (F.col("base") + (place <= F.col("left")).cast("long"))).select(*strata, "size", "quota")


def by_quota(rows: DataFrame, quotas: DataFrame, seed: int, key: str, *strata: str) -> DataFrame:
    place = Window.partitionBy(*strata).orderBy(hash_order(seed, key), key)
    return rows.join(F.broadcast(quotas.select(*strata, "quota")), list(strata)).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= F.col("quota"))


def capped_quotas(strata: DataFrame, n: int, key: str) -> DataFrame:
    """(key, quota): n dealt over strata (key, size, room), a row for each stratum.

    First the whole part of each one's share by size, within its room (and size); what is left goes round one by one, the
    largest remainder first, past those that are full. Whole rounds are counted, not walked: strata sorted by their spare room tell
    how many rounds the rest lasts. An error where the rooms, or the strata, hold fewer than n. The strata are few: their table
    is small, so ranks and sums over all of them are one task.
    """
    every, place = Window.partitionBy(), Window.orderBy("spare", key)
    rows = strata.withColumn("room", F.least("size", F.coalesce("room", F.lit(0))))
    rows = rows.withColumn("share", F.lit(n) * F.col("size") / F.sum("size").over(every)).withColumn("base", F.least("room", F.floor("share")))
    rows = rows.withColumns({"spare": F.col("room") - F.col("base"), "rest": F.lit(n) - F.sum("base").over(every), "m": F.count("*").over(every)})
    rows = rows.withColumn("i", F.row_number().over(place)).withColumn("taken", F.sum("spare").over(place.rowsBetween(Window.unboundedPreceding, 0)) + (F.col("m") - F.col("i")) * F.col("spare"))
    last = F.max(F.when(F.col("taken") <= F.col("rest"), F.struct("i", "spare", "taken"))).over(every)
    rows = rows.withColumn("full", F.coalesce(last, F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("spare"), F.lit(0).cast("long").alias("taken"))))
    more = F.floor((F.col("rest") - F.col("full.taken")) / F.greatest(F.col("m") - F.col("full.i"), F.lit(1)))
    rows = rows.withColumn("rounds", F.col("full.spare") + F.when(F.col("m") > F.col("full.i"), more).otherwise(0))
    rows = rows.withColumn("given", F.least("spare", "rounds")).withColumn("odd", F.col("rest") - F.sum("given").over(every))
    turn = F.row_number().over(Window.orderBy(F.col("spare") <= F.col("rounds"), F.col("base") - F.col("share"), key))
    quota = F.col("base") + F.col("given") + ((F.col("spare") > F.col("rounds")) & (turn <= F.col("odd"))).cast("long")
    enough = F.when(F.sum("room").over(every) >= n, quota).otherwise(F.raise_error(F.format_string(f"capacity for %s of {n}", F.sum("room").over(every))))
    return rows.select(key, enough.cast("long").alias("quota"))


def oversample(rows: DataFrame, tagged: Column, factor: int) -> DataFrame:
    """Tagged rows ``factor`` times, the others once."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(tagged, factor).otherwise(1))))


def train_val(rows: DataFrame, share: float, seed: int, key: str, *strata: str) -> DataFrame:
    """split = val for max(1, floor(n * share)) rows of each stratum in hash order, else train."""
    place = Window.partitionBy(*strata).orderBy(hash_order(seed, key), key)
    n_val = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(*strata)) * share))
    return rows.withColumn("split", F.when(F.row_number().over(place) <= n_val, "val").otherwise("train"))


def match_quotas(rows: DataFrame, reference: DataFrame, seed: int, key: str, cell: list[str], tier: str) -> DataFrame:
    """As many rows of each cell as the reference has, and within a cell in proportion to its tiers (largest remainder).

    A cell with fewer rows than asked for gives all of them.
    """
    wanted = reference.groupBy(*cell).agg(F.count("*").alias("want"))
    sizes = rows.groupBy(*cell, tier).agg(F.count("*").alias("size")).join(wanted, cell)
    own = Window.partitionBy(*cell)
    n = F.least(F.col("want"), F.sum("size").over(own))
    exact = sizes.withColumn("n", n).withColumn("exact", F.col("n") * F.col("size") / F.sum("size").over(own)).withColumn("base", F.floor("exact"))
    place = F.row_number().over(own.orderBy(F.desc(F.round(F.col("exact") - F.col("base"), 9)), tier))
    quotas = exact.withColumn("left", F.col("n") - F.sum("base").over(own)).withColumn("quota", F.col("base") + (place <= F.col("left")).cast("long"))
    ranked = rows.join(quotas.select(*cell, tier, "quota"), [*cell, tier]).withColumn("rank", F.row_number().over(Window.partitionBy(*cell, tier).orderBy(hash_order(seed, key), key)))
    return ranked.filter(F.col("rank") <= F.col("quota"))


def diverse(rows: DataFrame, k: int, group: str, score: str, key: str, *cell: str) -> DataFrame:
    """k rows of each cell in turns over its groups, each by score; the group with the best score comes first in each turn."""
    own = Window.partitionBy(*cell, group)
    ranked = rows.withColumns({"turn": F.row_number().over(own.orderBy(F.desc(score), key)), "best": F.max(score).over(own)})
    place = Window.partitionBy(*cell).orderBy("turn", F.desc("best"), group)
    return ranked.filter(F.col("turn") <= k).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).drop("best")


def head_then_rounds(rows: DataFrame, head: int, n: int, score: str, group: str, key: str, *cell: str) -> DataFrame:
    """n rows of each cell: the ``head`` best by score, then one of each group in turns from the rest."""
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*cell).orderBy(F.desc(score), key)))
    in_head = F.col("place") <= head
    turn = F.row_number().over(Window.partitionBy(*cell, group, in_head).orderBy(F.desc(score), key))
    ranked = first.withColumn("turn", F.when(in_head, 0).otherwise(turn))
    order = Window.partitionBy(*cell).orderBy("turn", F.when(in_head, F.col("place")).otherwise(0), group, key)
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def distractors(questions: DataFrame, pool: DataFrame, seed: int, n: int = 3) -> DataFrame:
    """(id, distractor, rank): n other items of the pool for each question, of its own tag if that has n, else of any.

    Rows are (id, word, tag). Items are ranked by hash within their tag and over all; the first n + 1 of each tag and of the
    pool are enough, as a question leaves out its own word only, which is one item: the pool has a word once.
    """
    place = lambda *cell: F.row_number().over(Window.partitionBy(*cell).orderBy(hash_order(seed, "id"), "id"))
    few = pool.withColumns({"own": place("tag"), "size": F.count("*").over(Window.partitionBy("tag"))}).filter(F.col("own") <= n + 1).select("tag", F.col("id").alias("distractor"), F.col("word").alias("other"), "own", "size")
    # at most n + 1 rows: a limit by hash order, merged from the tasks' own
    everyone = pool.orderBy(hash_order(seed, "id"), "id").limit(n + 1).select(F.col("id").alias("distractor"), F.col("word").alias("other"), hash_order(seed, "id").alias("h"))
    near = questions.join(few, "tag").filter("distractor <> id and lower(other) <> lower(word)").withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("own"))).filter(F.col("rank") <= n)
    full = near.groupBy("id").agg(F.count("*").alias("have")).filter(F.col("have") >= n).select("id")
    far = questions.join(full, "id", "left_anti").join(F.broadcast(everyone)).filter("distractor <> id and lower(other) <> lower(word)")
    far = far.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy("h", "distractor"))).filter(F.col("rank") <= n)
    columns = ["id", "distractor", "rank"]
    return near.join(full, "id").select(*columns).union(far.select(*columns))


def rank_within(rows: DataFrame, cell: str, order: list[Column], name: str = "rank") -> DataFrame:
    """The place of each row in its cell, from the ranks of the whole table, so that a large cell isn't one task's."""
    ranked = global_rank(rows, [F.asc(cell), *order]).drop("n")
    first = ranked.groupBy(F.col(cell).alias("__cell")).agg(F.min("rank").alias("__first"))
    joined = ranked.join(first, F.col(cell).eqNullSafe(F.col("__cell")))
    return joined.withColumn("__place", (F.col("rank") - F.col("__first") + 1).cast("long")).drop("rank", "__cell", "__first").withColumnRenamed("__place", name)


def sample_where(rows: DataFrame, k: int, seed: int, key: str, predicates: dict[str, Column]) -> DataFrame:
    """k rows in hash order of those that fit, for each predicate; a row may be picked for several."""
    one = lambda name, fits: rows.filter(fits).orderBy(hash_order(seed, key), key).limit(k).withColumn("predicate", F.lit(name))
    return reduce(DataFrame.unionByName, [one(name, fits) for name, fits in predicates.items()])


def fixed_pair(rows: DataFrame, k: int, kind: str, pair: tuple[str, str], group: str, order: str) -> DataFrame:
    """k rows: the first of each of the two kinds by ``order``, then the groups' first rows, their second ones, and so on."""
    first = rows.filter(F.col(kind).isin(*pair)).groupBy(F.col(kind).alias("__kind")).agg(F.min(order).alias("__first"))
    turned = rows.withColumn("__turn", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    marked = turned.join(first, (F.col(kind) == F.col("__kind")) & (F.col(order) == F.col("__first")), "left")
    place = F.when(F.col("__kind") == pair[0], 0).when(F.col("__kind") == pair[1], 1).otherwise(2)
    return marked.orderBy(place, "__turn", group).limit(k).drop("__turn", "__kind", "__first")
