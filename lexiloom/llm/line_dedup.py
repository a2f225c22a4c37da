"""Removal of lines that many sites share.

Method: distinct-site spread. A HyperLogLog sketch of the sites for each line hash, made straight from the lines, merges by
aggregation; lines whose estimate is near the threshold, and only these, get an exact distinct count. All of it is DataFrame
operations; a line that a third of all texts have is one partial sketch for each task before any exchange.

A line is told by a 64-bit hash. Only a line that has the hash of a shared one can be taken for it: with 10**11 different lines
and a million shared ones that is expected for 0.005 lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_tools import checkpointed, fresh, join_spread

MIN_SITES = 10
LOG_K = 12
#: Estimates this share off the threshold or less are counted exactly; five standard errors of a sketch of 2**LOG_K cells are 0.08.
MARGIN = 0.25


def _hashes(text: Column, most: int | None) -> Column:
    """A hash for each line: of the line trimmed; null for blank lines and lines of more than ``most`` characters, if that is given."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    return F.transform(lines, lambda x: F.when((x != "") if most is None else (x != "") & (F.length(x) <= most), F.xxhash64(x)))


def shared_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line): the hashes that ``min_sites`` different sites or more have, of rows (line, site)."""
    sketch = lines.groupBy("line").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"))
    spread = sketch.withColumn("sites", F.hll_sketch_estimate("sketch")).filter(F.col("sites") >= min_sites * (1 - MARGIN))
    spread = checkpointed(spread.select("line", "sites"))
    near = spread.filter(F.col("sites") <= min_sites * (1 + MARGIN)).select("line")
    pairs = join_spread(lines.dropna(), near, ["line"]).groupBy("line", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    sure = spread.filter(F.col("sites") > min_sites * (1 + MARGIN))
    return sure.select("line").union(exact.select("line"))


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, max_chars: int | None = None, site: str = "source") -> DataFrame:
    """The documents without boilerplate lines, and n_lines and n_removed.

    Lines are what "\\n" separates; they are compared without spaces, tabs and carriage returns at their ends. A line that
    ``min_sites`` different sites or more have goes from every text (if ``max_chars`` is given, only a line of so many
    characters at most), but not from a text that has no other lines: that is a copy, and a matter of whole documents. Blank
    lines stay. Rows with a null site remain and lose lines, but count for no site. Null texts stay null (0 lines). A null or
    repeated doc_id does no harm: lines go by what the row holds, and equal rows are treated alike. An empty table gives no
    rows. Other columns are passed on; an own n_lines or n_removed of the input is replaced.
    """
    found, p = _found(docs, min_sites, max_chars, site)
    own = {c: F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed")} | {"text": F.col(f"{p}text"), "n_lines": F.col(f"{p}n_lines"), "n_removed": F.col(f"{p}n_removed")}
    return found.select(*[v.alias(c) for c, v in own.items()])


def without_lines(docs: DataFrame, min_sites: int = MIN_SITES, max_chars: int | None = None, site: str = "source", chars: str = "n_chars") -> DataFrame:
    """The documents without boilerplate lines, as ``line_dedup``; of the columns only the text and, where lines went, its length ``chars`` change."""
    found, p = _found(docs, min_sites, max_chars, site)
    size = F.when(F.col(f"{p}n_removed") > 0, F.length(f"{p}text").cast("long")).otherwise(F.col(chars))
    return found.select(*[(F.col(f"{p}text") if c == "text" else size if c == chars else F.col(c)).alias(c) for c in docs.columns])


def _found(docs: DataFrame, min_sites: int, max_chars: int | None, site: str) -> tuple[DataFrame, str]:
    """docs with the new text, n_lines and n_removed, and what these names begin with; docs has no such names."""
    p = fresh(docs)
    a, b, gone, kept_ = (f"{p}{name}" for name in ("a", "b", "gone", "kept"))
    base = docs.withColumns({a: F.xxhash64("doc_id", "text"), b: F.xxhash64(F.lit(1), "doc_id", "text")})
    own = F.explode(F.array_distinct(_hashes(F.col("text"), max_chars))).alias("line")
    lines = checkpointed(base.select(F.col(site).cast("string").alias("site"), a, b, own).filter("line is not null"))
    shared = checkpointed(shared_lines(lines.select("line", "site"), min_sites))
    marks = join_spread(lines.select("line", a, b), shared, ["line"]).groupBy(a, b).agg(F.collect_set("line").alias(gone))
    joined = base.join(marks, [a, b], "left")
    split = F.split("text", "\n")
    kept = F.transform(
        F.filter(F.arrays_zip(split.alias("s"), _hashes(F.col("text"), max_chars).alias("h")), lambda x: x["h"].isNull() | ~F.array_contains(gone, x["h"])),
        lambda x: x["s"],
    )
    joined = joined.withColumn(kept_, F.when(F.col(gone).isNotNull(), kept))
    left = F.exists(kept_, lambda x: F.trim(x, F.lit(" \t\r")) != "")
    text = F.when(F.col(gone).isNull() | ~left, F.col("text")).otherwise(F.array_join(kept_, "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")
    removed = F.when(F.col(gone).isNull() | ~left, 0).otherwise(F.size(split) - F.size(kept_)).cast("long")
    return joined.select(*docs.columns, text.alias(f"{p}text"), n_lines.alias(f"{p}n_lines"), removed.alias(f"{p}n_removed")), p
