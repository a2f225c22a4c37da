"""Texts of prompts, built of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first line of a block of worked examples, and its end.
HEAD = "Study these worked examples of the task, then complete the final request below."
END = "---"


def demonstration_block(exemplars: Column) -> Column:
    """The worked examples, array<struct<verb, translation, label, sentence>>, as a labelled block; "" without any.

    A translation that doesn't begin with "to " gets it; an empty or null one stays as "()".
    """

    def one(e: Column, at: Column) -> Column:
        sense = F.coalesce(e["translation"], F.lit(""))
        to = F.when((sense != "") & ~sense.startswith("to "), F.concat(F.lit("to "), sense)).otherwise(sense)
        return F.concat(F.lit("Example "), (at + 1).cast("string"), F.lit(" — "), e["verb"], F.lit(" ("), to, F.lit("), "), e["label"], F.lit(":\n"), e["sentence"], F.lit("\n\n"))

    block = F.concat(F.lit(f"{HEAD}\n\n"), F.array_join(F.transform(exemplars, one), ""), F.lit(END))
    return F.when(F.size(exemplars) > 0, block).otherwise("")
