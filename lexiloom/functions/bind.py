"""Expressions that are evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it.

    Inside lambdas Spark evaluates an expression wherever it stands, for every element; a lambda's argument is a value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
