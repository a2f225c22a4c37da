"""All queries of the engine's own operators."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiloom import plans

Query = Callable[[SparkSession, str], DataFrame]


def _modules():
    for found in sorted(pkgutil.iter_modules(plans.__path__), key=lambda m: m.name):
        if found.name.startswith("q_"):
            yield importlib.import_module(f"{plans.__name__}.{found.name}")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for module in _modules():
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _modules():
        out |= module.SQL
    return out
