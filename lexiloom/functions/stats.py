"""Statistics as Column expressions over counts and sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a share, within 0 and 1; null where n is 0 or less."""
    p = k / n
    wide = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / wide
    margin = z / wide * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), centre - margin)), F.when(ok, F.least(F.lit(1.0), centre + margin))


def agreement(tp: Column, tn: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall, F1, NPV, Cohen's kappa and MCC; null where undefined."""
    n = tp + tn + fp + fn
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    observed = ratio(tp + tn, n)
    product = ((tp + fp) * (tp + fn)).cast("double") * ((tn + fp) * (tn + fn)).cast("double")
    return {
        "accuracy": observed,
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "npv": ratio(tn, tn + fn),
        "kappa": ratio(observed - chance, 1 - chance),
        "mcc": F.when(product > 0, (tp * tn - fp * fn) / F.sqrt(product)),
    }
