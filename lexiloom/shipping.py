"""Makes this package importable on the executors, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_BATCH, _SPARKS_OWN, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", 4 << 20


def ensure_on_workers(spark: SparkSession) -> SparkSession:
    """Ships the package's sources with Spark's own file distribution, once for each application.

    Arrow batches are bounded to 4 MB where the session leaves Spark's own bound: an executor holds several for each task, in
    the JVM and in Python, and whole texts are wide.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH, None) == _SPARKS_OWN:
        spark.conf.set(_BATCH, _BATCH_BYTES)
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        handle, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
        os.close(handle)
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return spark
