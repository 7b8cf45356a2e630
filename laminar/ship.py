"""Sends this package to the executors, so that no machine needs it installed."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's Python files, once an application. The driver serves it to executors."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="laminar-")) / "laminar.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, Path(root.name) / file.relative_to(root))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)


def shipped(f):
    """f(spark, ...) with the package sent first."""

    @functools.wraps(f)
    def run(spark, *args, **named):
        ship(spark)
        return f(spark, *args, **named)

    return run
