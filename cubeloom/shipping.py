"""Sends this package to the Python workers, which may run where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the application's files, once."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="cubeloom-")) / "cubeloom.zip"
    with zipfile.ZipFile(path, "w") as bundle:
        for source in sorted(top.rglob("*.py")):
            bundle.write(source, source.relative_to(top.parent))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)


def shipped(function: Callable) -> Callable:
    """A function of (spark, ...) that ships the package first."""

    @wraps(function)
    def run(spark: SparkSession, *arguments):
        ship(spark)
        return function(spark, *arguments)

    return run
