"""Giving executors the package, wherever the driver found it."""

from __future__ import annotations

import functools
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


@functools.cache
def _archive() -> str:
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="spark-quorate-code-")
    staged = Path(folder) / "staged" / root.name
    shutil.copytree(root, staged, ignore=shutil.ignore_patterns("__pycache__"))
    return shutil.make_archive(str(Path(folder) / root.name), "zip", staged.parent)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of the session, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        spark.sparkContext.addPyFile(_archive())
        _SHIPPED.add(app)
