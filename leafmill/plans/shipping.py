"""Make this package importable in the executors' Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package's sources to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    at, name = tempfile.mkstemp(prefix="leafmill_", suffix=".zip")
    os.close(at)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "leafmill").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def shipped(query):
    """``query`` with the package shipped before it runs."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
