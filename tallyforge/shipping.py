"""This package on the executors, for functions that run in Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tallyforge_shipped", False):
        return
    root = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="tallyforge-"), "tallyforge.zip")
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(at)
    sc._tallyforge_shipped = True
