"""Sending this package to the executors, whose Python workers import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each Spark context; the archive is read by the driver, which hands it to the executors."""
    sc = spark.sparkContext
    if getattr(sc, "_tagwise_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="tagwise-"), "tagwise.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    sc._tagwise_shipped = True
