"""Makes the package importable on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's sources to the executors once a context, by Spark's own file server."""
    context = spark.sparkContext
    if getattr(context, "_tickloom_shipped", False):
        return spark
    path = os.path.join(tempfile.mkdtemp(prefix="tickloom-"), "tickloom_sources.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "tickloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    context.addPyFile(path)
    context._tickloom_shipped = True
    return spark
