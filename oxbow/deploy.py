"""Makes this package importable on the executors of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Hand the package's sources to every executor, once per Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_oxbow_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="oxbow-src-")  # the driver serves the file from here as long as it lives
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "oxbow-src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._oxbow_shipped = True
