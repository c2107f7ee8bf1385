"""Makes this package importable in the executors' Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Sends the package's modules to the executors, once per application.

    The archive is built on the driver and handed to Spark, which serves it to
    every executor (also to ones that join later)."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(root)
    path = os.path.join(tempfile.mkdtemp(prefix="stayline-code-"), f"stayline-{os.getpid()}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)
