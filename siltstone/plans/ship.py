"""Bring the package to Python workers that could not import it from their own path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import siltstone


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's source as one zip to the session's Python files, once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_siltstone_shipped", False):
        return spark
    root = os.path.dirname(os.path.abspath(siltstone.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="siltstone-"), "siltstone_package.zip")  # the driver serves it from here
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.join("siltstone", os.path.relpath(at, root)))
    sc.addPyFile(target)
    sc._siltstone_shipped = True
    return spark
