"""Make the package importable in the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all workers, once per application. Spark's own file service carries them, so the
    workers need no installation and no common folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(package)
    archive = os.path.join(tempfile.mkdtemp(prefix="inkprint-"), "inkprint.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                out.write(path, os.path.relpath(path, top))
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)
