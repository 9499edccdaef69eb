"""Makes this package importable for Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package's sources once per application, through the driver's file server."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        where = os.path.join(tempfile.mkdtemp(prefix="gleaner-src-"), "gleaner_src.zip")
        with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, os.path.dirname(here)))
        context.addPyFile(where)
        _shipped.add(context.applicationId)
    return spark
