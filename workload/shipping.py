"""Make the library importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the packages to the application once; Spark sends the archive to every executor."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    staging = tempfile.mkdtemp(prefix="bistrolytics-")
    for package in ("bistrolytics", "workload"):
        archive = shutil.make_archive(os.path.join(staging, package), "zip", _ROOT, package)
        spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
