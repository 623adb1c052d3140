"""Lets Python workers import this package where it is not installed on them."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="pathloom-ship-")
    sc.addPyFile(shutil.make_archive(f"{folder}/{here.name}", "zip", here.parent, here.name))
    _SHIPPED.add(sc.applicationId)
