"""Letting Python workers import this library from where the driver did."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def library_on_path(spark: SparkSession) -> None:
    """Adds the folder of the library to the workers' path. Where executors have no such folder the entry does
    nothing; ship the library with `--py-files` there."""
    settings = spark.sparkContext.environment
    known = settings.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        settings["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, known]))
