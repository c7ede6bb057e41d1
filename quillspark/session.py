"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where PYTHONPATH doesn't lead to it already."""
    package = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(package.parent) in map(os.path.realpath, os.environ.get("PYTHONPATH", "").split(":")):
        return
    top = os.path.realpath(tempfile.mkdtemp())
    spark.sparkContext.addPyFile(shutil.make_archive(f"{top}/quillspark", "zip", package.parent, package.name))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may do without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (path or "/tmp/checkpoints").rstrip("/")
