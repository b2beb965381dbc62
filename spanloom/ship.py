"""Makes the package importable in Python workers that were not started with it on their path."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the context's Python files, once, unless PYTHONPATH or the working folder has it."""
    context = spark.sparkContext
    there = {os.path.realpath(p) for p in (*os.environ.get("PYTHONPATH", "").split(":"), os.getcwd()) if p}
    if str(_ROOT) in there or getattr(context, "_spanloom_shipped", False):
        return
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(Path(__file__).parent, f"{folder}/tree/spanloom", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/spanloom", "zip", f"{folder}/tree"))
    context._spanloom_shipped = True
