"""Sends the package to the executors, which need not have it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession, *modules: Path) -> None:
    """Adds the package, and single modules beside it, to what the context's Python workers import from (once)."""
    context = spark.sparkContext
    if getattr(context, "_factloom_shipped", False):
        return
    archive = Path(tempfile.mkdtemp()) / "factloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(PACKAGE.parent))
        for f in modules:
            z.write(f, f.name)
    context.addPyFile(str(archive))
    context._factloom_shipped = True
