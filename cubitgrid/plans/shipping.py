"""This package on the workers' path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's source to Python workers once a session, unless their path has it already."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(":") or getattr(spark.sparkContext, "_cubitgrid", False):
        return
    to = Path(tempfile.mkdtemp()) / "cubitgrid_src.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "cubitgrid").rglob("*.py")):
            z.write(p, str(p.relative_to(root)))
    spark.sparkContext.addPyFile(str(to))
    spark.sparkContext._cubitgrid = True
