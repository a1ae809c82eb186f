"""Makes this package importable where tasks run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, unless their interpreters find it anyway:
    they inherit the driver's PYTHONPATH, and in local mode its folder."""
    context = spark.sparkContext
    found = {Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)}
    if context.master.startswith("local") and ROOT in found | {Path.cwd().resolve()} or context.applicationId in _shipped:
        return
    path = Path(tempfile.mkdtemp()) / "lectern.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted((ROOT / "lectern").rglob("*.py")):
            archive.write(file, file.relative_to(ROOT))
    context.addPyFile(str(path))
    _shipped.add(context.applicationId)
