"""Makes the package importable in Python workers that don't find it by themselves."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ensure_importable(spark: SparkSession) -> None:
    """Send the package to the workers, once a session, unless their path has it: by PYTHONPATH, or by the folder that the driver runs in."""
    package = Path(__file__).resolve().parent.parent
    root, app = package.parent, spark.sparkContext.applicationId
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or any(p and Path(p).resolve() == root for p in known):
        return
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='weftline-')}/{package.name}", "zip", root, package.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
