"""Makes packages importable in Python workers."""

from __future__ import annotations

import importlib
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[tuple[str, str]] = set()


def ensure_shipped(spark: SparkSession, package: str = "shelfvec") -> None:
    """Add a package to the job once per application, as ``--py-files`` would.

    The library ships itself. An encoder that lives in a package of its own
    has to be shipped, or installed, as well.
    """
    context = spark.sparkContext
    if (context.applicationId, package) in _shipped:
        return
    folder = Path(importlib.import_module(package).__file__).resolve().parent
    archive = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='shelfvec-py-')}/{package}", "zip", folder.parent, folder.name
    )
    context.addPyFile(archive)
    _shipped.add((context.applicationId, package))
