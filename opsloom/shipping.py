"""Send the package to the Python workers, which don't share the driver's path."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import weakref
import zipfile
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import SparkSession

_sent: weakref.WeakSet[SparkContext] = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once a context."""
    context = spark.sparkContext
    if context in _sent:
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp()  # executors fetch the file from here for as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, f"{top.name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(top.rglob("*.py")):
            out.write(source, str(source.relative_to(top.parent)))
    context.addPyFile(path)
    _sent.add(context)
