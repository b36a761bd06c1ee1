"""Readers and writers are imported by the executors when a document needs them: this sends the package there."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once."""
    context = spark.sparkContext
    if getattr(context, "_quill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):  # else the package itself came as an archive, which the session already has
        folder = tempfile.mkdtemp(prefix="quillspark-")  # the driver serves it from there until it ends
        atexit.register(shutil.rmtree, folder, True)
        path = os.path.join(folder, "quillspark.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for at, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(at, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        context.addPyFile(path)
    context._quill_shipped = True
