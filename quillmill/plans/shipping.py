"""Handing this package to the Python workers of a session."""

from __future__ import annotations

import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Let the workers of ``spark`` import this package, wherever it lies on the driver.

    The sources go once per session, as an archive in the session's own file folder.
    """
    context = spark.sparkContext
    if getattr(context, "_quillmill_shipped", False):
        return
    archive = Path(SparkFiles.getRootDirectory()) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(PACKAGE.rglob("*.py")):
            file.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(str(archive))
    context._quillmill_shipped = True
