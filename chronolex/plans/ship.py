"""Give the executors this package, wherever the driver has it from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_folders: list[tempfile.TemporaryDirectory] = []  # removed when the driver ends


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the Python path of the session's workers, once an application.

    The archive lies beside the driver only until Spark's file server has it; workers that already find
    the package on their path are not harmed.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parents[1]
        folder = tempfile.TemporaryDirectory(prefix="chronolex-ship-")
        _folders.append(folder)
        archive = Path(folder.name) / "chronolex.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"chronolex/{f.relative_to(package)}")
        spark.sparkContext.addPyFile(str(archive))
        _shipped.add(app)
    return spark
