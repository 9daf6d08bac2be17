"""Ships the package to executors, so that functions sent there can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Arrow batches to Python workers: long texts come in smaller ones than the default of 64 MB.
BATCH_BYTES = "8m"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package's files to the session's Python files, once for each application, and bounds Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="ranklume-")) / "ranklume.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root).as_posix()}")
    sc.addPyFile(str(path))
    _shipped.add(sc.applicationId)
