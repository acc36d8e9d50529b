"""A session with the settings the engine is tuned for."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

import corpusmill
from corpusmill.storage import put_bytes, scratch_path

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that it need not be installed
    there. It goes through the shared folder, where an executor that joins later finds it too."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(corpusmill.__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = f"{scratch_path(spark, 'package')}.zip"
    put_bytes(spark, path, packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def local_session(cpus: int | str = "*", app: str = "corpusmill") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use its own session and keep
    adaptive execution on, so partitions are sized and skewed joins split at run time."""
    cores = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate())
