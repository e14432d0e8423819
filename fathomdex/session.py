"""A local session for tests and the benchmark; on a cluster the caller brings its own."""

from __future__ import annotations

import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Bytes of rows that Spark hands to a Python worker at once, where the session's bound is not less.
BATCH_BYTES = 4_000_000
_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def local_session(cpus: int | str = 8, partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fathomdex")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FATHOMDEX_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as a path on a mounted file system;
    in local mode, where none may be named, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fathomdex-"))
        found = spark.sparkContext.getCheckpointDir()
    path = re.sub("^file:/+", "/", found)
    if not path.startswith("/"):
        raise RuntimeError(f"the store needs a mounted folder, not {found}")
    return path


def bound_batches(spark: SparkSession) -> None:
    """Bounds the batches of this session's Python functions, unless they are bounded by less."""
    bound = spark.conf.get(_BOUND, None)
    if bound is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(bound) > BATCH_BYTES:
        spark.conf.set(_BOUND, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Sends the package to Python workers, unless they find it by themselves: through
    PYTHONPATH, or as the working folder. Once for each application."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    app = spark.sparkContext.applicationId
    if app in _shipped or any(p and os.path.realpath(p) == os.path.realpath(root) for p in paths):
        return
    folder = tempfile.mkdtemp(prefix="fathomdex-package-")
    archive = shutil.make_archive(os.path.join(folder, "fathomdex"), "zip", root, "fathomdex")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


_shipped: set[str] = set()
