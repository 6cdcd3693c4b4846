"""Session helpers: the package on the executors, and folders that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
_folders: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the executors import this package, wherever the driver found it. Once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="trimlake-ship-"), "trimlake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(path)


def bound_batches(spark: SparkSession, most: int) -> None:
    """Let no Arrow batch hold more bytes than this, but for a single row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(key, str(most))


def shared_folder(spark: SparkSession) -> str:
    """The path of a new folder below spark.checkpoint.dir, which driver and executors share; it goes when the application ends.

    Where the setting is missing, a local session gets a folder of its own; a cluster, whose machines have no folder in common then, is refused.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="trimlake-")
        sc.setCheckpointDir(root)
    own = f"{root.rstrip('/')}/trimlake-{sc.applicationId}"
    if own not in _folders:
        _folders.add(own)
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return f"{own}/{uuid.uuid4().hex}"
