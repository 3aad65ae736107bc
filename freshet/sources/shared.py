"""Folders that driver and executors share, for files that a job writes and reads back."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession, label: str) -> str:
    """Path of a new folder below ``spark.checkpoint.dir``; deleted when the Python process ends.

    Where the session leaves that unset, a local run gets a temporary folder; on a cluster it is an error,
    since executors wouldn't see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="freshet-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/freshet-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _clear() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone already; the folder is only scratch
            pass


atexit.register(_clear)
