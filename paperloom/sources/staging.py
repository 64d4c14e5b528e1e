"""The folder that driver and executors share, for files that one job writes and another reads."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def staging_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below spark.checkpoint.dir; below a folder of this machine only where none is set and Spark runs on this machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="paperloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
