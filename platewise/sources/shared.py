"""The folder that the driver and all executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder of the session (spark.checkpoint.dir); only local mode makes a folder where it is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="spark-")
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder)
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
