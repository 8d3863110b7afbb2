"""Where driver and executors both can write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's address below spark.checkpoint.dir; below one of our own only where none is set and all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            folder = set_before.get()
        elif spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
            folder = f"file://{tempfile.mkdtemp(prefix='aerolake-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder.rstrip('/')}/aerolake-{name}-{uuid.uuid4().hex}"
