"""The shared folder for tables and stream progress that outlive a task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a local one only where driver and executors are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quire-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quire/{name}-{uuid.uuid4().hex}"
