"""Where intermediate tables go: a folder that the driver and all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share. Where that is unset a session that is one process
    gets a local one; on a cluster that would be another folder on each machine, so it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/palimpsest-{uuid.uuid4().hex}"
