"""A shared folder for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under the one that the session names in ``spark.checkpoint.dir``.

    Where that is unset, one machine gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if root is None and (not context.master.startswith("local") or "cluster" in context.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='cubeloom-')}/cubeloom-{uuid.uuid4().hex}"
