"""Folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import InvalidArgument


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only a local session without that setting (tests) gets this machine's temp."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not found and master != "local" and not master.startswith("local["):
        raise InvalidArgument("set spark.checkpoint.dir to a folder that driver and executors share")
    root = found.rstrip("/") if found else tempfile.mkdtemp(prefix="skein-")
    return f"{root}/skein-{tag}-{uuid.uuid4().hex}"
