"""The folder for tables that outlive a plan."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}  # temporary folders, by application


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names. Where it is unset: on one machine a temporary folder, on a cluster
    an error, since its machines don't see each other's folders."""
    key = "spark.checkpoint.dir"
    found = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {key} to a folder that the driver and all executors share")
        found = _OWN.get(spark.sparkContext.applicationId) or "file://" + tempfile.mkdtemp(prefix="factloom-")
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")
