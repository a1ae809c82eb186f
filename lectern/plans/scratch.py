"""Folders for intermediate tables that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; a local one only where that is unset and Spark local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="lectern-")
    return "/".join((base.rstrip("/"), "lectern", f"{name}-{uuid.uuid4().hex}"))


def spread(scan: DataFrame) -> DataFrame:
    """A scan of a table with fewer splits than there are cores, spread over all of them; any other one as
    it is. What is moved is less than a split a core."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan.repartition(cores) if splits < cores else scan
