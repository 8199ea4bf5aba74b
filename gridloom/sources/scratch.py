"""Places for tables that one query writes and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names. In a local session without that setting, as in tests, a private
    one that goes with the driver's process; on a cluster, where executors share no local folder, it must be set. What is in the shared folder
    is read lazily and stays until its owner clears the folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared}/gridloom-{uuid.uuid4().hex}/{name}"


def written(rows: DataFrame, name: str = "rows") -> DataFrame:
    """The rows, written once and read from there by all that use them."""
    path = folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)
