"""Written intermediate tables in the folder the cluster shares.

Losing an executor must not lose a result, so nothing here keeps data on one
machine: small intermediate tables are written once to ``spark.checkpoint.dir``
and read back. The read-back scan also carries true file sizes.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where none is set, a local master gets a fresh local folder; on a cluster executors do
    not share local folders, so there it is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(local)
    return local


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; no two calls return the same one."""
    return f"{shared_dir(spark).rstrip('/')}/fieldspark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and return the read-back table (cuts lineage, fixes its size)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
