"""Where intermediate data goes when a plan has to be cut."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; a temporary one only where that is unset
    and driver and executors are one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="racelake-")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """`df` as a table on shared storage: its rows are fixed, it survives lost executors, it is not computed
    again, and later steps read only the columns they need."""
    spark = df.sparkSession
    path = new_path(spark, "stable")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
