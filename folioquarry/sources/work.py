"""Work tables in the shared folder: they cut lineage, and any executor can read them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only where that is unset and the master is local, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="work-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df, written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{folder or work_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
