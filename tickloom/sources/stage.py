"""Stages: tables written to the shared folder, so that lineage is cut and lost executors cost no more than tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where it is unset a temporary
    folder is taken in local mode and one below the warehouse otherwise, and set for the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        local = spark.sparkContext.master.startswith("local")
        path = tempfile.mkdtemp(prefix="tickloom-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_stages"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
