"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``. Only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/graphloom-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str, *partition: str) -> DataFrame:
    """Keep ``df`` as files in the shared folder: later steps do not recompute it, and it survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.partitionBy(*partition).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
