"""Tables that are made once and read many times, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; on one machine a temporary one if that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tapeloom-market-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/market/{name}-{uuid.uuid4().hex}"


def made_once(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: later uses read the table, and lost executors cost nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
