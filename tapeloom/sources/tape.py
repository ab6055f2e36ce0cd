"""The trade tape: ticks with an exact price path, and bars stored by two sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.running import running_sum


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, trade_id, conn, qty, props, px of every event.

    The price is a path of exact decimal steps by symbol, in order of (ts, trade_id).
    """
    rows = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        "ts",
        F.col("event_id").alias("trade_id"),
        (F.col("user_id") % 3).alias("conn"),
        F.col("value").cast("decimal(18,2)").alias("qty"),
        "props",
    )
    path = running_sum(rows.withColumn("day", F.to_date("ts")), ["symbol"], "day", ["ts", "trade_id"], F.col("qty") - 50, "path")
    return path.withColumn("px", (F.col("path") + 10000).cast("double")).drop("path", "day")


def merged(live: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of live, and those of history whose keys live has not."""
    return live.unionByName(history.join(live.select(*keys), keys, "left_anti"))
