"""As-of joins: the latest earlier row of another table, in chunks of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.grid import seconds


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    tolerance: int | None = None,
    strict: bool = False,
    chunk: int = 86400,
) -> DataFrame:
    """left with values of the latest row of right with the same keys and right_time <= left_time
    (< if strict), or nulls. tolerance, in seconds, is applied after the latest row was taken.

    Both tables are cut into chunks of time. A window looks back inside a chunk; what earlier
    chunks end with is carried over from one row a chunk, so no task holds a key's whole history.
    """
    key = [F.col(k) for k in keys]
    own = F.struct(F.col(right_time).alias("_at"), *values)
    rows = right.select(*key, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_kind"), own.alias("_r"), F.lit(None).alias("_l"))
    asks = left.select(*key, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_kind"), F.lit(None).alias("_r"), F.struct("*").alias("_l"))
    both = rows.drop("_l").unionByName(asks.drop("_r"), allowMissingColumns=True).withColumn("_chunk", F.floor(seconds("_t") / chunk))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = both.groupBy(*keys, "_chunk").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_t"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_chunk", F.last("_end", True).over(earlier).alias("_carried"))
    found = (
        both.withColumn("_in", F.last("_r", True).over(inside))
        .where(F.col("_l").isNotNull())
        .join(carried, [*keys, "_chunk"])
        .withColumn("_got", F.coalesce("_in", "_carried"))
    )
    if tolerance is not None:
        near = seconds("_got._at") >= seconds("_t") - tolerance
        found = found.withColumn("_got", F.when(near, F.col("_got")))
    return found.select("_l.*", F.col("_got._at").alias(f"{right_time}_asof"), *(F.col(f"_got.{v}").alias(v) for v in values))
