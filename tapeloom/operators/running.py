"""Running totals over long ordered groups, in chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with the sum of value over all rows of the group up to and including this one.

    chunk is a column that never falls along the order (a day, say): totals of chunks are summed
    first, so a task holds one chunk of a group and never the whole of it.
    """
    totals = rows.groupBy(*keys, chunk).agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, chunk, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("_inside", F.sum(value).over(inside))
        .join(before, [*keys, chunk])
        .withColumn(name, F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before")
    )


def running_max(rows: DataFrame, keys: list[str], chunk: str, order: list[str], value: Column, name: str, own: bool = True) -> DataFrame:
    """rows with the largest value over all rows of the group before this one, and with own this one.

    chunk as in running_sum; keys may be empty. null where no value came before.
    """
    tops = rows.groupBy(*keys, chunk).agg(F.max(value).alias("_top"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*keys, chunk, F.max("_top").over(earlier).alias("_before"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    return (
        rows.withColumn("_inside", F.max(value).over(inside))
        .join(before, [*keys, chunk])
        .withColumn(name, F.greatest("_inside", "_before"))
        .drop("_inside", "_before")
    )


def drawdown(rows: DataFrame, keys: list[str], chunk: str, order: list[str], value: str) -> DataFrame:
    """rows with equity (running sum), peak (never below 0) and drawdown (peak less equity).

    chunk as in running_sum.
    """
    with_equity = running_sum(rows, keys, chunk, order, F.col(value), "equity")
    with_peak = running_max(with_equity, keys, chunk, order, F.col("equity"), "_peak").withColumn("peak", F.greatest("_peak", F.lit(0))).drop("_peak")
    return with_peak.withColumn("drawdown", F.col("peak") - F.col("equity"))
