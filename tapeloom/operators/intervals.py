"""Intervals: gaps, islands, unions and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.grid import seconds


def gaps(rows: DataFrame, keys: list[str], time: str, longer_than: int) -> DataFrame:
    """(keys, gap_start, gap_end, gap_s): neighbours more than longer_than seconds apart."""
    w = Window.partitionBy(*keys).orderBy(time)
    before = rows.select(*keys, F.lag(time).over(w).alias("gap_start"), F.col(time).alias("gap_end"))
    apart = seconds("gap_end") - seconds("gap_start")
    return before.withColumn("gap_s", apart).where(F.col("gap_s") > longer_than)


def islands(rows: DataFrame, keys: list[str], time: str, step: int) -> DataFrame:
    """(keys, island_start, island_end, size): runs of rows exactly step seconds apart."""
    w = Window.partitionBy(*keys).orderBy(time)
    mark = seconds(time) - F.row_number().over(w) * step
    return (
        rows.withColumn("_island", mark)
        .groupBy(*keys, "_island")
        .agg(F.min(time).alias("island_start"), F.max(time).alias("island_end"), F.count("*").alias("size"))
        .drop("_island")
    )


def union_of(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end): spans that overlap or touch, merged."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)
    marked = spans.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlapping(points: DataFrame, spans: DataFrame, keys: list[str], length: int, time: str, start: str, end: str, block: int = 3600) -> DataFrame:
    """points joined to the spans that their [time, time + length) overlaps, by blocks of time."""

    def blocks(a: Column, b: Column) -> Column:
        return F.explode(F.sequence(F.floor(a / block), F.floor(b / block)))

    p = points.withColumn("_block", blocks(seconds(time), seconds(time) + length - 1)).alias("p")
    s = spans.withColumn("_block", blocks(seconds(start), seconds(end))).alias("s")
    same = [F.col(f"p.{k}") == F.col(f"s.{k}") for k in [*keys, "_block"]]
    hit = (seconds(F.col(f"p.{time}")) < seconds(F.col(f"s.{end}"))) & (seconds(F.col(f"p.{time}")) + length > seconds(F.col(f"s.{start}")))
    columns = [F.col(f"p.{c}") for c in points.columns] + [F.col(f"s.{c}") for c in spans.columns if c not in points.columns]
    return p.join(s, same).where(hit).select(*columns).distinct()
