"""Two feeds of the same trades, aligned batch by batch.

A part of a group is aligned once nothing that may still come can pair with any of its rows; the
open band behind it is carried to the next batch.  So all batches together give what one alignment
of everything would.  Each batch writes folders of its own, which it overwrites if it comes again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.persist import made_once
from tapeloom.operators.reconcile import aligned, aligned_parts, parts_of
from tapeloom.streaming.minutes import each_batch

_TABLES = ("matched", "single", "carry", "spans")


def _settled(rows: DataFrame, keys: list[str], early: float, late: float, horizon: float) -> DataFrame:
    """rows (side, keys, id, t) with their part, and closed: nothing after horizon can pair with a row of it."""
    left, right = rows.where("side = 0"), rows.where("side = 1")
    part = parts_of(left, right, keys, early, late)
    end = F.max("t").over(Window.partitionBy(*keys, "_part"))
    return part.withColumn("closed", end + max(early, late) < horizon)


def _sides(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    return tuple(rows.where(F.col("side") == side).select(*keys, "id", "t") for side in (0, 1))


def align_batches(stream: DataFrame, path: str, checkpoint: str, keys: list[str], early: float, late: float, settle: float) -> None:
    """Align the rows of stream (side 0 or 1, keys, id, t in seconds) until all input that is there was read.

    Rows may come up to ``settle`` seconds behind the latest one seen, and the same row in several
    batches. Written below path: matched (left_id, right_id), single (side, id: rows without a
    partner), spans (start, end: the time that a batch's rows of side 0 account for), and the carried
    rows. finish() aligns what is left when nothing more comes.
    """
    spark = stream.sparkSession
    names = ["side", *keys, "id", "t"]

    def work(rows: DataFrame, number: int) -> None:
        fresh = rows.select(*names).dropDuplicates(["side", "id"])
        before = None
        if number:
            before = spark.read.parquet(f"{path}/carry/batch={number - 1}")
            fresh = fresh.join(before.select("side", "id"), ["side", "id"], "left_anti")
            fresh = fresh.withColumn("done", F.lit(False)).unionByName(before.drop("horizon"))
        else:
            fresh = fresh.withColumn("done", F.lit(False))
        fresh = fresh.persist()
        seen = rows.agg(F.max("t").alias("last"), F.min(F.when(F.col("side") == 0, F.col("t"))).alias("first")).first()
        known = before.agg(F.max("horizon")).first()[0] if before is not None else None
        horizon = max(x for x in (known, seen["last"] - settle if seen["last"] is not None else None, float("-inf")) if x is not None)
        split = made_once(_settled(fresh.where("not done").drop("done"), keys, early, late, horizon), "split")
        parts = split.where("closed").drop("closed")
        closed = parts.select(*names)
        matched = made_once(aligned_parts(parts, keys, early, late), "matched")
        _write(matched, path, "matched", number)
        _write(_unmatched(closed, matched), path, "single", number)
        # done rows are kept while they may come again
        open_ = split.where("not closed").select(*names).withColumn("done", F.lit(False))
        done = closed.withColumn("done", F.lit(True)).unionByName(fresh.where("done").select(*names, "done"))
        recent = done.where(F.col("t") >= horizon - settle - max(early, late))
        _write(open_.select(*names, "done").unionByName(recent.select(*names, "done")).withColumn("horizon", F.lit(horizon)), path, "carry", number)
        reach = spark.createDataFrame([(seen["first"], horizon)], "first double, horizon double")
        _write(reach.select((F.col("first") - early).alias("start"), (F.col("horizon") - late).alias("end")).where("start < end"), path, "spans", number)
        fresh.unpersist()

    each_batch(stream, work, checkpoint, "append")


def _write(rows: DataFrame, path: str, name: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")


def _unmatched(rows: DataFrame, matched: DataFrame) -> DataFrame:
    both = matched.select(F.lit(0).alias("side"), F.col("left_id").alias("id")).unionByName(matched.select(F.lit(1).alias("side"), F.col("right_id").alias("id")))
    return rows.select("side", "id").join(both, ["side", "id"], "left_anti")


def finish(spark, path: str, keys: list[str], early: float, late: float) -> tuple[DataFrame, DataFrame]:
    """(matched, single) of all batches and of what the last one carried."""
    carry = spark.read.parquet(f"{path}/carry")
    last = carry.agg(F.max("batch")).first()[0]
    open_ = carry.where((F.col("batch") == last) & ~F.col("done"))
    rest = made_once(aligned(*_sides(open_, keys), keys, early, late), "rest")
    matched = spark.read.parquet(f"{path}/matched").select("left_id", "right_id").unionByName(rest)
    return matched, spark.read.parquet(f"{path}/single").select("side", "id").unionByName(_unmatched(open_, rest))
