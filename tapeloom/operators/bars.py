"""OHLCV bars: from trades, from finer bars, with closed buckets only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.grid import SECONDS, bucket, later
from tapeloom.operators.running import running_sum


def bars_of_trades(trades: DataFrame, tf: str, grid: str = "utc") -> DataFrame:
    """symbol, open_time, open, high, low, close, volume, n from trades in order (ts, trade_id).

    Partial aggregation leaves one row a bucket and task for the shuffle. A trade that was delivered
    twice counts twice: see delivered_once().
    """
    first, last = F.struct("ts", "trade_id"), F.struct("ts", "trade_id")
    return (
        trades.withColumn("open_time", bucket("ts", tf, grid))
        .groupBy("symbol", "open_time")
        .agg(
            F.min_by("px", first).alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", last).alias("close"),
            F.sum("qty").alias("volume"),
            F.count("*").alias("n"),
        )
    )


def delivered_once(trades: DataFrame, tf: str = "1m") -> DataFrame:
    """trades with one delivery of each trade_id of a symbol and bucket: the one received first.

    Trades are dealt by bucket, as the bars that follow need them, so this is the only shuffle.
    """
    dealt = trades.withColumn("_b", bucket("ts", tf)).repartition("symbol", "_b")
    own = F.struct(*[F.col(c) for c in trades.columns])
    return dealt.groupBy("symbol", "_b", "trade_id").agg(F.min_by(own, F.struct("recv", "ts")).alias("_t")).select("_t.*")


def coarser(bars: DataFrame, tf: str, grid: str = "utc", upto: str | None = None) -> DataFrame:
    """Bars of a longer timeframe. With upto, only buckets that end by then."""
    made = (
        bars.withColumn("bucket", bucket("open_time", tf, grid))
        .groupBy("symbol", "bucket")
        .agg(
            F.min_by("open", "open_time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_time").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("n").alias("n"),
        )
        .withColumnRenamed("bucket", "open_time")
    )
    if upto is None:
        return made
    return made.where(later("open_time", SECONDS[tf]) <= F.lit(upto).cast("timestamp_ntz"))


def numbered(bars: DataFrame) -> DataFrame:
    """bars with idx, the bar's number in its symbol's series from 0; a task counts one day of bars."""
    dated = bars.withColumn("_day", F.to_date("open_time"))
    counted = running_sum(dated, ["symbol"], "_day", ["open_time"], F.lit(1), "idx")
    return counted.withColumn("idx", (F.col("idx") - 1).cast("long")).drop("_day")


def five_of_one(minutes: DataFrame) -> DataFrame:
    """5-minute bars with inherited quality, from minutes (symbol, open_time, status, ohlcv, n).

    Any gap or unanchored minute makes a gap; all synthetic minutes a synthetic bar; an unknown
    count makes the sum unknown; a bar needs all its five minutes.
    """
    bad = F.col("status").isin("DATA_GAP", "UNANCHORED")
    made = (
        minutes.withColumn("bucket", bucket("open_time", "5m"))
        .groupBy("symbol", "bucket")
        .agg(
            F.count("*").alias("minutes"),
            F.bool_or(bad).alias("bad"),
            F.bool_and(F.col("status") == "SYNTHETIC_NO_TRADE").alias("synthetic"),
            F.min_by("open", "open_time").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "open_time").alias("close"),
            F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n"),
        )
        .where("minutes = 5")
    )
    status = F.when(F.col("bad"), "DATA_GAP").when(F.col("synthetic"), "SYNTHETIC_NO_TRADE").otherwise("OK")
    keep = ~F.col("bad")
    prices = [F.when(keep, F.col(c)).alias(c) for c in ("open", "high", "low", "close", "n")]
    return made.select("symbol", F.col("bucket").alias("open_time"), status.alias("status"), *prices)
