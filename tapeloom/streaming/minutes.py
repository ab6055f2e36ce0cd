"""Structured Streaming over the tape: finished minutes, late trades, and a forming bar.

A minute is final when event time has passed its end by the grace; a trade that comes later is
reported, never applied.  State is kept by symbol and holds unfinished minutes only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tapeloom.functions.grid import bucket

MINUTE_US = 60_000_000


def read_tape(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A stream of trades from the Parquet files of a folder, so many files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def closed_minutes(trades: DataFrame, grace: str = "2 seconds") -> DataFrame:
    """Finished minutes by watermark (append mode): the open minute at the end is never emitted."""
    order = F.struct("ts", "trade_id")
    return (
        trades.withWatermark("ts", grace)
        .groupBy("symbol", F.window("ts", "1 minute").alias("w"))
        .agg(
            F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", order).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("n"),
        )
        .select("symbol", F.col("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "n")
    )


OUT = "symbol string, kind string, open_us long, open double, high double, low double, close double, n long"
#: State: the next minute that is not final yet, and the unfinished trades as (us, id, px).
STATE = "next_us long, us array<long>, ids array<long>, px array<double>"


def minutes_with_late(trades: DataFrame, grace_us: int = 2_000_000) -> DataFrame:
    """Finished minutes and late trades (kind M1 or LATE) of trades (symbol, us, trade_id, px).

    The clock is the largest event time of the symbol, less the grace. A repeated trade_id in a
    minute counts once.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_us, us, ids, px = state.get if state.exists else (0, [], [], [])
        kinds = {"us": "int64", "trade_id": "int64", "px": "float64"}  # an empty frame would make floats of all
        rows = [pd.DataFrame({"us": list(us), "trade_id": list(ids), "px": list(px)}).astype(kinds)]
        late = []
        for frame in frames:
            old = frame["us"] < next_us
            late.append(frame[old])
            rows.append(frame.loc[~old, ["us", "trade_id", "px"]])
        held = pd.concat(rows).drop_duplicates("trade_id").sort_values(["us", "trade_id"])
        out = []
        for row in pd.concat(late).itertuples() if late else []:
            out.append((key[0], "LATE", int(row.us), row.px, row.px, row.px, row.px, 1))
        if len(held):
            bound = (int(held["us"].max()) - grace_us) // MINUTE_US * MINUTE_US
            done = held[held["us"] < bound]
            for minute, part in done.groupby(done["us"] // MINUTE_US):
                p = part["px"]
                out.append((key[0], "M1", int(minute) * MINUTE_US, p.iloc[0], p.max(), p.min(), p.iloc[-1], len(p)))
            held = held[held["us"] >= bound]
            next_us = max(next_us, bound)
        state.update((next_us, held["us"].tolist(), held["trade_id"].tolist(), held["px"].tolist()))
        yield pd.DataFrame(out, columns=["symbol", "kind", "open_us", "open", "high", "low", "close", "n"])

    return trades.groupBy("symbol").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def forming(trades: DataFrame, tf: str = "1h") -> DataFrame:
    """The forming bar of each symbol so far (for update or complete mode)."""
    order = F.struct("ts", "trade_id")
    return trades.groupBy("symbol", bucket("ts", tf).alias("open_time")).agg(
        F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", order).alias("close"), F.count("*").alias("n")
    )


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write a stream's output to Parquet until all input that is there was read."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path)
    query.trigger(availableNow=True).start().awaitTermination()


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> None:
    """Call work(rows, number) for every batch until all input that is there was read. A batch may
    come again after a failure, so work must overwrite what belongs to its number."""
    query = stream.writeStream.foreachBatch(work).outputMode(mode).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def revise_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Store the trades of a stream and, batch by batch, the minutes that each batch's trades fall into.

    A batch reads the stored trades of the days it touches only, makes its minutes anew from them,
    and writes both to folders of its number, which it overwrites if it comes again; so a repeated
    batch changes nothing, and work grows with what is touched, not with what is stored.
    """
    from tapeloom.operators.bars import bars_of_trades

    spark = stream.sparkSession

    def work(rows: DataFrame, number: int) -> None:
        rows = rows.withColumn("day", F.to_date("ts")).persist()
        rows.write.mode("overwrite").partitionBy("day").parquet(f"{path}/trades/batch={number}")
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # of one batch
        stored = spark.read.parquet(f"{path}/trades").where((F.col("batch") <= number) & F.col("day").isin(days)) if days else rows
        touched = rows.select("symbol", bucket("ts", "1m").alias("open_time")).distinct()
        own = stored.withColumn("open_time", bucket("ts", "1m")).join(touched, ["symbol", "open_time"], "left_semi").drop("open_time", "day", "batch")
        bars_of_trades(own, "1m").write.mode("overwrite").parquet(f"{path}/minutes/batch={number}")
        rows.unpersist()

    each_batch(stream, work, checkpoint, "append")


def revised_minutes(spark: SparkSession, path: str) -> DataFrame:
    """The last revision of every minute that revise_batches() wrote, with revision: how often it was made anew."""
    rows = spark.read.parquet(f"{path}/minutes")
    own = F.struct(*(c for c in rows.columns if c not in ("symbol", "open_time", "batch")))
    last = rows.groupBy("symbol", "open_time").agg(F.max_by(own, "batch").alias("_m"), (F.count("*") - 1).alias("revision"))
    return last.select("symbol", "open_time", "_m.*", "revision")


def fan_out(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], path: str, checkpoint: str) -> None:
    """Write every batch of stream to each sink's table (path/name), as the sink's function makes it.

    A batch is read once. It is a folder of its own in each table, which a repeated batch overwrites.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        for name, shape in sinks.items():
            shape(rows).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        rows.unpersist()

    each_batch(stream, write, checkpoint, "append")
