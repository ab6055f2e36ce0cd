"""Trades of a book: which ones free slots admit, ends besides stop and target, break-even costs."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.passage import first_passage, spans
from tapeloom.operators.persist import made_once
from tapeloom.operators.running import running_max

FAR = 1 << 40


def clusters(trades: DataFrame, keys: list[str], start: str, end: str, width: int) -> DataFrame:
    """trades with cluster: the start of the run of overlapping trades that each belongs to.

    No trade of a cluster is open when the next cluster starts. width: length of the chunks of
    start in which a task looks at its trades; only one row a chunk is looked at together.
    """
    rows = trades.withColumn("_chunk", F.floor(F.col(start) / width))
    reach = running_max(rows, keys, "_chunk", [start, "id"], F.col(end), "_reach", own=False)
    begins = F.when(F.col("_reach").isNull() | (F.col(start) >= F.col("_reach")), F.col(start))
    found = running_max(reach.withColumn("_begins", begins), keys, "_chunk", [start, "id"], F.col("_begins"), "cluster")
    return found.drop("_chunk", "_reach", "_begins")


def admitted(trades: DataFrame, keys: list[str], start: str, end: str, slots: int, width: int) -> DataFrame:
    """The trades (id, keys, start, end) that a book with so many slots takes, in order of (start, id).

    A trade holds its slot from start up to end, where another may take it. Taking is greedy, so it
    goes in order, but only within a cluster: a task holds one run of overlapping trades. Empty
    keys: one book for all markets.
    """

    def take(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([start, "id"])
        busy: list = []
        keep = []
        for a, z in zip(frame[start], frame[end], strict=True):
            busy = [x for x in busy if x > a]
            keep.append(len(busy) < slots)
            if keep[-1]:
                busy.append(z)
        return frame[keep]

    grouped = clusters(trades.select("id", *keys, start, end), keys, start, end, width)
    return grouped.groupBy(*keys, "cluster").applyInPandas(take, grouped.schema).drop("cluster")


def lives(raced: DataFrame, bars: DataFrame, against: DataFrame, hold: int, time_stop: int) -> DataFrame:
    """raced (result of a race: id, symbol, dir, filled_idx, exit_idx, state) with two more ends.

    INVALIDATED: the first bar after the fill that is in against (symbol, idx, side) with the other
    side; TIME_STOP: so many bars after the fill (0: none). In one bar stop and target go first,
    then INVALIDATED, TIME_STOP, TIMEOUT. Trades that were never filled stay as they are.
    """
    last = F.broadcast(bars.groupBy("symbol").agg(F.max("idx").alias("_last")))
    asks = raced.join(last, "symbol").withColumn("lo", F.col("filled_idx") + 1).withColumn("hi", F.col("filled_idx") + hold)
    met = first_passage(asks, against, F.col("b.side") == -F.col("a.dir"), "_against")
    stop_at = F.when((F.lit(time_stop) > 0) & (F.col("filled_idx") + time_stop <= F.col("_last")), F.col("filled_idx") + time_stop)

    def end(idx: Column, place: int | Column, name: str | Column) -> Column:
        place, name = (x if isinstance(x, Column) else F.lit(x) for x in (place, name))
        return F.struct(F.coalesce(idx, F.lit(FAR)).cast("long").alias("i"), place.alias("p"), name.alias("n"))

    own = end(F.col("exit_idx"), F.when(F.col("state") == "TIMEOUT", 3).otherwise(0), F.col("state"))
    first = F.when(F.col("filled_idx").isNull(), own).otherwise(F.least(own, end(F.col("_against"), 1, "INVALIDATED"), end(stop_at, 2, "TIME_STOP")))
    done = met.withColumn("_end", first)
    at = F.when(F.col("_end.i") < FAR, F.col("_end.i"))
    name = F.when(at.isNull(), F.col("state")).otherwise(F.col("_end.n"))
    return done.withColumn("_name", name).withColumn("_at", at).select(*(c for c in raced.columns if c not in ("exit_idx", "state")), F.col("_at").alias("exit_idx"), F.col("_name").alias("state"))


def target_walks(touches: DataFrame, bars: DataFrame, horizon: int) -> DataFrame:
    """id, exit_idx, kind, level, gross of trades entered at a bar: stop, target or the horizon's end.

    touches: id, symbol, dir, idx, entry, stop, target. The stop counts in the entry bar, the target
    from the next on; in one bar the stop goes first. gross is in risk units. Touches whose horizon
    passes the data's end are left out.
    """
    asks = touches.where("entry <> stop").select("id", "symbol", "dir", "entry", "stop", "target", F.col("idx").alias("lo"), (F.col("idx") + horizon - 1).alias("hi"))
    rows = spans(asks, bars.select("symbol", "idx", "high", "low", "close"))
    long = F.col("dir") == 1
    stopped = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    reached = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target")) & (F.col("idx") > F.col("lo"))
    ends = rows.groupBy("id", "dir", "entry", "stop", "target", "hi").agg(
        F.min(F.when(stopped, F.col("idx"))).alias("s"), F.min(F.when(reached, F.col("idx"))).alias("t"), F.max("idx").alias("end"), F.max_by("close", "idx").alias("close")
    )
    s, t = F.col("s"), F.col("t")
    kind = F.when(s.isNotNull() & (t.isNull() | (s <= t)), "SL").when(t.isNotNull(), "TP").otherwise("TIME")
    named = ends.where("end = hi").withColumn("kind", kind)
    level = F.when(F.col("kind") == "SL", F.col("stop")).when(F.col("kind") == "TP", F.col("target")).otherwise(F.col("close"))
    at = F.when(F.col("kind") == "SL", s).when(F.col("kind") == "TP", t).otherwise(F.col("hi"))
    gross = (level - F.col("entry")) * F.col("dir") / F.abs(F.col("entry") - F.col("stop"))
    return named.select("id", at.alias("exit_idx"), "kind", level.alias("level"), gross.alias("gross"))


def net_total(factor: Column) -> Column:
    """Sum of net results, each over its risk with costs, when all costs are scaled by factor."""
    return F.sum((F.col("gross") - factor * F.col("cost")) / (F.col("unit") + factor * F.col("risk_cost")))


def break_even(trades: DataFrame, key: str, most: float = 64.0, ways: int = 32, rounds: int = 6) -> DataFrame:
    """key, factor: by how much costs may grow until the net results of a key add up to 0.

    trades: key, gross, cost, unit, risk_cost in price. null: a loss even without costs; at most
    ``most``. Each round is one aggregation that tries ways - 1 factors between the bounds, so the
    rows are summed where they are and only one row a key moves.
    """
    trades = made_once(trades.select(key, "gross", "cost", "unit", "risk_cost"), "break_even")
    start = trades.groupBy(key).agg(net_total(F.lit(0.0)).alias("free"))
    bounds = start.select(key, F.when(F.col("free") > 0, 0.0).alias("low"), F.lit(most).alias("high"))
    for _ in range(rounds):
        bounds = made_once(bounds, "bounds")
        step = (F.col("high") - F.col("low")) / ways
        tried = trades.join(bounds.where("low is not null"), key).groupBy(key, "low", "high").agg(*(net_total(F.col("low") + step * i).alias(f"t{i}") for i in range(1, ways)))
        below = reduce(lambda found, i: F.when(F.col(f"t{i}") > 0, F.lit(i)).otherwise(found), range(1, ways), F.lit(0))
        moved = tried.select(key, (F.col("low") + step * below).alias("_low"), (F.col("low") + step * (below + 1)).alias("_high"))
        bounds = bounds.join(moved, key, "left").select(key, F.coalesce("_low", "low").alias("low"), F.coalesce("_high", "high").alias("high"))
    return bounds.select(key, F.col("low").alias("factor"))
