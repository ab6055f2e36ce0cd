"""Trades on bars: first-passage races, outcomes in risk units, capacity, funding, sizing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.passage import BLOCK, spans


def race(
    orders: DataFrame, bars: DataFrame, hold: int, expiry: int, block: int = BLOCK, target_first: bool = False, through: bool = False
) -> DataFrame:
    """orders with filled_idx, exit_idx, state: the life of a limit order as a race of first bars.

    orders: id, symbol, dir, created_idx, entry, stop, target. An order fills on the first bar that
    reaches entry, unless the target was reached (MISSED) or expiry bars passed (EXPIRED) before
    that bar. A fill bar that reaches the stop exits there. From the next bar on, in one bar the
    stop goes before the target, and both before TIMEOUT after hold bars. OPEN at the data's end.
    target_first: the target goes before the stop; through: a fill needs a price beyond the entry.
    """
    horizon = expiry + hold
    b = bars.select("symbol", "idx", "high", "low", F.floor(F.col("idx") / block).alias("_block"))
    span = orders.withColumn("last", F.col("created_idx") + horizon)
    spread = span.select("*", F.explode(F.sequence(F.floor(F.col("created_idx") / block), F.floor(F.col("last") / block))).alias("_block"))
    met = spread.join(b, ["symbol", "_block"]).where(F.col("idx").between(F.col("created_idx"), F.col("last")))
    long = F.col("dir") == 1
    at_entry = F.when(long, F.col("low") <= F.col("entry")).otherwise(F.col("high") >= F.col("entry"))
    if through:
        at_entry = F.when(long, F.col("low") < F.col("entry")).otherwise(F.col("high") > F.col("entry"))
    at_stop = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    at_target = F.when(long, F.col("high") >= F.col("target")).otherwise(F.col("low") <= F.col("target"))
    flags = met.select("id", "idx", "created_idx", at_entry.alias("e"), at_stop.alias("s"), at_target.alias("t"))

    def first(c: Column) -> Column:
        return F.min(F.when(c, F.col("idx")))

    far = F.lit(1 << 40)
    start = flags.groupBy("id", "created_idx").agg(
        first(F.col("e")).alias("f"), first(F.col("t")).alias("m"), first(F.col("idx") >= F.col("created_idx") + expiry).alias("x"), F.max("idx").alias("end")
    )
    filled = F.col("f").isNotNull() & (F.col("f") <= F.coalesce("m", far)) & (F.col("f") <= F.coalesce("x", far))
    start = start.withColumn("filled_idx", F.when(filled, F.col("f")))
    after = flags.join(start.where("filled_idx is not null").select("id", "filled_idx"), "id")
    exits = after.where("idx >= filled_idx").groupBy("id").agg(
        first((F.col("idx") == F.col("filled_idx")) & F.col("s")).alias("s0"),
        first((F.col("idx") > F.col("filled_idx")) & F.col("s")).alias("s1"),
        first((F.col("idx") > F.col("filled_idx")) & F.col("t")).alias("t1"),
        first(F.col("idx") >= F.col("filled_idx") + hold).alias("o1"),
    )
    both = start.join(exits, "id", "left")
    finish = F.least(
        F.struct(F.coalesce("s0", "s1", far).alias("i"), F.lit(1 if target_first else 0).alias("p")),
        F.struct(F.coalesce("t1", far).alias("i"), F.lit(0 if target_first else 1).alias("p")),
        F.struct(F.coalesce("o1", far).alias("i"), F.lit(2).alias("p")),
    )
    names = ("TP", "SL", "TIMEOUT") if target_first else ("SL", "TP", "TIMEOUT")
    both = both.withColumn("z", F.when(F.col("filled_idx").isNotNull(), finish))
    missed = F.col("m").isNotNull() & (F.col("m") <= F.coalesce("x", far))
    state = (
        F.when(F.col("filled_idx").isNull(), F.when(missed, "MISSED").when(F.col("x").isNotNull(), "EXPIRED").otherwise("PENDING"))
        .when(F.col("z.i") == far, "OPEN")
        .otherwise(F.element_at(F.array(*(F.lit(n) for n in names)), F.col("z.p") + 1))
    )
    exit_idx = F.when(F.col("filled_idx").isNull(), F.when(missed, F.col("m")).otherwise(F.col("x"))).when(F.col("z.i") < far, F.col("z.i"))
    out = both.select("id", "filled_idx", exit_idx.alias("exit_idx"), state.alias("state"))
    return orders.join(out, "id", "left").withColumn("state", F.coalesce("state", F.lit("PENDING")))


def net_r(state: Column, dir_: Column, entry: Column, stop: Column, target: Column, close: Column, cost: float | Column) -> Column:
    """Result in risk units: a full stop is -1, costs a share of both prices are part of the risk."""
    exit_ = F.when(state == "SL", stop).when(state == "TP", target).otherwise(close)
    unit = F.abs(entry - stop) + cost * (entry + stop)
    return (dir_ * (exit_ - entry) - cost * (entry + exit_)) / unit


def outcomes(touches: DataFrame, bars: DataFrame, horizon: int, block: int = BLOCK) -> DataFrame:
    """touches (id, symbol, dir, idx, entry, stop) with hit1..3, mfe, mae, hold.

    hitk: k risk units ahead were reached after the touch bar and before the stop's bar. mfe: best
    move before the stop's bar; mae: worst, 1 if stopped; hold: bars to one unit, else to the stop
    or the horizon. Touches whose horizon passes the data's end are left out.
    """
    b = bars.select("symbol", F.col("idx").alias("k"), "high", "low", F.floor(F.col("idx") / block).alias("_block"))
    ends = bars.groupBy("symbol").agg(F.max("idx").alias("last_idx"))
    asks = touches.join(F.broadcast(ends), "symbol").where((F.col("idx") + horizon - 1 <= F.col("last_idx")) & (F.col("entry") != F.col("stop")))
    spread = asks.select("*", F.explode(F.sequence(F.floor(F.col("idx") / block), F.floor((F.col("idx") + horizon - 1) / block))).alias("_block"))
    met = spread.join(b, ["symbol", "_block"]).where((F.col("k") >= F.col("idx")) & (F.col("k") < F.col("idx") + horizon))
    long = F.col("dir") == 1
    unit = F.abs(F.col("entry") - F.col("stop"))
    offset = F.col("k") - F.col("idx")
    stopped = F.when(long, F.col("low") <= F.col("stop")).otherwise(F.col("high") >= F.col("stop"))
    best = F.when(long, F.col("high") - F.col("entry")).otherwise(F.col("entry") - F.col("low"))
    worst = F.when(long, F.col("entry") - F.col("low")).otherwise(F.col("high") - F.col("entry"))
    rows = met.select("id", offset.alias("o"), stopped.alias("s"), best.alias("g"), worst.alias("w"), unit.alias("unit"), "dir", "entry", "high", "low")

    def reached(k: int) -> Column:
        level = F.col("entry") + F.col("dir") * k * F.col("unit")
        return F.when(F.col("dir") == 1, F.col("high") >= level).otherwise(F.col("low") <= level) & (F.col("o") > 0)

    stops = rows.groupBy("id").agg(
        F.min(F.when(F.col("s"), F.col("o"))).alias("stop_at"),
        *(F.min(F.when(reached(k), F.col("o"))).alias(f"t{k}") for k in (1, 2, 3)),
        F.max("w").alias("worst"), F.first("unit").alias("unit"),
    )
    upto = rows.join(stops.select("id", "stop_at"), "id").where(F.col("stop_at").isNull() | (F.col("o") < F.col("stop_at")))
    best_of = upto.groupBy("id").agg(F.max("g").alias("best"))
    j = stops.join(best_of, "id", "left")
    limit = F.coalesce("stop_at", F.lit(horizon))
    hit = {k: F.coalesce(F.col(f"t{k}") < limit, F.lit(False)) for k in (1, 2, 3)}
    return j.select(
        "id", *(hit[k].alias(f"hit{k}") for k in hit),
        F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0)) / F.col("unit")).alias("mfe"),
        F.greatest(F.lit(0.0), F.when(F.col("stop_at").isNotNull(), 1.0).otherwise(F.col("worst") / F.col("unit"))).alias("mae"),
        F.when(hit[1], F.col("t1")).otherwise(limit).cast("long").alias("hold"),
    )


def trailing(trades: DataFrame, bars: DataFrame, hold: int, atrs: float) -> DataFrame:
    """id, exit_idx, rule, price of filled trades whose stop follows the best price.

    trades: id, symbol, dir, filled_idx, stop. The stop stands atrs ATR (of the fill bar) behind the
    best price of the bars before, and never goes back. TIME: at the close hold bars after the
    fill; OPEN, without exit, if the data end before.
    """
    at_fill = bars.select("symbol", F.col("idx").alias("filled_idx"), F.col("atr").alias("fill_atr"))
    asks = trades.select("id", "symbol", "dir", "filled_idx", "stop").join(at_fill, ["symbol", "filled_idx"])
    asks = asks.withColumn("lo", F.col("filled_idx")).withColumn("hi", F.col("filled_idx") + hold)
    long = F.col("dir") == 1
    rows = spans(asks, bars.select("symbol", "idx", "high", "low", "close"))
    before = Window.partitionBy("id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(long, F.col("high")).otherwise(-F.col("low"))).over(before)
    rows = rows.withColumn("level", F.greatest(F.col("dir") * F.col("stop"), best - atrs * F.col("fill_atr")))
    hit = F.when(long, F.col("low")).otherwise(-F.col("high")) <= F.col("level")
    last = F.col("idx") == F.col("hi")
    out = rows.select("id", "idx", F.when(hit, F.col("dir") * F.col("level")).when(last, F.col("close")).alias("price"), F.when(hit, "TRAIL").when(last, "TIME").alias("rule"))
    ends = out.where("rule is not null").groupBy("id").agg(F.min("idx").alias("exit_idx"), F.min_by("rule", "idx").alias("rule"), F.min_by("price", "idx").alias("price"))
    return trades.select("id").join(ends, "id", "left").select("id", "exit_idx", F.coalesce("rule", F.lit("OPEN")).alias("rule"), "price")


def random_entries(trades: DataFrame, bars: DataFrame, hold: int, draws: int) -> DataFrame:
    """id, draws, mean_r: what entries of the same side and risk at random bars of the series yield.

    trades: id, symbol, dir, unit. Bars are picked by a hash of id and draw among those with hold
    bars after them; the result is the move over hold bars in units.
    """
    lengths = bars.groupBy("symbol").agg((F.max("idx") - hold).alias("room"))
    picked = trades.join(F.broadcast(lengths), "symbol").where("room > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", "id", F.col("draw").cast("string"))), 1, 7), 16, 10).cast("long")
    start = bars.select("symbol", "idx", F.col("close").alias("first"))
    end = bars.select("symbol", (F.col("idx") - hold).alias("idx"), F.col("close").alias("then"))
    rows = picked.withColumn("idx", number % F.col("room")).join(start, ["symbol", "idx"]).join(end, ["symbol", "idx"])
    return rows.groupBy("id").agg(F.count("*").alias("draws"), F.avg(F.col("dir") * (F.col("then") - F.col("first")) / F.col("unit")).alias("mean_r"))


def one_at_a_time(trades: DataFrame, group: str, start: str, end: str, slots: int = 1) -> DataFrame:
    """trades that a group with so many slots takes, in order of (start, id).

    A slot is free for a trade that starts when or after the former one ended. Greedy taking is
    inherently in order; a group is one market's trades.
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

    return trades.groupBy(group).applyInPandas(take, trades.schema)


def funding(trades: DataFrame, hours: int) -> Column:
    """Number of funding times (multiples of so many hours) in (filled_s, closed_s]."""
    step = hours * 3600
    return F.floor(F.col("closed_s") / step) - F.floor(F.col("filled_s") / step)


def position_size(balance: Column, risk: float, unit: Column, step: float = 1e-5) -> Column:
    """Quantity that loses the share risk of balance over one risk unit, floored to a step."""
    return F.floor(balance * risk / unit / step + 1e-9) * step


def liquidation_cap(balance: Column, entry: Column, stop: Column, maintenance: float) -> Column:
    """Largest quantity that the stop still closes before the margin is used up."""
    return balance / (F.abs(entry - stop) + maintenance * entry)
