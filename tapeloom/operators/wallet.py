"""Simulated wallets: sizes that depend on the balance so far, margin, funding, and a running ledger.

What a wallet may take depends on all that it booked before, so its events are folded in order.
Spark merges, deals and sorts the events; a task walks over its sorted rows and holds a wallet's
balance and its open positions, never its history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events of one moment: funding, then ends, then new orders; an order that ends as it begins ends last.
FUNDING, END, OPEN, OWN_END = 0, 1, 2, 3
LEDGER = "wallet string, seq long, at long, id string, kind string, note string, qty double, amount double, fees double, balance double, margin double"
_EMPTY = {"entry": 0.0, "stop": 0.0, "dir": 0, "price": 0.0, "filled": False}


def events_of(trades: DataFrame, fundings: DataFrame) -> DataFrame:
    """at, rank, id, kind and what the fold needs of trades and their funding times.

    trades: id, dir, entry, stop, created_at, filled_at, ended_at, price (of the exit); filled_at is
    null for orders that never filled, ended_at for those that still run. fundings: id, at, price.
    """
    shape = ("entry", "stop", "dir", "price", "filled")
    opened = trades.select(F.col("created_at").alias("at"), F.lit(OPEN).alias("rank"), "id", F.lit("OPEN").alias("kind"), "entry", "stop", "dir", F.lit(0.0).alias("price"), F.lit(False).alias("filled"))
    rank = F.when(F.col("ended_at") == F.col("created_at"), OWN_END).otherwise(END)
    ended = trades.where("ended_at is not null").select(
        F.col("ended_at").alias("at"), rank.alias("rank"), "id", F.lit("END").alias("kind"), "entry", "stop", "dir", F.coalesce("price", F.lit(0.0)).alias("price"), F.col("filled_at").isNotNull().alias("filled")
    )
    paid = fundings.join(trades.select("id", "entry", "stop", "dir"), "id").select("at", F.lit(FUNDING).alias("rank"), "id", F.lit("FUNDING").alias("kind"), "entry", "stop", "dir", "price", F.lit(True).alias("filled"))
    columns = ["at", "rank", "id", "kind", *shape]
    return opened.select(*columns).unionByName(ended.select(*columns)).unionByName(paid.select(*columns))


def _floor(value: float, step: float) -> float:
    return math.floor(value / step) * step


def sized(balance: float, margin: float, entry: float, stop: float, w) -> tuple[float, str]:
    """(quantity, note) of a new order; a quantity of 0 comes with the reason of its rejection.

    The order may lose the share risk of the balance; its margin (notional / leverage) must fit into
    what the open orders leave; with a buffer, a loss of (1 + buffer) stop distances must leave the
    maintenance margin.
    """
    if balance <= 0:
        return 0.0, "WALLET_EMPTY"
    qty, note = _floor(balance * w.risk / abs(entry - stop), w.step), ""
    free = max(balance - margin, 0.0)
    if qty * entry / w.leverage > balance - margin:
        qty, note = _floor(free * w.leverage / entry, w.step), "MARGIN_LIMITED"
    if w.buffer > 0:
        cap = free / ((1 + w.buffer) * abs(entry - stop) + w.maintenance * entry)
        if qty > cap:
            qty, note = _floor(cap, w.step), "LIQ_LIMITED"
            if qty <= 0:
                return 0.0, note
    if qty <= 0:
        return 0.0, "NO_FREE_MARGIN" if note else "SIZE_BELOW_STEP"
    return qty, note


def ledger(events: DataFrame, wallets: DataFrame, maker: float, taker: float, funding: float) -> DataFrame:
    """The ledger of each wallet over the same events (events_of()), in order of (at, rank, id).

    wallets: wallet, initial, risk, leverage, step, buffer, maintenance. Rows: wallet, seq (from 1),
    at, id, kind (OPENED, REJECTED, FUNDING, RELEASED, REALIZED_PNL), note, qty, amount, fees, and
    balance and margin after the row. An order that was rejected has no later rows. RELEASED: an
    order that ended unfilled gives its margin back. A wallet without events has no rows.

    Every wallet takes part in every event, so the rows are wallets times events; wallets are few
    and broadcast, a wallet's events are one sorted run of rows. State: balance and open orders.
    """
    names = [field.split()[0] for field in LEDGER.split(", ")]
    settings = ["wallet", "initial", "risk", "leverage", "step", "buffer", "maintenance"]
    every = events.withColumn("_all", F.lit(1)).join(F.broadcast(wallets.select(*settings).withColumn("_all", F.lit(1))), "_all").drop("_all")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wallet, seq, balance, margin, held = None, 0, 0.0, 0.0, {}
        for frame in frames:
            out = []
            for e in frame.itertuples():
                if e.wallet != wallet:
                    wallet, seq, balance, margin, held = e.wallet, 0, e.initial, 0.0, {}
                note, amount, fees = "", 0.0, 0.0
                if e.kind == "OPEN":
                    qty, note = sized(balance, margin, e.entry, e.stop, e)
                    kind = "OPENED" if qty > 0 else "REJECTED"
                    if qty > 0:
                        held[e.id] = qty, qty * e.entry / e.leverage
                        margin += held[e.id][1]
                elif e.id not in held:
                    continue
                elif e.kind == "FUNDING":
                    qty, kind = held[e.id][0], "FUNDING"
                    amount = -(qty * funding * e.price * e.dir)
                    balance += amount
                else:
                    qty, own = held.pop(e.id)
                    margin = margin - own if held else 0.0
                    kind = "REALIZED_PNL" if e.filled else "RELEASED"
                    if e.filled:
                        fees = qty * (e.entry * maker + e.price * taker)
                        amount = qty * (e.price - e.entry) * e.dir - fees
                        balance += amount
                seq += 1
                out.append((wallet, seq, e.at, e.id, kind, note, qty, amount, fees, balance, margin))
            yield pd.DataFrame(out, columns=names)

    dealt = every.repartition("wallet").sortWithinPartitions("wallet", "at", "rank", "id")
    return dealt.mapInPandas(fold, LEDGER)


def views(rows: DataFrame, wallets: DataFrame, trades: DataFrame, prices: DataFrame, maker: float, taker: float) -> DataFrame:
    """A row a wallet: balance, equity, unrealized, margin, free, realized, fees, open and rejected orders.

    rows: ledger(). trades: id, symbol, dir, entry, filled_at. prices: symbol, price, the last ones; an
    open order that has filled is marked at its symbol's price less the fees of both ends.
    """
    last = rows.groupBy("wallet").agg(
        F.max_by(F.struct("balance", "margin"), "seq").alias("l"), F.sum("fees").alias("fees"), F.count_if(F.col("kind") == "REJECTED").alias("rejected")
    )
    done = rows.where(F.col("kind").isin("RELEASED", "REALIZED_PNL")).select("wallet", "id")
    still = rows.where("kind = 'OPENED'").select("wallet", "id", "qty").join(done, ["wallet", "id"], "left_anti")
    net = F.col("dir") * (F.col("price") - F.col("entry")) - F.col("entry") * maker - F.col("price") * taker
    marked = still.join(trades.select("id", "symbol", "dir", "entry", "filled_at"), "id").join(F.broadcast(prices), "symbol", "left")
    unreal = marked.groupBy("wallet").agg(F.count("*").alias("open"), F.sum(F.when(F.col("filled_at").isNotNull(), F.col("qty") * net).otherwise(0.0)).alias("unrealized"))
    one = wallets.select("wallet", "initial").join(last, "wallet", "left").join(unreal, "wallet", "left")
    zero: Column = F.lit(0.0)
    balance, margin, unrealized = F.coalesce("l.balance", "initial"), F.coalesce("l.margin", zero), F.coalesce("unrealized", zero)
    return one.select(
        "wallet", balance.alias("balance"), (balance + unrealized).alias("equity"), unrealized.alias("unrealized"), margin.alias("margin"), (balance - margin).alias("free"),
        (balance - F.col("initial")).alias("realized"), F.coalesce("fees", zero).alias("fees"), F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("rejected", F.lit(0)).alias("rejected"),
    )
