"""Market structure as windows and bounded joins: pivots, breaks, blocks, gaps, sweeps, lifetimes.

bars has symbol, idx, open_time, open, high, low, close and, where named, atr. Every fact carries
the bar at which it is known, so nothing depends on later bars.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.operators.indicators import running_last, series, windowed
from tapeloom.operators.passage import first_passage, spans


@dataclass(frozen=True)
class StructureOptions:
    swing_len: int = 5
    ob_lookback: int = 60
    ob_rule: str = "last_opposite"
    fvg_min_atr: float = 0.5
    ob_min_atr: float = 0.5
    ob_require_fvg: bool = True
    fvg_fill: str = "wick"
    eq_tol_atr: float = 0.1
    lookback: int = 400


def swings(bars: DataFrame, n: int) -> DataFrame:
    """symbol, kind, idx, price, confirmed_idx: highs above the n bars before and not below the n
    after (lows alike), where both sides are complete."""

    def pivots(w: WindowSpec) -> dict[str, Column]:
        left, right = w.rowsBetween(-n, -1), w.rowsBetween(1, n)
        whole = (F.count("*").over(left) == n) & (F.count("*").over(right) == n)
        high = whole & (F.col("high") > F.max("high").over(left)) & (F.col("high") >= F.max("high").over(right))
        low = whole & (F.col("low") < F.min("low").over(left)) & (F.col("low") <= F.min("low").over(right))
        return {"_high": high, "_low": low}

    found = F.array_compact(
        F.array(
            F.when(F.col("_high"), F.struct(F.lit("HIGH").alias("kind"), F.col("high").alias("price"))),
            F.when(F.col("_low"), F.struct(F.lit("LOW").alias("kind"), F.col("low").alias("price"))),
        )
    )
    marked = windowed(bars.select("symbol", "idx", "high", "low"), pivots, before=n, after=n)
    return marked.select("symbol", "idx", F.explode(found).alias("s")).select(
        "symbol", "s.kind", "idx", "s.price", (F.col("idx") + n).alias("confirmed_idx")
    )


def breaks(bars: DataFrame, pivots: DataFrame) -> DataFrame:
    """symbol, break_idx, dir, level, level_idx, kind: first closes beyond the swing in force.

    A swing is in force from its confirmation to that of the next of its kind, or its break. A bar
    that breaks a high does not break a low. A break against the former one is a CHOCH, else a BOS.
    """
    known = (
        pivots.withColumnRenamed("idx", "swing_idx")
        .groupBy("symbol", F.col("confirmed_idx").alias("idx"))
        .pivot("kind", ["HIGH", "LOW"])
        .agg(F.max(F.struct(F.col("swing_idx").alias("idx"), "price")))
        .withColumnsRenamed({"HIGH": "_top", "LOW": "_bottom"})
    )
    met = bars.select("symbol", "idx", "close").join(known, ["symbol", "idx"], "left")
    armed = running_last(met, {"h": F.col("_top"), "l": F.col("_bottom")}).drop("_top", "_bottom")
    highs = (
        armed.where("close > h.price")
        .groupBy("symbol", F.col("h.idx").alias("level_idx"))
        .agg(F.min("idx").alias("break_idx"), F.first("h.price").alias("level"))
        .withColumn("dir", F.lit(1))
    )
    free = armed.where("close < l.price").join(highs.select("symbol", F.col("break_idx").alias("idx")), ["symbol", "idx"], "left_anti")
    lows = (
        free.groupBy("symbol", F.col("l.idx").alias("level_idx"))
        .agg(F.min("idx").alias("break_idx"), F.first("l.price").alias("level"))
        .withColumn("dir", F.lit(-1))
    )
    before = F.lag("dir").over(Window.partitionBy("symbol").orderBy("break_idx"))
    kind = F.when(before == -F.col("dir"), "CHOCH").otherwise("BOS")
    return highs.unionByName(lows).select("symbol", "break_idx", "dir", "level", "level_idx", kind.alias("kind"))


def trend(bars: DataFrame, events: DataFrame) -> DataFrame:
    """symbol, idx, trend: the direction of the last break, 0 before the first."""
    at = events.select("symbol", F.col("break_idx").alias("idx"), "dir")
    met = bars.select("symbol", "idx").join(at, ["symbol", "idx"], "left")
    return running_last(met, {"trend": F.col("dir")}).select("symbol", "idx", F.coalesce("trend", F.lit(0)).alias("trend"))


def fair_value_gaps(bars: DataFrame, min_atr: float) -> DataFrame:
    """symbol, created_idx, dir, bottom, top: three-bar gaps of at least min_atr ATR (any size while
    the ATR is unknown)."""
    looked = windowed(bars.select("symbol", "idx", "high", "low", "atr"), lambda w: {"_high2": F.lag("high", 2).over(w), "_low2": F.lag("low", 2).over(w)}, before=2)
    high2, low2 = F.col("_high2"), F.col("_low2")
    up, down = F.col("low") > high2, F.col("high") < low2
    rows = looked.select(
        "symbol",
        F.col("idx").alias("created_idx"),
        F.when(up, 1).when(down, -1).alias("dir"),
        F.when(up, high2).when(down, F.col("high")).alias("bottom"),
        F.when(up, F.col("low")).when(down, low2).alias("top"),
        "atr",
    )
    big = F.col("atr").isNull() | (F.col("top") - F.col("bottom") >= min_atr * F.col("atr"))
    return rows.where(F.col("dir").isNotNull() & big).drop("atr")


def order_blocks(bars: DataFrame, events: DataFrame, o: StructureOptions) -> DataFrame:
    """symbol, break_idx, dir, ob_idx, bottom, top, gap_bottom, gap_top, created_idx.

    The last opposite candle (or the extreme one, latest on ties) between the level and the break,
    big enough, with a gap right after it; that gap may close one bar after the break.
    """
    near = windowed(
        bars.select("symbol", "idx", "open", "high", "low", "close"), lambda w: {"high2": F.lead("high", 2).over(w), "low2": F.lead("low", 2).over(w)}, after=2
    )
    asks = events.select("symbol", "break_idx", "dir", F.greatest(F.col("level_idx") + 1, F.col("break_idx") - o.ob_lookback).alias("lo"), (F.col("break_idx") - 1).alias("hi"))
    joined = spans(asks, near)
    if o.ob_rule == "extreme":
        rank = F.struct(F.when(F.col("dir") == 1, -F.col("low")).otherwise(F.col("high")), F.col("idx"))
    else:
        joined = joined.where(F.when(F.col("dir") == 1, F.col("close") < F.col("open")).otherwise(F.col("close") > F.col("open")))
        rank = F.struct(F.col("idx"))
    chosen = joined.groupBy("symbol", "break_idx", "dir").agg(F.max_by(F.struct("idx", "high", "low", "high2", "low2"), rank).alias("c"))
    at_break = bars.select("symbol", F.col("idx").alias("break_idx"), "atr")
    rows = chosen.join(at_break, ["symbol", "break_idx"])
    rows = rows.where(F.col("atr").isNull() | (F.lit(o.ob_min_atr) <= 0) | (F.col("c.high") - F.col("c.low") >= o.ob_min_atr * F.col("atr")))
    long = F.col("dir") == 1
    gap_bottom = F.when(long, F.col("c.high")).otherwise(F.col("c.high2"))
    gap_top = F.when(long, F.col("c.low2")).otherwise(F.col("c.low"))
    out = rows.select(
        "symbol", "break_idx", "dir", F.col("c.idx").alias("ob_idx"), F.col("c.low").alias("bottom"), F.col("c.high").alias("top"),
        gap_bottom.alias("gap_bottom"), gap_top.alias("gap_top"),
        F.greatest("break_idx", F.col("c.idx") + 2).alias("created_idx"),
    )
    if o.ob_require_fvg:
        return out.where("gap_top > gap_bottom")
    has = F.col("gap_top") > F.col("gap_bottom")
    return out.select(
        "symbol", "break_idx", "dir", "ob_idx", "bottom", "top",
        F.when(has, F.col("gap_bottom")).alias("gap_bottom"), F.when(has, F.col("gap_top")).alias("gap_top"),
        F.col("break_idx").alias("created_idx"),
    )


def leg_gaps(bars: DataFrame, legs: DataFrame) -> DataFrame:
    """symbol, id, mid_idx, bottom, top: every three-bar gap whose middle bar lies in (lo, hi)."""
    w = series()
    high0, low0, high2, low2 = F.lag("high").over(w), F.lag("low").over(w), F.lead("high").over(w), F.lead("low").over(w)
    rows = bars.select("symbol", "idx", high0.alias("h0"), low0.alias("l0"), high2.alias("h2"), low2.alias("l2"))
    inner = legs.select("symbol", "id", "dir", (F.col("lo") + 1).alias("lo"), (F.col("hi") - 1).alias("hi"))
    met = spans(inner, rows).where("(dir = 1 and l2 > h0) or (dir = -1 and h2 < l0)")
    return met.select(
        "symbol", "id", F.col("idx").alias("mid_idx"),
        F.when(F.col("dir") == 1, F.col("h0")).otherwise(F.col("h2")).alias("bottom"),
        F.when(F.col("dir") == 1, F.col("l2")).otherwise(F.col("l0")).alias("top"),
    )


def lifetimes(zones: DataFrame, bars: DataFrame, lookback: int, wick: bool) -> DataFrame:
    """zones (id, symbol, dir, created_idx, bottom, top) with tested_idx and mitigated_idx.

    A zone lives for lookback bars, the last included. wick: it is filled when traded through, else
    when closed beyond.
    """
    asks = zones.withColumn("lo", F.col("created_idx") + 1).withColumn("hi", F.col("created_idx") + lookback)
    long = F.col("a.dir") == 1
    touched = F.when(long, F.col("b.low") <= F.col("a.top")).otherwise(F.col("b.high") >= F.col("a.bottom"))
    if wick:
        broken = F.when(long, F.col("b.low") <= F.col("a.bottom")).otherwise(F.col("b.high") >= F.col("a.top"))
    else:
        broken = F.when(long, F.col("b.close") < F.col("a.bottom")).otherwise(F.col("b.close") > F.col("a.top"))
    tested = first_passage(asks, bars, touched | broken, "tested_idx")
    return first_passage(tested, bars, broken, "mitigated_idx").drop("lo", "hi")


def sweeps(bars: DataFrame, pivots: DataFrame, lookback: int, tol_atr: float) -> DataFrame:
    """symbol, idx, dir, level, wick: bars that take confirmed swings and close back.

    A swing is taken by the first bar beyond it after its confirmation, within lookback. A bar
    that leaves a swing about equal to the deepest level (within tol_atr ATR) intact is no sweep.
    """
    asks = pivots.select(
        "symbol", F.when(F.col("kind") == "LOW", 1).otherwise(-1).alias("dir"), F.col("idx").alias("swing_idx"), "price", "confirmed_idx",
        (F.col("confirmed_idx") + 1).alias("lo"), (F.col("idx") + lookback).alias("hi"),
        F.concat_ws(":", "symbol", "kind", "idx").alias("id"),
    )
    beyond = F.when(F.col("a.dir") == 1, F.col("b.low") < F.col("a.price")).otherwise(F.col("b.high") > F.col("a.price"))
    taken = first_passage(asks, bars, beyond, "taken_idx")
    level = F.when(F.col("dir") == 1, F.min("price")).otherwise(F.max("price"))
    met = taken.where("taken_idx is not null").groupBy("symbol", "dir", F.col("taken_idx").alias("idx")).agg(level.alias("level"))
    at = met.join(bars.select("symbol", "idx", "close", "high", "low", F.coalesce(tol_atr * F.col("atr"), F.lit(0.0)).alias("tol")), ["symbol", "idx"])
    back = F.when(F.col("dir") == 1, F.col("close") > F.col("level")).otherwise(F.col("close") < F.col("level"))
    at = at.where(back)
    p = taken.select("symbol", F.col("swing_idx").alias("idx"), F.col("dir").alias("side"), "price", "confirmed_idx", "taken_idx")
    asks = at.select("symbol", "dir", F.col("idx").alias("at_idx"), F.col("level").alias("at_level"), "tol", (F.col("idx") - lookback).alias("lo"), (F.col("idx") - 1).alias("hi"))
    intact = spans(asks, p).where(
        (F.col("side") == F.col("dir")) & (F.col("confirmed_idx") < F.col("at_idx")) & (F.col("taken_idx").isNull() | (F.col("taken_idx") > F.col("at_idx")))
        & F.when(F.col("dir") == 1, F.col("price") >= F.col("at_level") - F.col("tol")).otherwise(F.col("price") <= F.col("at_level") + F.col("tol"))
    )
    clear = at.join(intact.select("symbol", "dir", F.col("at_idx").alias("idx")), ["symbol", "dir", "idx"], "left_anti")
    return clear.select("symbol", "idx", "dir", "level", F.when(F.col("dir") == 1, F.col("low")).otherwise(F.col("high")).alias("wick"))


def zone_kinds(bars: DataFrame, pivots: DataFrame, events: DataFrame, o: StructureOptions, sweep_bars: int) -> DataFrame:
    """kind, symbol, dir, bottom, top, known_idx, born_idx, wick: the six kinds of zones of a study.

    block: last opposite candle of a break; block_gap: with a gap right after it; block_gap_sweep:
    and a sweep of its side up to it, at most sweep_bars before the break (wick: the latest one's);
    extreme: the extreme candle instead; gap: a three-bar gap; candle_gap: an opposite candle with a
    gap right after it. Only zones that are known at a bar with an ATR. o asks for no gap or size.
    """
    atr = bars.where("atr > 0").select("symbol", F.col("idx").alias("known_idx"))
    none = F.lit(None).cast("double").alias("wick")
    zone = ("kind", "symbol", "dir", "bottom", "top", "known_idx", "born_idx", "wick")

    def named(rows: DataFrame, kind: str, known: Column, born: Column, wick: Column = none) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), "symbol", "dir", "bottom", "top", known.alias("known_idx"), born.alias("born_idx"), wick.alias("wick"))

    def blocks(rule: str) -> DataFrame:
        found = order_blocks(bars, events, replace(o, ob_rule=rule))
        return found.join(atr.withColumnRenamed("known_idx", "created_idx"), ["symbol", "created_idx"], "left_semi")

    last = blocks("last_opposite")
    born = F.col("ob_idx")
    gapped = last.where("gap_top > gap_bottom")
    late = F.greatest("break_idx", born + 2)
    swept = sweeps(bars, pivots, o.lookback, o.eq_tol_atr).select("symbol", "idx", F.col("dir").alias("side"), F.col("wick").alias("own_wick"))
    asks = gapped.withColumn("lo", F.col("break_idx") - sweep_bars).withColumn("hi", F.col("ob_idx"))
    after = spans(asks, swept).where("side = dir").groupBy(*gapped.columns).agg(F.max_by("own_wick", "idx").alias("wick"))
    w = series()
    first = bars.select("symbol", F.lag("idx", 2).over(w).alias("born_idx"), F.col("idx").alias("known_idx"), *(F.lag(c, 2).over(w).alias(c) for c in ("open", "close", "high", "low")), F.col("high").alias("high2"), F.col("low").alias("low2"), "atr")
    side = F.when((F.col("close") < F.col("open")) & (F.col("low2") > F.col("high")), 1).when((F.col("close") > F.col("open")) & (F.col("high2") < F.col("low")), -1)
    candles = first.where("atr > 0").select("symbol", side.alias("dir"), F.col("low").alias("bottom"), F.col("high").alias("top"), "known_idx", "born_idx").where("dir is not null")
    gaps = fair_value_gaps(bars, o.fvg_min_atr).join(atr.withColumnRenamed("known_idx", "created_idx"), ["symbol", "created_idx"], "left_semi")
    parts = [
        named(last, "block", F.col("break_idx"), born),
        named(gapped, "block_gap", late, born),
        named(after, "block_gap_sweep", late, born, F.col("wick")),
        named(blocks("extreme"), "extreme", F.col("break_idx"), born),
        named(gaps, "gap", F.col("created_idx"), F.col("created_idx") - 2),
        named(candles, "candle_gap", F.col("known_idx"), F.col("born_idx")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts).select(*zone)
