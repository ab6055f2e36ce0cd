"""From an armed zone to an order: arming minutes, confirmation, stops, targets and evaluation.

Setups have id, symbol, dir (1 long, -1 short), ob_idx, break_idx, created_idx (bars), bottom, top
(block), gap_bottom, gap_top and sweep_idx. Minutes and bars of the execution timeframe are also
numbered by time: k counts their lengths since 1970, so a horizon in k is a horizon in time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.grid import later, seconds
from tapeloom.operators.asof import asof
from tapeloom.operators.indicators import series
from tapeloom.operators.passage import first_passage, spans

MINUTES_A_BLOCK = 1440


@dataclass(frozen=True)
class OrderOptions:
    tick: float = 0.01
    stop_atr: float = 0.1
    front_atr: float = 0.05
    equal_atr: float = 0.1
    maker: float = 0.0002
    taker: float = 0.0005
    slippage: float = 0.0002
    balance: float = 1000.0
    risk: float = 0.01
    max_cost: float = 0.3
    min_net: float = 1.0
    liquidation_buffer: float = 0.5
    maintenance: float = 0.005
    max_leverage: float = 10.0
    lookback: int = 120


def by_time(bars: DataFrame, length: int) -> DataFrame:
    """bars with k, the number of lengths (seconds) since 1970 at their opening."""
    return bars.withColumn("k", F.floor(seconds("open_time") / length))


def _long() -> Column:
    return F.col("dir") == 1


def _from_market(value: Column, tick: float) -> Column:
    """value rounded to a tick, down for a long and up for a short."""
    scale = round(1 / tick)
    return F.when(_long(), F.floor(value * scale) / scale).otherwise(F.ceil(value * scale) / scale)


def armed_minutes(setups: DataFrame, bars: DataFrame, minutes: DataFrame, horizon: int) -> DataFrame:
    """setups with armed_k: the first minute that trades into the gap, from the close of the hour that
    made the setup known and within horizon minutes; null if there is none."""
    known = bars.select("symbol", F.col("idx").alias("created_idx"), (F.floor(seconds("open_time") / 60) + 60).alias("lo"))
    asks = setups.join(known, ["symbol", "created_idx"]).withColumn("hi", F.col("lo") + horizon - 1)
    touched = F.when(F.col("a.dir") == 1, F.col("b.low") <= F.col("a.gap_top")).otherwise(F.col("b.high") >= F.col("a.gap_bottom"))
    slots = minutes.select("symbol", F.col("k").alias("idx"), "high", "low")
    return first_passage(asks, slots, touched, "armed_k", MINUTES_A_BLOCK).drop("lo", "hi")


def planned(armed: DataFrame, bars: DataFrame, o: OrderOptions) -> DataFrame:
    """Armed setups with the hour last closed before the arming minute (kz, its ATR, its end kz_end in
    minutes), the sweep's wick, and every mode of entry and stop.

    edge: the block's side at the gap; middle: half of the gap. stop_wick: a tick beyond the block;
    stop_height: its height beyond; stop_structure: beyond block and sweep by stop_atr ATR.
    """
    hours = bars.select("symbol", later("open_time", 3600).alias("closed"), F.col("idx").alias("kz"), "atr", (F.floor(seconds("open_time") / 60) + 60).alias("kz_end"))
    asks = armed.where("armed_k is not null").withColumn("t", F.timestamp_add("SECOND", F.col("armed_k") * 60, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    at = asof(asks, hours, ["symbol"], "t", "closed", ["kz", "atr", "kz_end"]).drop("closed_asof", "t")
    wicks = bars.select("symbol", F.col("idx").alias("sweep_idx"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    rows = at.join(wicks, ["symbol", "sweep_idx"]).withColumn("wick", F.when(_long(), F.col("_low")).otherwise(F.col("_high"))).drop("_low", "_high")
    height = F.col("top") - F.col("bottom")
    buffer = o.stop_atr * F.coalesce("atr", F.lit(0.0))
    return rows.select(
        "*",
        F.when(_long(), F.col("top")).otherwise(F.col("bottom")).alias("edge"),
        _from_market((F.col("gap_bottom") + F.col("gap_top")) / 2, o.tick).alias("middle"),
        F.when(_long(), F.col("bottom") - o.tick).otherwise(F.col("top") + o.tick).alias("stop_wick"),
        F.when(_long(), F.col("bottom") - height).otherwise(F.col("top") + height).alias("stop_height"),
        _from_market(F.when(_long(), F.least("bottom", "wick") - buffer).otherwise(F.greatest("top", "wick") + buffer), o.tick).alias("stop_structure"),
    )


def confirmation(plans: DataFrame, bars: DataFrame, events: DataFrame, width: int, window: int) -> DataFrame:
    """id, outcome, decided_k, price, origin, origin_idx, confirm_idx, by breaks of an execution timeframe.

    bars (numbered, with k of width minutes) and events are of that timeframe. From the bar that
    holds the arming minute on, the first break of the setup's side whose reaction (the extreme
    from the broken level on) began in the zone and not before confirms. A close beyond the block
    before it, or in the same bar, is ZONE_INVALID; a window of minutes without either NO_CONFIRM;
    OPEN while the window lasts.
    """
    asks = plans.select(
        "id", "symbol", "dir", F.floor(F.col("armed_k") / width).alias("lo"), (F.floor((F.col("armed_k") + window) / width) - 1).alias("hi"),
        F.when(_long(), F.col("bottom")).otherwise(F.col("top")).alias("far"),
        F.when(_long(), F.col("bottom")).otherwise(F.col("gap_bottom")).alias("zone_low"),
        F.when(_long(), F.col("gap_top")).otherwise(F.col("top")).alias("zone_high"),
    )
    legs = events.select("symbol", "break_idx", F.col("dir").alias("side"), F.col("level_idx").alias("lo"), F.col("break_idx").alias("hi"))
    shape = bars.select("symbol", "idx", "high", "low", "close", F.col("k").alias("bar_k"))
    extreme = F.struct(F.when(F.col("side") == 1, F.col("low")).otherwise(-F.col("high")).alias("v"), F.col("idx").alias("i"))
    turn = spans(legs, shape).groupBy("symbol", "break_idx", "side").agg(
        F.min(extreme).alias("e"), F.min_by("bar_k", extreme).alias("origin_k"), F.max_by("bar_k", "idx").alias("break_k"), F.max_by("close", "idx").alias("price")
    )
    turns = turn.select(
        "symbol", F.col("break_k").alias("idx"), "break_idx", "side", "origin_k", "price", F.col("e.i").alias("origin_idx"),
        F.when(F.col("side") == 1, F.col("e.v")).otherwise(-F.col("e.v")).alias("origin"),
    )
    good = (F.col("b.side") == F.col("a.dir")) & F.col("b.origin").between(F.col("a.zone_low"), F.col("a.zone_high")) & (F.col("b.origin_k") >= F.col("a.lo"))
    more = {c: F.col(f"b.{c}") for c in ("price", "origin", "origin_idx")} | {"confirm_idx": F.col("b.break_idx")}
    found = first_passage(asks, turns, good, "confirm_k", extra=more)
    slots = bars.select("symbol", F.col("k").alias("idx"), "close")
    gone = F.when(F.col("a.dir") == 1, F.col("b.close") < F.col("a.far")).otherwise(F.col("b.close") > F.col("a.far"))
    found = first_passage(found, slots, gone, "invalid_k")
    ends = bars.groupBy("symbol").agg(F.max("k").alias("last_k"))
    j = found.join(F.broadcast(ends), "symbol")
    invalid = F.col("invalid_k") <= F.coalesce("confirm_k", F.col("invalid_k"))
    yes = F.col("outcome") == "CONFIRM"
    return j.withColumn(
        "outcome",
        F.when(invalid, "ZONE_INVALID").when(F.col("confirm_k").isNotNull(), "CONFIRM").when(F.col("last_k") > F.col("hi"), "NO_CONFIRM").otherwise("OPEN"),
    ).select(
        "id", "symbol", "dir", "outcome",
        F.when(yes, F.col("confirm_k")).when(F.col("outcome") == "ZONE_INVALID", F.col("invalid_k")).when(F.col("outcome") == "NO_CONFIRM", F.col("hi")).alias("decided_k"),
        *(F.when(yes, F.col(c)).alias(c) for c in ("price", "origin", "origin_idx", "confirm_idx")),
    )


def confirming_zones(confirmed: DataFrame, bars: DataFrame) -> DataFrame:
    """id, gap_low, gap_high, block_low, block_high: the newest gap made wholly between reaction and
    break, and the last opposite candle there; null where there is none."""
    w = series()
    shape = bars.select("symbol", "idx", "open", "close", "high", "low", F.lag("high", 2).over(w).alias("h2"), F.lag("low", 2).over(w).alias("l2"))
    rows = spans(confirmed.where("outcome = 'CONFIRM'").select("id", "symbol", "dir", F.col("origin_idx").alias("lo"), F.col("confirm_idx").alias("hi")), shape)
    gap = (F.col("idx") >= F.col("lo") + 2) & F.when(_long(), F.col("low") > F.col("h2")).otherwise(F.col("high") < F.col("l2"))
    against = F.when(_long(), F.col("close") < F.col("open")).otherwise(F.col("close") > F.col("open"))
    low = F.when(_long(), F.col("h2")).otherwise(F.col("high"))
    high = F.when(_long(), F.col("low")).otherwise(F.col("l2"))
    return rows.groupBy("id").agg(
        F.max_by(low, F.when(gap, F.col("idx"))).alias("gap_low"), F.max_by(high, F.when(gap, F.col("idx"))).alias("gap_high"),
        F.max_by("low", F.when(against, F.col("idx"))).alias("block_low"), F.max_by("high", F.when(against, F.col("idx"))).alias("block_high"),
    )


def _reach(plans: DataFrame, minutes: DataFrame, start: str, names: tuple[str, str]) -> DataFrame:
    """plans with the highest and lowest price of the minutes from start to the arming minute."""
    asks = plans.select("id", "symbol", F.col(start).alias("lo"), (F.col("armed_k") - 1).alias("hi"))
    rows = spans(asks, minutes.select("symbol", F.col("k").alias("idx"), "high", "low"))
    return plans.join(rows.groupBy("id").agg(F.max("high").alias(names[0]), F.min("low").alias(names[1])), "id", "left")


def previous_extremes(plans: DataFrame, bars: DataFrame, minutes: DataFrame, pivots: DataFrame) -> DataFrame:
    """plans with forming_high, forming_low, leg and swing (null unless beyond the edge).

    leg: the extreme made after the block, up to the arming minute; swing: the last confirmed
    swing of the side in sight.
    """
    rows = _reach(plans, minutes, "kz_end", ("forming_high", "forming_low"))
    asks = plans.select("id", "symbol", (F.col("ob_idx") + 1).alias("lo"), F.col("kz").alias("hi"))
    legs = spans(asks, bars.select("symbol", "idx", "high", "low")).groupBy("id").agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    known = pivots.groupBy("symbol", F.col("confirmed_idx").alias("idx")).pivot("kind", ["HIGH", "LOW"]).agg(F.max_by("price", "idx"))
    known = known.withColumnsRenamed({"HIGH": "_top", "LOW": "_bottom"})
    so_far = series().rowsBetween(Window.unboundedPreceding, 0)
    in_sight = bars.join(known, ["symbol", "idx"], "left").select(
        "symbol", F.col("idx").alias("kz"), F.last("_top", True).over(so_far).alias("_sh"), F.last("_bottom", True).over(so_far).alias("_sl")
    )
    rows = rows.join(legs, "id", "left").join(in_sight, ["symbol", "kz"], "left")
    leg = F.when(_long(), F.greatest("_h", "forming_high")).otherwise(F.least("_l", "forming_low"))
    swing = F.when(_long(), F.col("_sh")).otherwise(F.col("_sl"))
    ahead = {n: F.when(F.col("dir") * (c - F.col("edge")) > 0, c) for n, c in (("leg", leg), ("swing", swing))}
    return rows.withColumns(ahead).drop("_h", "_l", "_sh", "_sl")


def liquidity_targets(rows: DataFrame, bars: DataFrame, minutes: DataFrame, days: DataFrame, pivots: DataFrame, o: OrderOptions) -> DataFrame:
    """id, level, source, equal, target: the nearest level in sight that is not yet traded through.

    rows come from previous_extremes. Levels: the leg's extreme, swings of the last lookback bars
    that no later bar or minute passed, the extreme of the last whole day unless passed since. The
    target lies front_atr ATR before the level; levels whose target is not beyond the edge don't
    count. Ties go to the leg, then the swing. equal: two such swings lie within equal_atr ATR.
    """
    beyond = F.when(F.col("a.kind") == "HIGH", F.col("b.high") > F.col("a.price")).otherwise(F.col("b.low") < F.col("a.price"))
    taken = first_passage(
        pivots.select("symbol", "kind", "idx", "price", "confirmed_idx", F.concat_ws(":", "symbol", "kind", "idx").alias("id"), (F.col("idx") + 1).alias("lo"), (F.col("idx") + o.lookback).alias("hi")),
        bars.select("symbol", "idx", "high", "low"), beyond, "taken_idx",
    ).select("symbol", "idx", "kind", "price", "confirmed_idx", "taken_idx")
    asks = rows.select("id", "symbol", "dir", "kz", "forming_high", "forming_low", (F.col("kz") - o.lookback).alias("lo"), F.col("kz").alias("hi"))
    side = F.col("kind") == F.when(_long(), "HIGH").otherwise("LOW")
    whole = (F.col("confirmed_idx") <= F.col("kz")) & (F.col("taken_idx").isNull() | (F.col("taken_idx") > F.col("kz")))
    quiet = F.coalesce(F.when(_long(), F.col("forming_high") <= F.col("price")).otherwise(F.col("forming_low") >= F.col("price")), F.lit(True))
    open_swings = spans(asks, taken).where(side & whole & quiet).select("id", "price")
    ends = days.select("symbol", later("open_time", 86400).alias("closed"), F.col("high").alias("day_high"), F.col("low").alias("day_low"), (F.floor(seconds("open_time") / 60) + 1440).alias("day_end"))
    timed = rows.withColumn("t", F.timestamp_add("SECOND", F.col("armed_k") * 60, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    dated = asof(timed, ends, ["symbol"], "t", "closed", ["day_high", "day_low", "day_end"])
    dated = _reach(dated, minutes, "day_end", ("since_high", "since_low"))
    day = F.when(_long(), F.when(F.coalesce(F.col("since_high") <= F.col("day_high"), F.lit(True)), F.col("day_high"))).otherwise(
        F.when(F.coalesce(F.col("since_low") >= F.col("day_low"), F.lit(True)), F.col("day_low"))
    )
    levels = (
        rows.select("id", F.col("leg").alias("level"), F.lit(0).alias("rank"))
        .unionByName(open_swings.select("id", F.col("price").alias("level"), F.lit(1).alias("rank")))
        .unionByName(dated.select("id", day.alias("level"), F.lit(2).alias("rank")))
        .where("level is not null")
    )
    base = rows.select("id", "dir", "edge", F.coalesce("atr", F.lit(0.0)).alias("atr"))
    priced = levels.join(base, "id").withColumn("target", _from_market(F.col("level") - F.col("dir") * (o.front_atr * F.col("atr")), o.tick))
    best = (
        priced.where(F.col("dir") * (F.col("target") - F.col("edge")) > 0)
        .groupBy("id")
        .agg(F.min(F.struct((F.col("dir") * F.col("level")).alias("d"), "rank", "level", "target", "atr")).alias("b"))
        .select("id", "b.level", "b.rank", "b.target", "b.atr")
    )
    near = open_swings.join(best, "id").where(F.abs(F.col("price") - F.col("level")) <= o.equal_atr * F.col("atr")).groupBy("id").agg(F.count("*").alias("n"))
    source = F.element_at(F.array(F.lit("leg"), F.lit("swing"), F.lit("day")), F.col("rank") + 1)
    return best.join(near, "id", "left").select("id", "level", source.alias("source"), F.coalesce(F.col("n") >= 2, F.lit(False)).alias("equal"), "target")


def displacement_middles(plans: DataFrame, bars: DataFrame) -> DataFrame:
    """id, middle_of_move, discount: half way from the sweep's wick to the extreme up to the bar that
    made the setup known, and whether the edge lies in the cheaper half (for a short, the dearer)."""
    asks = plans.select("id", "symbol", "dir", "edge", "wick", F.col("sweep_idx").alias("lo"), F.col("created_idx").alias("hi"))
    far = F.when(_long(), F.max("high")).otherwise(F.min("low"))
    moved = spans(asks, bars.select("symbol", "idx", "high", "low")).groupBy("id", "dir", "edge", "wick").agg(far.alias("far"))
    middle = (F.col("wick") + F.col("far")) / 2
    return moved.select("id", middle.alias("middle_of_move"), (F.col("dir") * (F.col("edge") - middle) <= 0).alias("discount"))


def evaluated(rows: DataFrame, o: OrderOptions) -> DataFrame:
    """rows with reasons (none: accepted), cost, net, qty and leverage: limit orders at the edge, stops by
    structure.

    rows: plans with trend, tested_idx, mitigated_idx, target and discount.
    """
    judged = evaluated_orders(rows.withColumns({"entry": F.col("edge"), "stop": F.col("stop_structure"), "market": F.lit(False)}), o)
    return judged.drop("entry", "stop", "market")


def evaluated_orders(rows: DataFrame, o: OrderOptions) -> DataFrame:
    """rows with reasons (none: accepted), cost, net, qty and leverage.

    rows: entry, stop, market, target, discount (null: not judged), dir, trend, tested_idx,
    mitigated_idx, created_idx and kz. The first of NO_BIAS, BIAS_MISMATCH, ZONE_INVALID, NOT_FRESH
    (not for a market order), BAD_STOP ends the evaluation; the other reasons add up. A market order
    pays the taker's fee at its entry.
    """
    entry, stop, target, side = F.col("entry"), F.col("stop"), F.col("target"), F.col("dir")
    paid = F.when(F.col("market"), o.taker).otherwise(o.maker)
    distance = F.abs(entry - stop)
    fees = entry * paid + stop * o.taker + stop * o.slippage
    unit = distance + fees
    fill = target - target * o.slippage * side
    net = ((fill - entry) * side - entry * paid - fill * o.taker) / unit
    wanted = F.floor(o.balance * o.risk / unit * 100000) / 100000
    cap = F.floor(o.balance / ((1 + o.liquidation_buffer) * distance + o.maintenance * entry) * 100000) / 100000
    first = (
        F.when(F.col("trend") == 0, "NO_BIAS")
        .when(F.col("trend") != side, "BIAS_MISMATCH")
        .when((F.col("mitigated_idx") <= F.col("kz")) | (F.col("kz") > F.col("created_idx") + o.lookback), "ZONE_INVALID")
        .when((F.col("tested_idx") <= F.col("kz")) & ~F.col("market"), "NOT_FRESH")
        .when(side * (entry - stop) <= 0, "BAD_STOP")
    )
    cost = F.when(distance > 0, fees / distance)
    sized = rows.withColumns({"first_": first, "cost": cost, "net": net, "qty": F.least(wanted, cap), "capped_": cap < wanted})
    sized = sized.withColumn("leverage", F.col("qty") * entry / o.balance)
    others = F.array_compact(
        F.array(
            F.when(F.col("cost") > o.max_cost, "COST_HEAVY"),
            F.when(~F.col("discount"), F.when(side == 1, "NOT_DISCOUNT").otherwise("NOT_PREMIUM")),
            F.when(target.isNull(), "NO_TARGET").when(F.col("net") < o.min_net, "LOW_NET_RR"),
            F.when(F.col("capped_") & (F.col("qty") <= 0), "LIQ_LIMITED"),
            F.when(F.col("leverage") > o.max_leverage, "LEVERAGE"),
        )
    )
    return sized.withColumn("reasons", F.when(F.col("first_").isNotNull(), F.array("first_")).otherwise(others)).drop("first_", "capped_")


def order_moments(plans: DataFrame, confirmed: DataFrame | None, minutes: int) -> DataFrame:
    """id, at_k, kind, reason, price: when the order of an armed setup exists.

    Without confirmed: a LIMIT order at the edge from the arming minute. With confirmed (id, outcome,
    decided_k in bars of so many minutes, price): a MARKET order at the close of the confirming bar,
    or REJECTED with the outcome as reason; no row while the outcome is open.
    """
    if confirmed is None:
        return plans.select("id", F.col("armed_k").alias("at_k"), F.lit("LIMIT").alias("kind"), F.lit("").alias("reason"), F.col("edge").alias("price"))
    won = F.col("outcome") == "CONFIRM"
    return confirmed.where("outcome <> 'OPEN'").select(
        "id", ((F.col("decided_k") + 1) * minutes).alias("at_k"), F.when(won, "MARKET").otherwise("REJECTED").alias("kind"),
        F.when(won, "").otherwise(F.col("outcome")).alias("reason"), F.when(won, F.col("price")).alias("price"),
    )


@dataclass(frozen=True)
class Mode:
    """How an armed setup becomes an order.

    order: touch (a limit from the arming minute), market (at the close of the confirming bar) or
    limit (from that close). entry: edge, middle, exec_gap (half of the confirming move's gap, else its
    block, else middle), exec_block (else middle); a market order's is the close. stop: wick, height,
    structure. target: fixed (rr times the distance to the stop), previous (extreme), liquidity.
    previous: leg or swing. discount: move (sweep to the displacement's extreme), or target (wick to
    the previous extreme, judged if there is one).
    """

    name: str
    order: str = "touch"
    entry: str = "edge"
    stop: str = "structure"
    target: str = "liquidity"
    previous: str = "leg"
    discount: str = "move"
    rr: float = 0.0


def in_modes(touched: DataFrame, confirmed: DataFrame, zones: DataFrame, modes: list[Mode], o: OrderOptions) -> DataFrame:
    """Plans in each mode: id (setup/mode), setup, mode's settings, edge (the mode's entry), block_edge, stop.

    touched: plans at the arming minute; confirmed: plans at the close of the confirming bar, with price; zones:
    what confirming_zones gives. A mode takes the plans of its moment.
    """
    settings = F.array(*(F.struct(F.lit(m.name).alias("mode"), F.lit(m.order).alias("order"), F.lit(m.entry).alias("entry_mode"), F.lit(m.stop).alias("stop_mode"),
        F.lit(m.target).alias("target_mode"), F.lit(m.previous).alias("previous_mode"), F.lit(m.discount).alias("discount_mode"), F.lit(m.rr).alias("rr")) for m in modes))
    both = touched.withColumn("_moment", F.lit("touch")).unionByName(confirmed.join(zones, "id", "left").withColumn("_moment", F.lit("confirm")), allowMissingColumns=True)
    rows = both.select("*", F.inline(settings)).where((F.col("order") == "touch") == (F.col("_moment") == "touch")).drop("_moment")
    half = _from_market((F.col("gap_low") + F.col("gap_high")) / 2, o.tick)
    block = F.when(_long(), F.col("block_high")).otherwise(F.col("block_low"))
    entry = (
        F.when(F.col("order") == "market", F.col("price"))
        .when(F.col("entry_mode") == "edge", F.col("edge"))
        .when(F.col("entry_mode") == "exec_gap", F.coalesce(half, block, "middle"))
        .when(F.col("entry_mode") == "exec_block", F.coalesce(block, "middle"))
        .otherwise(F.col("middle"))
    )
    stop = F.when(F.col("stop_mode") == "wick", F.col("stop_wick")).when(F.col("stop_mode") == "height", F.col("stop_height")).otherwise(F.col("stop_structure"))
    return rows.withColumns({"setup": F.col("id"), "id": F.concat_ws("/", "id", "mode"), "block_edge": F.col("edge"), "edge": entry, "stop": stop})


def targets_in_modes(rows: DataFrame, liquidity: DataFrame, middles: DataFrame, o: OrderOptions) -> DataFrame:
    """rows of in_modes, with previous extremes, ready for evaluated_orders: entry, market, target and discount.

    liquidity: what liquidity_targets gives for the rows; middles: id, middle_of_move.
    """
    found = rows.join(liquidity.select("id", F.col("target").alias("_liquid")), "id", "left").join(middles.select("id", "middle_of_move"), "id", "left")
    entry, side = F.col("edge"), F.col("dir")
    level = F.when(F.col("previous_mode") == "swing", F.col("swing")).otherwise(F.col("leg"))
    before = _from_market(level - side * (o.front_atr * F.coalesce("atr", F.lit(0.0))), o.tick)
    target = (
        F.when(F.col("target_mode") == "fixed", _from_market(entry + side * (F.col("rr") * F.abs(entry - F.col("stop"))), o.tick))
        .when(F.col("target_mode") == "previous", F.when(side * (before - entry) > 0, before))
        .otherwise(F.col("_liquid"))
    )
    cheap = F.when(F.col("discount_mode") == "move", side * (F.col("block_edge") - F.col("middle_of_move")) <= 0).otherwise(
        side * (entry - (F.col("wick") + level) / 2) <= 0
    )
    return found.withColumns({"entry": entry, "market": F.col("order") == "market", "target": target, "discount": cheap}).drop("_liquid")


def arming_states(setups: DataFrame, bars: DataFrame, minutes: DataFrame, lookback: int) -> DataFrame:
    """setups with armed_k and arming: ARMED, ARMED_BEFORE or NONE.

    The first bar of the zone's timeframe (hours) after created_idx, within lookback, that trades into the gap is
    looked for; then the first minute in it that does. ARMED_BEFORE: the symbol's minutes that are
    still held begin after that bar's opening, so the minute is not known (armed_k is null).
    """
    into = F.when(F.col("a.dir") == 1, F.col("b.low") <= F.col("a.gap_top")).otherwise(F.col("b.high") >= F.col("a.gap_bottom"))
    asks = setups.withColumns({"lo": F.col("created_idx") + 1, "hi": F.col("created_idx") + lookback})
    opened = {"_open_k": F.floor(seconds(F.col("b.open_time")) / 60)}
    hit = first_passage(asks, bars.select("symbol", "idx", "high", "low", "open_time"), into, "_hit", extra=opened).drop("lo", "hi")
    held = minutes.groupBy("symbol").agg(F.min("k").alias("_first_k"))
    inside = hit.withColumns({"lo": F.col("_open_k"), "hi": F.col("_open_k") + 59}).join(F.broadcast(held), "symbol", "left")
    found = first_passage(inside, minutes.select("symbol", F.col("k").alias("idx"), "high", "low"), into, "armed_k")
    gone = F.col("_hit").isNotNull() & (F.col("_first_k").isNull() | (F.col("_first_k") > F.col("_open_k")))
    state = F.when(gone, "ARMED_BEFORE").when(F.col("armed_k").isNotNull(), "ARMED").otherwise("NONE")
    return found.withColumns({"arming": state, "armed_k": F.when(~gone, F.col("armed_k"))}).drop("lo", "hi", "_hit", "_open_k", "_first_k")
