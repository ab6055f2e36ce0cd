"""Queries over the book of trades: slots, further ends, walks to a target, costs, leads, zone kinds, signals."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tapeloom.functions.grid import seconds
from tapeloom.operators import portfolio as P
from tapeloom.operators import setups as O
from tapeloom.operators import stats
from tapeloom.operators import structure as S
from tapeloom.operators.passage import spans
from tapeloom.operators.persist import made_once, shared_folder
from tapeloom.plans import facts, setups
from tapeloom.plans.base import OB, OPTIONS, STRUCTURE, Registry, hours, structure

R = Registry()
HOLD, TIME_STOP, HORIZON, WITHIN = 48, 30, 40, 48
WEEK = 168


def _busy(spark, d):
    """Orders with the bar from which they hold a slot and the one from which it is free again."""
    bars, rows = facts._raced(spark, d)
    ends = F.broadcast(bars.groupBy("symbol").agg(F.max("idx").alias("last")))
    return bars, rows.join(ends, "symbol").withColumn("free_idx", F.coalesce("exit_idx", "last") + 1)


BUSY = """busy AS (
  SELECT o.id, o.symbol, o.created_idx, coalesce(r.exit_idx, l.last) + 1 AS free_idx
  FROM orders_ o JOIN race r USING (id) JOIN (SELECT symbol, max(idx) AS last FROM bars GROUP BY 1) l ON l.symbol = o.symbol
)"""


def _greedy(source: str, key: str, start: str, end: str, slots: int) -> str:
    return f"""gq AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {start}, id) AS k FROM {source}), gw(gkey, k, id, taken, held) AS (
  SELECT DISTINCT {key}, 0::BIGINT, '', false, []::BIGINT[] FROM gq UNION ALL
  SELECT w.gkey, q.k, q.id, len(list_filter(w.held, lambda x: x > q.{start})) < {slots},
    CASE WHEN len(list_filter(w.held, lambda x: x > q.{start})) < {slots} THEN list_append(list_filter(w.held, lambda x: x > q.{start}), q.{end}::BIGINT) ELSE w.held END
  FROM gw w JOIN gq q ON q.k = w.k + 1 AND q.{key} = w.gkey)"""


@R.add(f"{facts.TRADES}, {BUSY}, {_greedy('busy', 'symbol', 'created_idx', 'free_idx', 2)} SELECT w.id, r.state FROM gw w JOIN race r USING (id) WHERE w.taken")
def sim_backtest(spark, d):
    """Two orders of a market at a time, from an order's creation to its end."""
    rows = _busy(spark, d)[1]
    return P.admitted(rows, ["symbol"], "created_idx", "free_idx", 2, WEEK).join(rows.select("id", "state"), "id").select("id", "state")


@R.add(
    f"""{facts.TRADES}, {BUSY}, clock AS (
  SELECT b.id, 1 AS book, floor(epoch(a.open_time) / 3600)::BIGINT AS start_h, floor(epoch(z.open_time) / 3600)::BIGINT + 1 AS free_h
  FROM busy b JOIN bars a ON a.symbol = b.symbol AND a.idx = b.created_idx JOIN bars z ON z.symbol = b.symbol AND z.idx = b.free_idx - 1
), {_greedy('clock', 'book', 'start_h', 'free_h', 3)} SELECT id FROM gw WHERE taken"""
)
def sim_positions_of_all_markets(spark, d):
    """Three orders at a time over all markets, in order of time."""
    bars, rows = _busy(spark, d)
    at = bars.select("symbol", "idx", F.floor(seconds("open_time") / 3600).alias("h"))
    rows = rows.join(at.withColumnsRenamed({"idx": "created_idx", "h": "start_h"}), ["symbol", "created_idx"])
    rows = rows.join(at.select("symbol", (F.col("idx") + 1).alias("free_idx"), (F.col("h") + 1).alias("free_h")), ["symbol", "free_idx"])
    return P.admitted(rows, [], "start_h", "free_h", 3, WEEK).select("id")


@R.add(
    f"""{facts.TRADES}, iv AS (
  SELECT r.id, o.symbol, min(e.break_idx) AS v FROM race r JOIN orders_ o USING (id) JOIN ev e ON e.symbol = o.symbol AND e.kind = 'CHOCH' AND e.dir = -o.dir
    AND e.break_idx > r.filled_idx AND e.break_idx <= r.filled_idx + {HOLD} GROUP BY ALL
), ends AS (
  SELECT r.*, iv.v, CASE WHEN r.filled_idx + {TIME_STOP} <= (SELECT max(idx) FROM bars b WHERE b.symbol = o.symbol) THEN r.filled_idx + {TIME_STOP} END AS q
  FROM race r JOIN orders_ o USING (id) LEFT JOIN iv USING (id)
)
SELECT id, coalesce(filled_idx, -1) AS filled_idx, CASE WHEN filled_idx IS NULL THEN coalesce(exit_idx, -1) ELSE coalesce(least(exit_idx, v, q), -1) END AS exit_idx,
  CASE WHEN filled_idx IS NULL THEN state WHEN state IN ('SL', 'TP') AND exit_idx <= coalesce(least(v, q), exit_idx) THEN state
    WHEN v IS NOT NULL AND v <= coalesce(least(exit_idx, q), v) THEN 'INVALIDATED' WHEN q IS NOT NULL AND q <= coalesce(exit_idx, q) THEN 'TIME_STOP' ELSE state END AS state FROM ends"""
)
def sim_all_ends(spark, d):
    bars, rows = facts._raced(spark, d)
    against = structure(spark, d)[2].where("kind = 'CHOCH'").select("symbol", F.col("break_idx").alias("idx"), F.col("dir").alias("side"))
    got = P.lives(rows, bars, against, HOLD, TIME_STOP)
    return got.select("id", F.coalesce("filled_idx", F.lit(-1)).alias("filled_idx"), F.coalesce("exit_idx", F.lit(-1)).alias("exit_idx"), "state")


@R.add(
    f"""{facts.TRADES}, w AS (
  SELECT o.*, b.idx, b.close, CASE WHEN dir = 1 THEN b.low <= stop ELSE b.high >= stop END AS s, b.idx > created_idx AND CASE WHEN dir = 1 THEN b.high >= target ELSE b.low <= target END AS t
  FROM orders_ o JOIN bars b ON b.symbol = o.symbol AND b.idx >= o.created_idx AND b.idx < o.created_idx + {HORIZON} WHERE entry <> stop
), e AS (
  SELECT id, dir, entry, stop, target, min(idx) FILTER (WHERE s) AS s1, min(idx) FILTER (WHERE t) AS t1, max(idx) AS last, arg_max(close, idx) AS close
  FROM w GROUP BY id, dir, entry, stop, target, created_idx HAVING count(*) = {HORIZON}
), k AS (SELECT *, CASE WHEN s1 <= coalesce(t1, s1) THEN 'SL' WHEN t1 IS NOT NULL THEN 'TP' ELSE 'TIME' END AS kind FROM e)
SELECT id, kind, CASE kind WHEN 'SL' THEN s1 WHEN 'TP' THEN t1 ELSE last END AS exit_idx,
  round((CASE kind WHEN 'SL' THEN stop WHEN 'TP' THEN target ELSE close END - entry) * dir / abs(entry - stop), 6) AS gross FROM k"""
)
def sim_target_walk(spark, d):
    bars, rows = facts._orders(spark, d)
    got = P.target_walks(rows.withColumnRenamed("created_idx", "idx"), bars, HORIZON)
    return got.select("id", "kind", "exit_idx", F.round("gross", 6).alias("gross"))


@R.add(
    f"""{facts.TRADES}, tr AS (
  SELECT o.symbol, o.dir * (x.px - o.entry) AS g, 0.0005::DOUBLE * (o.entry + x.px) AS c, abs(o.entry - o.stop) AS u, 0.0005::DOUBLE * (o.entry + o.stop) AS v
  FROM (SELECT r.id, CASE r.state WHEN 'SL' THEN o.stop WHEN 'TP' THEN o.target ELSE b.close END AS px FROM race r JOIN orders_ o USING (id)
    JOIN bars b ON b.symbol = o.symbol AND b.idx = r.exit_idx WHERE r.state IN ('SL', 'TP', 'TIMEOUT')) x JOIN orders_ o USING (id)
), fr AS (SELECT symbol, sum(g / u) > 0 AS gains FROM tr GROUP BY 1), it(symbol, k, lo, hi) AS (
  SELECT symbol, 0, 0.0::DOUBLE, 64.0::DOUBLE FROM fr WHERE gains UNION ALL
  SELECT symbol, k + 1, CASE WHEN total > 0 THEN mid ELSE lo END, CASE WHEN total > 0 THEN hi ELSE mid END
  FROM (SELECT i.symbol, i.k, i.lo, i.hi, (i.lo + i.hi) / 2 AS mid, (SELECT sum((g - (i.lo + i.hi) / 2 * c) / (u + (i.lo + i.hi) / 2 * v)) FROM tr t WHERE t.symbol = i.symbol) AS total FROM it i WHERE i.k < 30)
) SELECT fr.symbol, coalesce(round(it.lo, 4), -1) AS factor FROM fr LEFT JOIN it ON it.symbol = fr.symbol AND it.k = 30"""
)
def agg_break_even(spark, d):
    bars, rows = facts._raced(spark, d)
    done = rows.where(F.col("state").isin("SL", "TP", "TIMEOUT")).join(bars.select("symbol", F.col("idx").alias("exit_idx"), "close"), ["symbol", "exit_idx"])
    entry, stop = F.col("entry"), F.col("stop")
    out = F.when(F.col("state") == "SL", stop).when(F.col("state") == "TP", F.col("target")).otherwise(F.col("close"))
    trades = done.select(
        "symbol", (F.col("dir") * (out - entry)).alias("gross"), (0.0005 * (entry + out)).alias("cost"),
        F.abs(entry - stop).alias("unit"), (0.0005 * (entry + stop)).alias("risk_cost"),
    )
    return P.break_even(trades, "symbol").select("symbol", F.coalesce(F.round("factor", 4), F.lit(-1.0)).alias("factor"))


@R.add(
    f"""{STRUCTURE}, st AS (
  SELECT b.symbol, b.idx, floor(epoch(b.open_time) / 3600)::BIGINT AS hour, coalesce((SELECT arg_max(e.dir, e.break_idx) FROM ev e WHERE e.symbol = b.symbol AND e.break_idx <= b.idx), 0) AS slow,
    coalesce(sign(b.close - lag(b.close, 12) OVER (PARTITION BY b.symbol ORDER BY b.idx)), 0)::INT AS fast FROM bars b
), pr AS (SELECT *, lag(fast) OVER w AS fast0, lag(slow) OVER w AS slow0 FROM st WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
fp AS (SELECT p.symbol, p.idx, p.hour, (SELECT arg_max(x.hour, x.idx) FROM pr x WHERE x.symbol = p.symbol AND x.idx BETWEEN p.idx - {WITHIN} AND p.idx AND x.fast = p.slow AND x.fast0 <> p.slow) AS led
  FROM pr p WHERE p.slow <> 0 AND p.slow <> p.slow0),
fs AS (SELECT symbol, count(*) AS flips, count(*) FILTER (WHERE led IS NULL) AS unled, quantile_cont(hour - led, 0.25) AS q1, quantile_cont(hour - led, 0.5) AS half, quantile_cont(hour - led, 0.75) AS q3 FROM fp GROUP BY 1),
ag AS (SELECT symbol, count(*) FILTER (WHERE slow <> 0 AND fast <> 0) AS defined, avg((slow = fast)::INT) FILTER (WHERE slow <> 0 AND fast <> 0) AS share FROM st GROUP BY 1)
SELECT symbol, defined, coalesce(round(share, 6), -1) AS share, coalesce(flips, 0) AS flips, coalesce(unled, 0) AS unled, coalesce(round(q1, 4), -1) AS q1, coalesce(round(half, 4), -1) AS half, coalesce(round(q3, 4), -1) AS q3 FROM ag LEFT JOIN fs USING (symbol)"""
)
def agg_switch_delays(spark, d):
    bars, _, events = structure(spark, d)
    fast = F.coalesce(F.signum(F.col("close") - F.lag("close", 12).over(S.series())), F.lit(0.0)).cast("int")
    states = bars.select("symbol", "idx", F.floor(seconds("open_time") / 3600).alias("hour"), fast.alias("fast")).join(S.trend(bars, events).withColumnRenamed("trend", "slow"), ["symbol", "idx"])
    got = stats.switch_delays(states, WITHIN)
    return got.select("symbol", "defined", "flips", "unled", F.coalesce(F.round("share", 6), F.lit(-1.0)).alias("share"), *(F.coalesce(F.round(q, 4), F.lit(-1.0)).alias(q) for q in ("q1", "half", "q3")))


_ZONE = "symbol, dir, bottom, top, known_idx, born_idx"
ZONES = f"""blk AS (
  SELECT c.symbol, c.dir, x.low AS bottom, x.high AS top, c.break_idx, c.ob_idx, CASE WHEN c.dir = 1 THEN x.low2 > x.high ELSE x.high2 < x.low END AS has
  FROM cand c JOIN near x ON x.symbol = c.symbol AND x.idx = c.ob_idx JOIN bars k ON k.symbol = c.symbol AND k.idx = c.break_idx WHERE k.atr > 0
), swb AS (
  SELECT k.*, (SELECT arg_max(s.wick, s.idx) FROM sweeps s WHERE s.symbol = k.symbol AND s.dir = k.dir AND s.idx BETWEEN k.break_idx - 12 AND k.ob_idx) AS wick FROM blk k WHERE has
), xt AS (
  SELECT e.symbol, e.break_idx, e.dir, arg_max(b.idx, (CASE WHEN e.dir = 1 THEN -b.low ELSE b.high END, b.idx)) AS ob_idx
  FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.idx BETWEEN greatest(e.level_idx + 1, e.break_idx - {OPTIONS.ob_lookback}) AND e.break_idx - 1 GROUP BY ALL
), nb AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS c2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
kinds AS (
  SELECT 'block' AS kind, symbol, dir, bottom, top, break_idx AS known_idx, ob_idx AS born_idx, NULL AS wick FROM blk
  UNION ALL SELECT 'block_gap', symbol, dir, bottom, top, greatest(break_idx, ob_idx + 2), ob_idx, NULL FROM blk WHERE has
  UNION ALL SELECT 'block_gap_sweep', symbol, dir, bottom, top, greatest(break_idx, ob_idx + 2), ob_idx, wick FROM swb WHERE wick IS NOT NULL
  UNION ALL SELECT 'extreme', x.symbol, x.dir, o.low, o.high, x.break_idx, x.ob_idx, NULL FROM xt x JOIN bars o ON o.symbol = x.symbol AND o.idx = x.ob_idx JOIN bars k ON k.symbol = x.symbol AND k.idx = x.break_idx WHERE k.atr > 0
  UNION ALL SELECT 'gap', symbol, CASE WHEN low > h2 THEN 1 ELSE -1 END, CASE WHEN low > h2 THEN h2 ELSE high END, CASE WHEN low > h2 THEN low ELSE l2 END, idx, idx - 2, NULL FROM nb WHERE atr > 0 AND (low > h2 OR high < l2)
  UNION ALL SELECT 'candle_gap', symbol, CASE WHEN c2 < o2 THEN 1 ELSE -1 END, l2, h2, idx, idx - 2, NULL FROM nb WHERE atr > 0 AND ((c2 < o2 AND low > h2) OR (c2 > o2 AND high < l2))
)"""


@R.add(f"{STRUCTURE}, {OB}, {facts.SWEEPS}, {ZONES} SELECT kind, {_ZONE}, coalesce(wick, -1) AS wick FROM kinds")
def pat_zone_kinds(spark, d):
    bars, pivots, events = structure(spark, d)
    got = S.zone_kinds(bars, pivots, events, replace(OPTIONS, ob_require_fvg=False, ob_min_atr=0.0, fvg_min_atr=0.0), 12)
    return got.withColumn("wick", F.coalesce("wick", F.lit(-1.0)))


@R.add(
    f"""{setups.BASE}, {setups.PLANS}, {setups.EXEC}, {setups.CONFIRM}
SELECT id, (decided_k + 1) * 15 AS at_k, CASE outcome WHEN 'CONFIRM' THEN 'MARKET' ELSE 'REJECTED' END AS kind, CASE WHEN outcome <> 'CONFIRM' THEN outcome ELSE '' END AS reason,
  CASE WHEN outcome = 'CONFIRM' THEN price ELSE -1 END AS price FROM cfm WHERE outcome <> 'OPEN'
UNION ALL SELECT id, armed_k, 'LIMIT', '', edge FROM pl"""
)
def pat_order_moments(spark, d):
    """When an order exists: at the arming minute without confirmation, else at the close of the
    confirming bar, or a rejection; none while the window is open."""
    plans = setups._plans(spark, d)[2]
    confirmed = setups._confirmed(spark, d)[1]
    limits = O.order_moments(plans, None, 15).select("id", "at_k", "kind", "reason", "price")
    return limits.unionByName(O.order_moments(plans, confirmed, 15).select("id", "at_k", "kind", "reason", F.coalesce("price", F.lit(-1.0)).alias("price")))


@R.add(
    f"""{setups.BASE}, p AS (SELECT id, armed_k + 1 AS known_k, ceil((armed_k + 1) / 5.0)::BIGINT * 5 AS poll_k FROM marm WHERE armed_k IS NOT NULL)
SELECT id, poll_k, poll_k - known_k <= 3 AS fresh FROM p"""
)
def str_fresh_armings(spark, d):
    """At the first of the polls, five minutes apart, that sees an arming: is it three minutes old at most?"""
    armed = setups._armed(spark, d)[2].where("armed_k is not null")
    known = F.col("armed_k") + 1
    poll = F.ceil(known / 5) * 5
    return armed.select("id", poll.alias("poll_k"), (poll - known <= 3).alias("fresh"))


SIGNALS = f"""sg AS (
  SELECT o.id, 1 AS seq, 'CREATED' AS kind, o.created_idx AS at_idx FROM orders_ o
  UNION ALL SELECT id, 2, 'FILLED', filled_idx FROM race WHERE filled_idx IS NOT NULL
  UNION ALL SELECT id, 3, state, exit_idx FROM race WHERE exit_idx IS NOT NULL
)"""


@R.add(f"{facts.TRADES}, {SIGNALS} SELECT id, count(*) AS events, arg_max(kind, seq) AS state, max(at_idx) AS at_idx FROM sg GROUP BY id")
def snk_signal_events(spark, d):
    """Events are appended, those already stored only once; a signal's state is its latest event."""
    rows = facts._raced(spark, d)[1]
    events = rows.select("id", F.lit(1).alias("seq"), F.lit("CREATED").alias("kind"), F.col("created_idx").alias("at_idx"))
    events = events.unionByName(rows.where("filled_idx is not null").select("id", F.lit(2).alias("seq"), F.lit("FILLED").alias("kind"), F.col("filled_idx").alias("at_idx")))
    events = events.unionByName(rows.where("exit_idx is not null").select("id", F.lit(3).alias("seq"), F.col("state").alias("kind"), F.col("exit_idx").alias("at_idx")))
    path = shared_folder(spark, "signals")
    events.where("seq < 3").write.parquet(path)
    stored = spark.read.parquet(path).select("id", "seq")
    made_once(events.join(stored, ["id", "seq"], "left_anti"), "signals").write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("id").agg(F.count("*").alias("events"), F.max_by("kind", "seq").alias("state"), F.max("at_idx").alias("at_idx"))
