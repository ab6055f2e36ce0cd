"""Queries over market structure, setups and simulated trades on hourly bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions.grid import bucket, later, seconds
from tapeloom.operators import bars as B
from tapeloom.operators import simulate as M
from tapeloom.operators import structure as S
from tapeloom.operators.asof import asof
from tapeloom.operators.indicators import series
from tapeloom.operators.passage import first_passage, spans
from tapeloom.operators.persist import made_once
from tapeloom.plans.base import FVG, HOURS, OB, OPTIONS, STRUCTURE, TAPE, Registry, bars_sql, hours, minutes, structure, once_a_query
from tapeloom.sources.tape import table, tape

R = Registry()
LB = OPTIONS.lookback


def _id(*columns: str):
    return F.concat_ws(":", *columns)


def _rounded(df, *columns):
    return df.select(*(F.round(c, 4).alias(c) if c in columns else F.col(c) for c in df.columns))


@R.add(f"{STRUCTURE} SELECT symbol, kind, idx, price, confirmed_idx FROM swings")
def pat_swings(spark, d):
    return structure(spark, d)[1]


@R.add(f"{STRUCTURE} SELECT symbol, break_idx, dir, level, level_idx, kind FROM ev")
def pat_breaks(spark, d):
    return structure(spark, d)[2]


@R.add(
    f"""{STRUCTURE} SELECT b.symbol, b.idx, coalesce(last_value(e.dir IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.idx ROWS UNBOUNDED PRECEDING), 0) AS trend
FROM bars b LEFT JOIN ev e ON e.symbol = b.symbol AND e.break_idx = b.idx"""
)
def win_trend(spark, d):
    bars, _, events = structure(spark, d)
    return S.trend(bars, events)


@R.add(f"{STRUCTURE}, {FVG} SELECT * FROM fvg")
def win_fair_value_gaps(spark, d):
    return S.fair_value_gaps(structure(spark, d)[0], OPTIONS.fvg_min_atr)


@R.add(f"{STRUCTURE}, {OB} SELECT * FROM ob")
def pat_order_blocks(spark, d):
    bars, _, events = structure(spark, d)
    return S.order_blocks(bars, events, OPTIONS)


@R.add(
    f"""{STRUCTURE} SELECT e.symbol, e.break_idx, b.idx AS mid_idx, CASE WHEN e.dir = 1 THEN b.h0 ELSE b.h2 END AS bottom, CASE WHEN e.dir = 1 THEN b.l2 ELSE b.l0 END AS top
FROM ev e JOIN (SELECT symbol, idx, lag(high) OVER w AS h0, lag(low) OVER w AS l0, lead(high) OVER w AS h2, lead(low) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx)) b
ON b.symbol = e.symbol AND b.idx > e.level_idx AND b.idx < e.break_idx WHERE (e.dir = 1 AND b.l2 > b.h0) OR (e.dir = -1 AND b.h2 < b.l0)"""
)
def pat_leg_gaps(spark, d):
    bars, _, events = structure(spark, d)
    legs = events.select("symbol", F.col("break_idx").alias("id"), "dir", F.col("level_idx").alias("lo"), F.col("break_idx").alias("hi"))
    return S.leg_gaps(bars, legs).withColumnRenamed("id", "break_idx")


def _lifetimes_sql(zones: str, wick: bool) -> str:
    broken = (
        "CASE WHEN z.dir = 1 THEN b.low <= z.bottom ELSE b.high >= z.top END"
        if wick
        else "CASE WHEN z.dir = 1 THEN b.close < z.bottom ELSE b.close > z.top END"
    )
    return f"""SELECT z.symbol, z.dir, z.created_idx, z.bottom, z.top,
  coalesce(min(b.idx) FILTER (WHERE CASE WHEN z.dir = 1 THEN b.low <= z.top ELSE b.high >= z.bottom END OR {broken}), -1) AS tested_idx,
  coalesce(min(b.idx) FILTER (WHERE {broken}), -1) AS mitigated_idx
FROM {zones} z LEFT JOIN bars b ON b.symbol = z.symbol AND b.idx > z.created_idx AND b.idx <= z.created_idx + {LB} GROUP BY ALL"""


def _lifetimes(zones, bars, wick):
    lived = S.lifetimes(zones, bars, LB, wick)
    return lived.select(
        "symbol", "dir", "created_idx", "bottom", "top",
        F.coalesce("tested_idx", F.lit(-1)).alias("tested_idx"), F.coalesce("mitigated_idx", F.lit(-1)).alias("mitigated_idx"),
    )


@R.add(f"{STRUCTURE}, {FVG} {_lifetimes_sql('fvg', True)}")
def pat_gap_lifetimes(spark, d):
    bars = structure(spark, d)[0]
    return _lifetimes(S.fair_value_gaps(bars, OPTIONS.fvg_min_atr).withColumn("id", _id("symbol", "created_idx")), bars, True)


@R.add(f"{STRUCTURE}, {OB} {_lifetimes_sql('(SELECT DISTINCT symbol, dir, created_idx, bottom, top FROM ob)', False)}")
def pat_block_lifetimes(spark, d):
    bars, _, events = structure(spark, d)
    blocks = S.order_blocks(bars, events, OPTIONS).select("symbol", "dir", "created_idx", "bottom", "top").distinct()
    return _lifetimes(blocks.withColumn("id", _id("symbol", "dir", "created_idx", "bottom")), bars, False)


SWEEPS = f"""tk AS (
  SELECT s.symbol, CASE WHEN kind = 'LOW' THEN 1 ELSE -1 END AS dir, s.idx AS swing_idx, price, confirmed_idx,
         (SELECT min(b.idx) FROM bars b WHERE b.symbol = s.symbol AND b.idx > s.confirmed_idx AND b.idx <= s.idx + {LB}
            AND CASE WHEN s.kind = 'LOW' THEN b.low < s.price ELSE b.high > s.price END) AS taken_idx
  FROM swings s
), lv AS (
  SELECT symbol, dir, taken_idx AS idx, CASE WHEN dir = 1 THEN min(price) ELSE max(price) END AS level FROM tk WHERE taken_idx IS NOT NULL GROUP BY symbol, dir, taken_idx
), sweeps AS (
  SELECT l.symbol, l.idx, l.dir, l.level, CASE WHEN l.dir = 1 THEN b.low ELSE b.high END AS wick
  FROM lv l JOIN bars b ON b.symbol = l.symbol AND b.idx = l.idx
  WHERE CASE WHEN l.dir = 1 THEN b.close > l.level ELSE b.close < l.level END
    AND NOT EXISTS (SELECT 1 FROM tk p WHERE p.symbol = l.symbol AND p.dir = l.dir AND p.confirmed_idx < l.idx AND p.swing_idx >= l.idx - {LB}
      AND (p.taken_idx IS NULL OR p.taken_idx > l.idx)
      AND CASE WHEN l.dir = 1 THEN p.price >= l.level - coalesce({OPTIONS.eq_tol_atr} * b.atr, 0) ELSE p.price <= l.level + coalesce({OPTIONS.eq_tol_atr} * b.atr, 0) END)
)"""


@R.add(f"{STRUCTURE}, {SWEEPS} SELECT * FROM sweeps")
def pat_sweeps(spark, d):
    bars, pivots, _ = structure(spark, d)
    return S.sweeps(bars, pivots, LB, OPTIONS.eq_tol_atr)


SETUPS = f"""su AS (
  SELECT o.symbol, o.break_idx, o.dir, o.ob_idx, o.bottom, o.top, o.gap_bottom, o.gap_top, o.created_idx,
         (SELECT max(s.idx) FROM sweeps s WHERE s.symbol = o.symbol AND s.dir = o.dir AND s.idx <= o.ob_idx) AS sweep_idx
  FROM ob o
), setups AS (SELECT * FROM su WHERE sweep_idx >= break_idx - 24)"""


@once_a_query
def _setups(spark, d):
    """Blocks whose latest sweep of their side lies at most 24 bars before the break."""
    bars, pivots, events = structure(spark, d)
    blocks = S.order_blocks(bars, events, OPTIONS)
    swept = S.sweeps(bars, pivots, LB, OPTIONS.eq_tol_atr).select("symbol", F.col("dir").alias("side"), "idx")
    asks = blocks.withColumn("lo", F.col("break_idx") - 24).withColumn("hi", F.col("ob_idx"))
    latest = spans(asks, swept).where("side = dir").groupBy(*blocks.columns).agg(F.max("idx").alias("sweep_idx"))
    return bars, made_once(latest, "setups")


@R.add(f"{STRUCTURE}, {OB}, {SWEEPS}, {SETUPS} SELECT * FROM setups")
def pat_zone_setups(spark, d):
    return _setups(spark, d)[1]


ARMED = f"""armed AS (
  SELECT s.*, (SELECT min(b.idx) FROM bars b WHERE b.symbol = s.symbol AND b.idx > s.created_idx AND b.idx <= s.created_idx + {LB}
    AND CASE WHEN s.dir = 1 THEN b.low <= s.gap_top ELSE b.high >= s.gap_bottom END) AS armed_idx FROM setups s
)"""


@once_a_query
def _armed(spark, d):
    bars, found = _setups(spark, d)
    asks = found.withColumn("id", _id("symbol", "break_idx", "dir")).withColumn("lo", F.col("created_idx") + 1).withColumn("hi", F.col("created_idx") + LB)
    touched = F.when(F.col("a.dir") == 1, F.col("b.low") <= F.col("a.gap_top")).otherwise(F.col("b.high") >= F.col("a.gap_bottom"))
    return bars, first_passage(asks, bars, touched, "armed_idx").drop("lo", "hi")


@R.add(f"{STRUCTURE}, {OB}, {SWEEPS}, {SETUPS}, {ARMED} SELECT symbol, break_idx, dir, created_idx, coalesce(armed_idx, -1) AS armed_idx FROM armed")
def pat_arming(spark, d):
    return _armed(spark, d)[1].select("symbol", "break_idx", "dir", "created_idx", F.coalesce("armed_idx", F.lit(-1)).alias("armed_idx"))


# entry at the block's edge, stop beyond its far side, target 2 risk units away
PLANS = """plans AS (
  SELECT symbol || ':' || break_idx || ':' || dir AS id, symbol, dir, armed_idx AS created_idx,
         CASE WHEN dir = 1 THEN top ELSE bottom END AS entry, CASE WHEN dir = 1 THEN bottom - 0.1 * (top - bottom) ELSE top + 0.1 * (top - bottom) END AS stop,
         bottom, top
  FROM armed WHERE armed_idx IS NOT NULL
), orders_ AS (SELECT id, symbol, dir, created_idx, entry, stop, entry + 2 * (entry - stop) AS target FROM plans)"""


@once_a_query
def _orders(spark, d):
    bars, armed = _armed(spark, d)
    long = F.col("dir") == 1
    height = F.col("top") - F.col("bottom")
    rows = armed.where("armed_idx is not null").select(
        "id", "symbol", "dir", F.col("armed_idx").alias("created_idx"),
        F.when(long, F.col("top")).otherwise(F.col("bottom")).alias("entry"),
        F.when(long, F.col("bottom") - 0.1 * height).otherwise(F.col("top") + 0.1 * height).alias("stop"),
    )
    return bars, rows.withColumn("target", F.col("entry") + 2 * (F.col("entry") - F.col("stop")))


RACE = """fl AS (
  SELECT o.*, b.idx, CASE WHEN dir = 1 THEN b.low <= entry ELSE b.high >= entry END AS e, CASE WHEN dir = 1 THEN b.low <= stop ELSE b.high >= stop END AS s,
         CASE WHEN dir = 1 THEN b.high >= target ELSE b.low <= target END AS t
  FROM orders_ o JOIN bars b ON b.symbol = o.symbol AND b.idx BETWEEN o.created_idx AND o.created_idx + 72
), st AS (
  SELECT id, created_idx, min(idx) FILTER (WHERE e) AS f, min(idx) FILTER (WHERE t) AS m, min(idx) FILTER (WHERE idx >= created_idx + 24) AS x FROM fl GROUP BY ALL
), fi AS (SELECT *, CASE WHEN f <= coalesce(m, 1e12) AND f <= coalesce(x, 1e12) THEN f END AS filled_idx FROM st),
ex AS (
  SELECT fl.id, min(idx) FILTER (WHERE s) AS s1, min(idx) FILTER (WHERE t AND idx > filled_idx) AS t1, min(idx) FILTER (WHERE idx >= filled_idx + 48) AS o1
  FROM fl JOIN fi ON fi.id = fl.id AND idx >= filled_idx GROUP BY fl.id
), race AS (
  SELECT fi.id, filled_idx,
    CASE WHEN filled_idx IS NULL THEN CASE WHEN m <= coalesce(x, 1e12) THEN m ELSE x END
         ELSE nullif(least(coalesce(s1, 999999999), coalesce(t1, 999999999), coalesce(o1, 999999999)), 999999999) END AS exit_idx,
    CASE WHEN filled_idx IS NULL THEN CASE WHEN m <= coalesce(x, 1e12) THEN 'MISSED' WHEN x IS NOT NULL THEN 'EXPIRED' ELSE 'PENDING' END
         WHEN s1 IS NOT NULL AND s1 <= coalesce(t1, 1e12) AND s1 <= coalesce(o1, 1e12) THEN 'SL'
         WHEN t1 IS NOT NULL AND t1 <= coalesce(o1, 1e12) THEN 'TP' WHEN o1 IS NOT NULL THEN 'TIMEOUT' ELSE 'OPEN' END AS state
  FROM fi LEFT JOIN ex ON ex.id = fi.id
)"""
TRADES = f"{STRUCTURE}, {OB}, {SWEEPS}, {SETUPS}, {ARMED}, {PLANS}, {RACE}"


@once_a_query
def _raced(spark, d):
    bars, placed = _orders(spark, d)
    return bars, made_once(M.race(placed, bars, hold=48, expiry=24), "race")


@R.add(f"{TRADES} SELECT id, coalesce(filled_idx, -1) AS filled_idx, coalesce(exit_idx, -1) AS exit_idx, state FROM race")
def sim_order_race(spark, d):
    rows = _raced(spark, d)[1]
    return rows.select("id", F.coalesce("filled_idx", F.lit(-1)).alias("filled_idx"), F.coalesce("exit_idx", F.lit(-1)).alias("exit_idx"), "state")


NET = """, net AS (
  SELECT r.id, o.symbol, o.dir, r.filled_idx, r.exit_idx, r.state,
    (o.dir * (CASE r.state WHEN 'SL' THEN o.stop WHEN 'TP' THEN o.target ELSE b.close END - o.entry)
      - 0.001::DOUBLE * (o.entry + CASE r.state WHEN 'SL' THEN o.stop WHEN 'TP' THEN o.target ELSE b.close END))
    / (abs(o.entry - o.stop) + 0.001::DOUBLE * (o.entry + o.stop)) AS r
  FROM race r JOIN orders_ o USING (id) JOIN bars b ON b.symbol = o.symbol AND b.idx = r.exit_idx WHERE r.state IN ('SL', 'TP', 'TIMEOUT')
)"""


def _net(spark, d):
    bars, rows = _raced(spark, d)
    done = rows.where(F.col("state").isin("SL", "TP", "TIMEOUT"))
    at = bars.select("symbol", F.col("idx").alias("exit_idx"), "close")
    r = M.net_r(F.col("state"), F.col("dir"), F.col("entry"), F.col("stop"), F.col("target"), F.col("close"), 0.001)
    return done.join(at, ["symbol", "exit_idx"]).select("id", "symbol", "dir", "filled_idx", "exit_idx", "state", r.alias("r"))


@R.add(f"{TRADES}{NET} SELECT id, state, round(r, 6) AS r FROM net")
def sim_net_results(spark, d):
    return _net(spark, d).select("id", "state", F.round("r", 6).alias("r"))


@R.add(
    f"""{TRADES}{NET} SELECT symbol, count(*) AS n, count(*) FILTER (WHERE r > 0) AS wins, round(avg(r), 6) AS mean_r,
  count(*) FILTER (WHERE state = 'TP') AS targets, round(median(exit_idx - filled_idx), 2) AS median_hold FROM net GROUP BY symbol"""
)
def agg_event_summary(spark, d):
    return _net(spark, d).groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("wins"), F.round(F.avg("r"), 6).alias("mean_r"),
        F.count_if(F.col("state") == "TP").alias("targets"), F.round(F.median(F.col("exit_idx") - F.col("filled_idx")), 2).alias("median_hold"),
    )


@R.add(
    f"""{TRADES}{NET}, q AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY filled_idx, id) AS k FROM net), walk(symbol, k, id, taken, busy) AS (
  SELECT symbol, 0, '', false, -1 FROM (SELECT DISTINCT symbol FROM q) UNION ALL
  SELECT q.symbol, w.k + 1, q.id, q.filled_idx >= w.busy, CASE WHEN q.filled_idx >= w.busy THEN q.exit_idx ELSE w.busy END
  FROM walk w JOIN q ON q.symbol = w.symbol AND q.k = w.k + 1)
SELECT id, symbol FROM walk WHERE taken"""
)
def sim_one_position_a_market(spark, d):
    rows = _net(spark, d).select("id", "symbol", "filled_idx", "exit_idx")
    return M.one_at_a_time(rows, "symbol", "filled_idx", "exit_idx").select("id", "symbol")


@R.add(
    f"""{TRADES}{NET} SELECT n.id, floor(epoch(z.open_time) / 28800)::BIGINT - floor(epoch(a.open_time) / 28800)::BIGINT AS fundings FROM net n
JOIN bars a ON a.symbol = n.symbol AND a.idx = n.filled_idx JOIN bars z ON z.symbol = n.symbol AND z.idx = n.exit_idx"""
)
def sim_funding_times(spark, d):
    bars, _ = _raced(spark, d)
    at = bars.select("symbol", "idx", seconds("open_time").alias("s"))
    n = _net(spark, d)
    n = n.join(at.withColumnsRenamed({"idx": "filled_idx", "s": "filled_s"}), ["symbol", "filled_idx"])
    n = n.join(at.withColumnsRenamed({"idx": "exit_idx", "s": "closed_s"}), ["symbol", "exit_idx"])
    return n.select("id", M.funding(n, 8).cast("long").alias("fundings"))


@R.add(
    f"""{TRADES} SELECT id, round(floor(1000 * 0.01::DOUBLE / abs(entry - stop) / 0.00001::DOUBLE + 0.000000001::DOUBLE) * 0.00001::DOUBLE, 5) AS qty,
  round(1000 / (abs(entry - stop) + 0.005::DOUBLE * entry), 6) AS cap FROM orders_"""
)
def pat_position_size(spark, d):
    _, rows = _orders(spark, d)
    unit = F.abs(F.col("entry") - F.col("stop"))
    balance = F.lit(1000.0)
    return rows.select(
        "id", F.round(M.position_size(balance, 0.01, unit), 5).alias("qty"),
        F.round(M.liquidation_cap(balance, F.col("entry"), F.col("stop"), 0.005), 6).alias("cap"),
    )


OUTCOMES = """tc AS (SELECT id, symbol, dir, created_idx AS idx, entry, stop FROM orders_),
en AS (SELECT symbol, max(idx) AS last_idx FROM bars GROUP BY 1),
w0 AS (
  SELECT t.*, b.idx - t.idx AS o, abs(entry - stop) AS unit, CASE WHEN dir = 1 THEN b.low <= stop ELSE b.high >= stop END AS s,
    CASE WHEN dir = 1 THEN b.high - entry ELSE entry - b.low END AS g, CASE WHEN dir = 1 THEN entry - b.low ELSE b.high - entry END AS w, b.high, b.low
  FROM tc t JOIN en USING (symbol) JOIN bars b ON b.symbol = t.symbol AND b.idx >= t.idx AND b.idx < t.idx + 40 WHERE t.idx + 39 <= last_idx
), w1 AS (
  SELECT *, min(o) FILTER (WHERE s) OVER (PARTITION BY id) AS stop_at FROM w0
), w2 AS (
  SELECT id, unit, stop_at, max(w) AS worst, max(g) FILTER (WHERE stop_at IS NULL OR o < stop_at) AS best,
    min(o) FILTER (WHERE o > 0 AND g >= 0 AND CASE WHEN dir = 1 THEN high >= entry + dir * 1 * unit ELSE low <= entry + dir * 1 * unit END) AS t1,
    min(o) FILTER (WHERE o > 0 AND CASE WHEN dir = 1 THEN high >= entry + dir * 2 * unit ELSE low <= entry + dir * 2 * unit END) AS t2,
    min(o) FILTER (WHERE o > 0 AND CASE WHEN dir = 1 THEN high >= entry + dir * 3 * unit ELSE low <= entry + dir * 3 * unit END) AS t3
  FROM w1 GROUP BY ALL
)
SELECT id, coalesce(t1 < coalesce(stop_at, 40), false) AS hit1, coalesce(t2 < coalesce(stop_at, 40), false) AS hit2, coalesce(t3 < coalesce(stop_at, 40), false) AS hit3,
  round(greatest(0, coalesce(best, 0) / unit), 6) AS mfe, round(greatest(0, CASE WHEN stop_at IS NOT NULL THEN 1 ELSE worst / unit END), 6) AS mae,
  CASE WHEN t1 < coalesce(stop_at, 40) THEN t1 ELSE coalesce(stop_at, 40) END AS hold FROM w2"""


@R.add(f"{TRADES}, {OUTCOMES}")
def sim_touch_outcomes(spark, d):
    bars, rows = _orders(spark, d)
    return _rounded6(M.outcomes(rows.select("id", "symbol", "dir", F.col("created_idx").alias("idx"), "entry", "stop"), bars, 40))


def _rounded6(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@R.add(
    f"""WITH {TAPE}, {bars_sql('m', '1 minute')}, {HOURS}, c AS (SELECT symbol, open_time + INTERVAL 1 HOUR AS known, close AS hour_close FROM hours)
SELECT m.symbol, m.open_time, coalesce(c.hour_close, -1) AS hour_close FROM m ASOF LEFT JOIN c ON m.symbol = c.symbol AND m.open_time >= c.known"""
)
def jn_asof_last_closed(spark, d):
    known = hours(spark, d).select("symbol", later("open_time", 3600).alias("known"), F.col("close").alias("hour_close"))
    got = asof(minutes(spark, d).select("symbol", "open_time"), known, ["symbol"], "open_time", "known", ["hour_close"])
    return got.select("symbol", "open_time", F.coalesce("hour_close", F.lit(-1.0)).alias("hour_close"))


@R.add(
    f"""WITH {TAPE}, a AS (SELECT * FROM tape WHERE conn = 0), b AS (SELECT symbol, ts AS at, trade_id AS other FROM tape WHERE conn = 1)
SELECT a.trade_id, CASE WHEN epoch(a.ts)::BIGINT - 1800 <= epoch(b.at) THEN other ELSE -1 END AS other FROM a ASOF LEFT JOIN b ON a.symbol = b.symbol AND a.ts > b.at"""
)
def jn_asof_tolerance(spark, d):
    t = tape(spark, d)
    b = t.where("conn = 1").select("symbol", F.col("ts").alias("at"), F.col("trade_id").alias("other"))
    got = asof(t.where("conn = 0").select("symbol", "ts", "trade_id"), b, ["symbol"], "ts", "at", ["other"], strict=True)
    near = F.floor(F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6 + 0.5) - 1800 <= F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', at_asof)") / 1e6
    return got.select("trade_id", F.coalesce(F.when(near, F.col("other")), F.lit(-1)).alias("other"))


@R.add(
    f"""WITH {TAPE}, {HOURS}, p AS (SELECT symbol, open_time + INTERVAL 24 HOUR AS at, close AS ref FROM hours)
SELECT h.symbol, h.idx, coalesce(sign(h.close - p.ref), 0)::INT AS m1 FROM hours h ASOF LEFT JOIN p ON h.symbol = p.symbol AND h.open_time >= p.at"""
)
def win_day_return_sign(spark, d):
    h = hours(spark, d)
    p = h.select("symbol", later("open_time", 86400).alias("at"), F.col("close").alias("ref"))
    got = asof(h.select("symbol", "idx", "open_time", "close"), p, ["symbol"], "open_time", "at", ["ref"])
    return got.select("symbol", "idx", F.coalesce(F.signum(F.col("close") - F.col("ref")), F.lit(0.0)).cast("int").alias("m1"))


@R.add(
    f"""{STRUCTURE} SELECT s.symbol, s.idx, s.kind, coalesce(min(b.idx), -1) AS passed_idx FROM swings s LEFT JOIN bars b ON b.symbol = s.symbol
AND b.idx > s.confirmed_idx AND b.idx <= s.confirmed_idx + 200 AND CASE WHEN s.kind = 'HIGH' THEN b.close > s.price ELSE b.close < s.price END GROUP BY ALL"""
)
def jn_first_passage(spark, d):
    bars, pivots, _ = structure(spark, d)
    asks = pivots.withColumn("id", _id("symbol", "kind", "idx")).withColumn("lo", F.col("confirmed_idx") + 1).withColumn("hi", F.col("confirmed_idx") + 200)
    passed = F.when(F.col("a.kind") == "HIGH", F.col("b.close") > F.col("a.price")).otherwise(F.col("b.close") < F.col("a.price"))
    return first_passage(asks, bars, passed, "passed_idx").select("symbol", "idx", "kind", F.coalesce("passed_idx", F.lit(-1)).alias("passed_idx"))


@R.add(
    f"""WITH {TAPE}, {HOURS}, p AS (SELECT *, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM hours WINDOW w AS (PARTITION BY symbol ORDER BY idx))
SELECT symbol, idx, CASE WHEN low < pl THEN 1 ELSE -1 END AS dir, CASE WHEN low < pl THEN pl ELSE ph END AS level FROM p
WHERE ((low < pl AND high <= ph) OR (high > ph AND low >= pl)) AND close BETWEEN pl AND ph"""
)
def pat_candle_range(spark, d):
    w = series()
    p = hours(spark, d).withColumn("ph", F.lag("high").over(w)).withColumn("pl", F.lag("low").over(w))
    down, up = F.col("low") < F.col("pl"), F.col("high") > F.col("ph")
    one = (down & ~up) | (up & ~down)
    return p.where(one & F.col("close").between(F.col("pl"), F.col("ph"))).select(
        "symbol", "idx", F.when(down, 1).otherwise(-1).alias("dir"), F.when(down, F.col("pl")).otherwise(F.col("ph")).alias("level")
    )


@R.add(
    f"""{STRUCTURE}, {FVG} SELECT z.symbol, z.created_idx, -z.dir AS dir, min(b.idx) AS idx FROM fvg z JOIN bars b ON b.symbol = z.symbol AND b.idx > z.created_idx
AND b.idx <= z.created_idx + {LB} AND CASE WHEN z.dir = 1 THEN b.close < z.bottom ELSE b.close > z.top END GROUP BY ALL"""
)
def pat_inverted_gaps(spark, d):
    bars = structure(spark, d)[0]
    asks = S.fair_value_gaps(bars, OPTIONS.fvg_min_atr).withColumn("id", _id("symbol", "created_idx"))
    asks = asks.withColumn("lo", F.col("created_idx") + 1).withColumn("hi", F.col("created_idx") + LB)
    through = F.when(F.col("a.dir") == 1, F.col("b.close") < F.col("a.bottom")).otherwise(F.col("b.close") > F.col("a.top"))
    got = first_passage(asks, bars, through, "at")
    return got.where(F.col("at").isNotNull()).select("symbol", "created_idx", (-F.col("dir")).alias("dir"), F.col("at").alias("idx"))


@R.add(
    f"""{STRUCTURE}, {FVG}, {OB} SELECT o.symbol, o.break_idx, f.created_idx FROM (SELECT DISTINCT symbol, break_idx, dir, bottom, top FROM ob) o JOIN fvg f
ON f.symbol = o.symbol AND f.dir = o.dir AND f.created_idx BETWEEN o.break_idx - 10 AND o.break_idx + 10 AND o.bottom <= f.top AND f.bottom <= o.top"""
)
def prj_zone_overlap(spark, d):
    bars, _, events = structure(spark, d)
    o = S.order_blocks(bars, events, OPTIONS).select("symbol", "break_idx", "dir", "bottom", "top").distinct()
    asks = o.withColumn("lo", F.col("break_idx") - 10).withColumn("hi", F.col("break_idx") + 10)
    gaps = S.fair_value_gaps(bars, OPTIONS.fvg_min_atr).select("symbol", F.col("created_idx").alias("idx"), F.col("dir").alias("side"), F.col("bottom").alias("low"), F.col("top").alias("high"))
    met = spans(asks, gaps).where("side = dir and bottom <= high and low <= top")
    return met.select("symbol", "break_idx", F.col("idx").alias("created_idx"))


@R.add(
    f"""{STRUCTURE}, l AS (SELECT symbol, kind, max(idx) AS idx FROM swings GROUP BY 1, 2),
p AS (SELECT s.* FROM swings s JOIN l USING (symbol, kind, idx))
SELECT symbol, max(price) FILTER (WHERE kind = 'HIGH') AS high, max(price) FILTER (WHERE kind = 'LOW') AS low,
  round((max(price) FILTER (WHERE kind = 'HIGH') + max(price) FILTER (WHERE kind = 'LOW')) / 2, 4) AS mid FROM p GROUP BY symbol"""
)
def win_dealing_range(spark, d):
    latest = structure(spark, d)[1].groupBy("symbol").pivot("kind", ["HIGH", "LOW"]).agg(F.max_by("price", "idx"))
    return latest.select("symbol", F.col("HIGH").alias("high"), F.col("LOW").alias("low"), F.round((F.col("HIGH") + F.col("LOW")) / 2, 4).alias("mid"))


@R.add(
    f"""{STRUCTURE}, z AS (SELECT symbol, max_by(close, idx) AS last FROM bars GROUP BY 1), r AS (
  SELECT s.symbol, s.kind, s.idx, s.price, row_number() OVER (PARTITION BY s.symbol, s.kind ORDER BY abs(s.price - z.last), s.idx) AS r FROM swings s JOIN z USING (symbol)
  WHERE CASE WHEN kind = 'HIGH' THEN price > last ELSE price < last END) SELECT symbol, kind, idx, price, r FROM r WHERE r <= 3"""
)
def win_nearest_levels(spark, d):
    bars, pivots, _ = structure(spark, d)
    last = F.broadcast(bars.groupBy("symbol").agg(F.max_by("close", "idx").alias("last")))
    ahead = F.when(F.col("kind") == "HIGH", F.col("price") > F.col("last")).otherwise(F.col("price") < F.col("last"))
    w = Window.partitionBy("symbol", "kind").orderBy(F.abs(F.col("price") - F.col("last")), "idx")
    ranked = pivots.join(last, "symbol").where(ahead).withColumn("r", F.row_number().over(w)).where("r <= 3")
    return ranked.select("symbol", "kind", "idx", "price", "r")


@R.add(
    f"""{STRUCTURE}, {FVG}, k AS (SELECT unnest([100, 300, 500]) AS bar)
SELECT bar, count(*) AS valid, round(avg(top - bottom), 4) AS height FROM fvg z, k WHERE z.created_idx <= bar AND bar <= z.created_idx + {LB}
AND NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = z.symbol AND b.idx > z.created_idx AND b.idx <= bar AND CASE WHEN z.dir = 1 THEN b.low <= z.bottom ELSE b.high >= z.top END)
GROUP BY bar"""
)
def prj_valid_zones_at(spark, d):
    bars = structure(spark, d)[0]
    z = S.lifetimes(S.fair_value_gaps(bars, OPTIONS.fvg_min_atr).withColumn("id", _id("symbol", "created_idx")), bars, LB, True)
    at = F.explode(F.array(*(F.lit(k) for k in (100, 300, 500))))
    valid = (F.col("created_idx") <= F.col("bar")) & (F.col("bar") <= F.col("created_idx") + LB) & (F.col("mitigated_idx").isNull() | (F.col("mitigated_idx") > F.col("bar")))
    return z.withColumn("bar", at).where(valid).groupBy("bar").agg(F.count("*").alias("valid"), F.round(F.avg(F.col("top") - F.col("bottom")), 4).alias("height"))


@R.add(
    f"""{TRADES}{NET}, v AS (SELECT r, unnest(list_filter([CASE WHEN dir = 1 THEN 'long' ELSE 'short' END, CASE WHEN state = 'TIMEOUT' THEN 'slow' END, CASE WHEN exit_idx - filled_idx <= 6 THEN 'fast' END, 'all'], lambda x: x IS NOT NULL)) AS variant FROM net)
SELECT variant, count(*) AS n, round(avg(r), 6) AS mean_r FROM v GROUP BY variant"""
)
def pat_variant_tags(spark, d):
    tags = F.array_compact(
        F.array(
            F.when(F.col("dir") == 1, "long").otherwise("short"), F.when(F.col("state") == "TIMEOUT", "slow"),
            F.when(F.col("exit_idx") - F.col("filled_idx") <= 6, "fast"), F.lit("all"),
        )
    )
    v = _net(spark, d).select("r", F.explode(tags).alias("variant"))
    return v.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("r"), 6).alias("mean_r"))
