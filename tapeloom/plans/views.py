"""Queries of sources, sinks, state columns, repair rules and operational views."""

from __future__ import annotations

import datetime
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions.grid import later, seconds
from tapeloom.operators import bars as B
from tapeloom.operators import structure as S
from tapeloom.operators import views as V
from tapeloom.operators.indicators import series
from tapeloom.operators.intervals import union_of
from tapeloom.operators.persist import shared_folder
from tapeloom.plans.base import FVG, HOURS, OPTIONS, STRUCTURE, TAPE, Registry, bars_sql, hours, minutes, structure
from tapeloom.sources.tape import table, tape

R = Registry()
_BOTH = f"WITH {TAPE}, {bars_sql('live', '1 minute', where='WHERE conn <> 0')}, {bars_sql('hist', '1 minute')}"


def _messages(spark, d):
    """Feed messages as text: trades, pings, trades of another channel, and cut ones."""
    e = table(spark, d, "events").select(
        "event_id", F.expr("case when user_id % 10 = 0 then 'ping' else 'trade' end").alias("e"), F.col("event_type").alias("s"),
        F.col("event_id").alias("t"), F.col("value").cast("string").alias("p"), "user_id",
    )
    whole = e.withColumn("raw", F.to_json(F.struct("e", "s", "t", "p")))
    return whole.select("event_id", F.expr("if(user_id % 7 = 0, substr(raw, 1, length(raw) - 5), raw)").alias("raw"))


@R.add("SELECT event_id AS trade_id, event_type AS symbol, value AS px FROM events WHERE user_id % 10 <> 0 AND user_id % 7 <> 0 AND event_type IN ('click', 'view') AND value > 0")
def src_trade_messages(spark, d):
    return V.parse_trades(_messages(spark, d), ["click", "view"]).select("trade_id", "symbol", "px")


@R.add(
    f"""WITH {TAPE}, {HOURS}, b AS (SELECT *, CASE WHEN volume < 40 THEN 0 ELSE volume END AS v, date_trunc('day', open_time) AS day FROM hours),
c AS (SELECT *, low <= least(open, close) AND high >= greatest(open, close) AND (v > 0 OR (high = low AND open = close)) AS valid FROM b),
g AS (SELECT *, bool_and(valid) OVER (PARTITION BY symbol, day) AS whole FROM c)
SELECT symbol, open_time, v AS volume, v = 0 AS synthetic, CASE WHEN v = 0 THEN 0 ELSE -1 END AS n FROM g WHERE whole"""
)
def src_chart_bars(spark, d):
    """A day's batch with one malformed bar is rejected whole; a bar without volume must be flat."""
    b = hours(spark, d).withColumn("volume", F.when(F.col("volume") < 40, F.lit(0.0)).otherwise(F.col("volume").cast("double")))
    got = V.valid_batches(b.withColumn("day", F.date_trunc("day", F.col("open_time"))), ["symbol", "day"])
    return got.select("symbol", "open_time", "volume", "synthetic", F.coalesce("n", F.lit(-1)).alias("n"))


@R.add(
    f"""WITH {TAPE}, {bars_sql('m', '1 minute', where='WHERE trade_id % 5 <> 0')}, r AS (SELECT symbol, max(open_time) + INTERVAL 1 MINUTE AS resume_at FROM m WHERE open_time < TIMESTAMP '2024-01-25' GROUP BY 1)
SELECT t.symbol, t.trade_id, t.ts FROM tape t JOIN r USING (symbol) WHERE t.ts >= r.resume_at AND t.conn IN (1, 2) AND t.trade_id % 11 <> 0"""
)
def src_resume_trades(spark, d):
    """Trades stored since the end of each market's last final minute: of the two live sources, and
    not marked as a duplicate."""
    t = tape(spark, d)
    stored = t.withColumn("source", F.when(F.col("trade_id") % 11 == 0, F.concat(F.lit("DUPLICATE_OF:"), "conn")).otherwise(F.concat(F.lit("WS"), "conn")))
    done = B.bars_of_trades(t.where("trade_id % 5 <> 0"), "1m").where(F.col("open_time") < F.lit("2024-01-25").cast("timestamp_ntz"))
    return V.since_resume(stored, done, ["WS1", "WS2"]).select("symbol", "trade_id", "ts")


@R.add("SELECT o_orderpriority AS symbol, count(*) AS n FROM orders WHERE o_totalprice >= 150000 AND o_orderdate >= DATE '1995-01-01' GROUP BY 1")
def src_parameterised_sql(spark, d):
    return spark.sql(
        "SELECT o_orderpriority AS symbol, count(*) AS n FROM {orders} WHERE o_totalprice >= :least AND o_orderdate >= :since GROUP BY 1",
        args={"least": 150000, "since": datetime.date(1995, 1, 1)}, orders=table(spark, d, "orders"),
    )


@R.add(f"{_BOTH} SELECT symbol, open_time, close, 'stored' AS origin FROM live UNION ALL SELECT symbol, open_time, close, 'added' FROM hist h WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.symbol = h.symbol AND l.open_time = h.open_time)")
def snk_appended_table(spark, d):
    """The target is written, the new rows are appended twice, and nothing is there twice."""
    path = shared_folder(spark, "candles")
    minutes(spark, d, "live").select("symbol", "open_time", "close", F.lit("stored").alias("origin")).write.parquet(path)
    fresh = minutes(spark, d).select("symbol", "open_time", "close", F.lit("added").alias("origin"))
    for _ in range(2):
        V.append_new(spark, path, fresh, ["symbol", "open_time"])
    return spark.read.parquet(path)


@R.add(
    """SELECT user_id AS runner, max(ts) AS at, count(*) AS beats, max_by(event_type, ts) FILTER (WHERE event_type IN ('click', 'view')) AS phase,
  max_by(event_id, ts) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1"""
)
def snk_heartbeat(spark, d):
    """Heartbeats hold some keys each; the stored status is their merge, later values first."""
    e = table(spark, d, "events")
    text = F.when(F.col("event_type") == "error", F.map_from_arrays(F.array(F.lit("error")), F.array(F.col("event_id").cast("string"))))
    text = text.when(F.col("event_type").isin("click", "view"), F.map_from_arrays(F.array(F.lit("phase")), F.array("event_type")))
    got = V.merged_status(e.select(F.col("user_id").alias("runner"), "ts", text.alias("status")), "runner", "ts", "status")
    return got.select("runner", "at", "beats", F.col("status")["phase"].alias("phase"), F.col("status")["error"].cast("long").alias("error"))


@R.add(
    f"""{STRUCTURE}, {FVG}, z AS (SELECT f.*, min(b.idx) FILTER (WHERE CASE WHEN f.dir = 1 THEN b.low <= f.top ELSE b.high >= f.bottom END) AS t,
  min(b.idx) FILTER (WHERE CASE WHEN f.dir = 1 THEN b.low <= f.bottom ELSE b.high >= f.top END) AS m
  FROM fvg f LEFT JOIN bars b ON b.symbol = f.symbol AND b.idx > f.created_idx AND b.idx <= f.created_idx + {OPTIONS.lookback} GROUP BY ALL),
e AS (SELECT symbol, max(idx) AS last FROM bars GROUP BY 1)
SELECT z.symbol, created_idx, dir, CASE WHEN m IS NOT NULL THEN 'MITIGATED' WHEN created_idx + {OPTIONS.lookback} < last THEN 'EXPIRED' WHEN t IS NOT NULL THEN 'TESTED' ELSE 'FRESH' END AS status,
  coalesce(m, CASE WHEN created_idx + {OPTIONS.lookback} < last THEN created_idx + {OPTIONS.lookback} ELSE last END) AS end_idx FROM z JOIN e USING (symbol)"""
)
def prj_zone_status(spark, d):
    bars = structure(spark, d)[0]
    zones = S.fair_value_gaps(bars, OPTIONS.fvg_min_atr).withColumn("id", F.concat_ws(":", "symbol", "created_idx"))
    last = F.broadcast(bars.groupBy("symbol").agg(F.max("idx").alias("last")))
    status, end = V.zone_status(OPTIONS.lookback)
    return S.lifetimes(zones, bars, OPTIONS.lookback, True).join(last, "symbol").select("symbol", "created_idx", "dir", status.alias("status"), end.alias("end_idx"))


@R.add(
    f"""{STRUCTURE}, {FVG}, n AS (SELECT symbol, max(idx) AS idx FROM bars GROUP BY 1), f AS (SELECT b.symbol, b.idx AS now, b.high, b.low FROM bars b JOIN n USING (symbol, idx))
SELECT v.symbol, v.created_idx, CASE WHEN v.dir = 1 AND low <= bottom OR v.dir = -1 AND high >= top THEN 'FILLED' WHEN v.dir = 1 AND low <= top OR v.dir = -1 AND high >= bottom THEN 'TOUCHED' ELSE 'UNTOUCHED' END AS live
FROM fvg v JOIN f USING (symbol) WHERE v.created_idx < now"""
)
def prj_live_zone_state(spark, d):
    """What the forming bar's range does to each zone."""
    bars = structure(spark, d)[0]
    now = F.broadcast(bars.groupBy("symbol").agg(F.max_by(F.struct(F.col("idx").alias("now"), "high", "low"), "idx").alias("f")).select("symbol", "f.*"))
    zones = S.fair_value_gaps(bars, OPTIONS.fvg_min_atr).join(now, "symbol").where("created_idx < now")
    return zones.select("symbol", "created_idx", V.live_state().alias("live"))


@R.add(
    """WITH s AS (SELECT user_id AS seq, event_type AS symbol, count(*) AS n, count(DISTINCT floor(value)) AS prices, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY ALL)
SELECT seq, symbol, n, CASE WHEN n = 1 THEN 'SINGLE' WHEN days > 1 THEN 'TIMESTAMP_CONFLICT' WHEN prices > 1 THEN 'MULTI_FILL' ELSE 'REPEATED' END AS class FROM s"""
)
def str_sequence_conflicts(spark, d):
    """Trades that share a sequence number: fills at several prices, or different times."""
    e = table(spark, d, "events").select(F.col("user_id").alias("seq"), F.col("event_type").alias("symbol"), F.floor("value").alias("price"), F.date_trunc("day", F.col("ts")).alias("at"))
    return V.sequence_classes(e, ["seq", "symbol"], "price", "at")


@R.add("SELECT event_type AS symbol, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT user_id % 3) AS conns FROM events GROUP BY 1")
def agg_distinct_counts(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.col("user_id") % 3).alias("conns"))


@R.add(
    f"""WITH {TAPE}, {HOURS}, s AS (SELECT symbol, max(open_time) - INTERVAL 48 HOUR AS since FROM hours GROUP BY 1)
SELECT h.symbol, max(high) AS high, min(low) AS low, count(*) AS bars FROM hours h JOIN s USING (symbol) WHERE h.open_time >= s.since GROUP BY 1"""
)
def agg_range_extremes(spark, d):
    h = hours(spark, d)
    since = h.groupBy("symbol").agg(later(F.max("open_time"), -48 * 3600).alias("since"))
    return V.extremes_since(h, since)


@R.add(
    """WITH r AS (SELECT l_returnflag AS g, list(l_extendedprice ORDER BY l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT g, v[least(len(v) - 1, floor(0.9::DOUBLE * (len(v) - 1)))::BIGINT + 1] AS inner_p90, v[least(len(v) - 1, floor(0.9::DOUBLE * len(v)))::BIGINT + 1] AS outer_p90 FROM r"""
)
def agg_nearest_rank(spark, d):
    """Both index rules: int(p * (n - 1)) and int(p * n), clipped; ranks are counted, not gathered."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"))
    return V.nearest_ranks(rows, "g", "v", 0.9)


@R.add(
    f"""WITH {TAPE}, t AS (SELECT *, trade_id % 7 = 0 AS again FROM tape), {bars_sql('m', '1 minute', 't')} SELECT symbol, open_time, open, high, low, close, volume, n FROM m"""
)
def agg_minutes_of_deliveries(spark, d):
    """Every seventh trade is delivered twice, the second time by another connection."""
    t = tape(spark, d).select("symbol", "ts", "trade_id", "px", "qty").withColumn("recv", F.lit(0))
    every = t.unionByName(t.where("trade_id % 7 = 0").withColumn("recv", F.lit(1)))
    return B.bars_of_trades(B.delivered_once(every), "1m")


@R.add(
    f"""{STRUCTURE} SELECT e.symbol, e.break_idx, e.dir, CASE WHEN e.dir = 1 THEN max_by(b.idx, (-b.low, b.idx)) ELSE max_by(b.idx, (b.high, b.idx)) END AS ob_idx
FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.idx BETWEEN greatest(e.level_idx + 1, e.break_idx - {OPTIONS.ob_lookback}) AND e.break_idx - 1 GROUP BY e.symbol, e.break_idx, e.dir"""
)
def win_extreme_candle(spark, d):
    """The extreme candle between level and break, the latest on ties."""
    bars, _, events = structure(spark, d)
    rule = replace(OPTIONS, ob_rule="extreme", ob_min_atr=0.0, ob_require_fvg=False)
    return S.order_blocks(bars, events, rule).select("symbol", "break_idx", "dir", "ob_idx")


@R.add(
    f"""{STRUCTURE} SELECT e.symbol, e.break_idx, e.dir, max(b.high) AS high, min(b.low) AS low FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.idx >= e.level_idx AND b.idx < e.break_idx GROUP BY ALL"""
)
def win_range_extremes(spark, d):
    """Highest high and lowest low of the bars [level, break) of each break."""
    bars, _, events = structure(spark, d)
    spans = events.select("symbol", F.concat_ws(":", "symbol", "break_idx", "dir").alias("id"), "break_idx", "dir", F.col("level_idx").alias("lo"), (F.col("break_idx") - 1).alias("hi"))
    return V.range_extremes(spans, bars).select("symbol", "break_idx", "dir", "high", "low")


@R.add(
    f"""{STRUCTURE}, sw AS (SELECT symbol, break_idx, dir FROM (SELECT *, lag(dir) OVER (PARTITION BY symbol ORDER BY break_idx) AS p FROM ev) WHERE p IS NULL OR p <> dir),
fl AS (SELECT symbol, idx, s FROM (SELECT symbol, idx, sign(close - open) AS s, lag(sign(close - open)) OVER (PARTITION BY symbol ORDER BY idx) AS p FROM bars) WHERE s <> 0 AND (p IS NULL OR p <> s))
SELECT f.symbol, f.idx, f.idx - max(w.break_idx) AS lag FROM fl f JOIN sw w ON w.symbol = f.symbol AND w.dir = f.s AND w.break_idx <= f.idx AND w.break_idx > f.idx - 120 GROUP BY f.symbol, f.idx"""
)
def win_switch_lag(spark, d):
    """Bars from the last trend switch (at most 120 back) to a candle flip of the same sign."""
    bars, _, events = structure(spark, d)
    switched = events.where(F.col("kind").isNotNull()).withColumn("p", F.lag("dir").over(Window.partitionBy("symbol").orderBy("break_idx"))).where("p is null or p <> dir")
    sign = F.signum(F.col("close") - F.col("open")).cast("int")
    flips = bars.withColumn("s", sign).withColumn("p", F.lag("s").over(series())).where("s <> 0 and (p is null or p <> s)")
    return V.switch_lag(flips.select("symbol", "idx", "s"), switched.select("symbol", F.col("break_idx").alias("idx"), F.col("dir").alias("s")), 120)


@R.add(
    f"""WITH {TAPE}, s AS (SELECT symbol, time_bucket(INTERVAL '20 minutes', ts) AS a FROM tape WHERE conn <> 0 GROUP BY ALL), sp AS (SELECT symbol, a, a + INTERVAL 20 MINUTE AS b FROM s),
r AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY symbol ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS g FROM sp),
u AS (SELECT symbol, min(a) AS a, max(b) AS b FROM (SELECT *, sum(g) OVER (PARTITION BY symbol ORDER BY a ROWS UNBOUNDED PRECEDING) AS i FROM r) GROUP BY symbol, i),
{bars_sql('m', '1 minute')}
SELECT m.symbol, m.open_time, EXISTS (SELECT 1 FROM u WHERE u.symbol = m.symbol AND u.a <= m.open_time AND u.b >= m.open_time + INTERVAL 1 MINUTE) AS covered FROM m"""
)
def jn_interval_containment(spark, d):
    """Is a minute wholly inside one span of coverage?"""
    t = tape(spark, d).where("conn <> 0")
    start = F.window("ts", "1200 seconds")["start"]
    spans = union_of(t.select("symbol", start.alias("a")).distinct().withColumn("b", later(F.col("a"), 1200)), ["symbol"], "a", "b")
    return V.covered(minutes(spark, d).select("symbol", "open_time"), spans, 60)


@R.add(
    f"""{_BOTH}, o AS (SELECT h.symbol, count(*) AS compared, count(*) FILTER (WHERE l.close = h.close) AS exact, max(abs(l.high - h.high) / h.high) AS hi, max(abs(l.low - h.low) / h.low) AS lo
  FROM hist h JOIN live l USING (symbol, open_time) GROUP BY 1)
SELECT symbol, compared, exact, CASE WHEN compared < 5 THEN 'TOO_FEW' WHEN exact * 5 < compared * 4 THEN 'INEXACT' WHEN greatest(hi, lo) > 0.001 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS verdict FROM o"""
)
def str_history_verdict(spark, d):
    """May history repair a gap? At least 5 shared minutes, 80 % exact, highs and lows within 0.1 %."""
    return V.history_verdict(minutes(spark, d, "live"), minutes(spark, d))


@R.add(
    f"""WITH {TAPE}, {bars_sql('m', '1 minute')}, n AS (SELECT *, lead(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS nxt FROM m), g AS (SELECT *, (epoch(nxt) - epoch(open_time))::BIGINT // 60 - 1 AS missing FROM n)
SELECT symbol, open_time, 'BAR' AS kind, close, 1::BIGINT AS size FROM g
UNION ALL SELECT symbol, open_time + to_minutes(i), 'SYNTHETIC', close, 1 FROM g, range(1, 3) t(i) WHERE missing BETWEEN 1 AND 2 AND i <= missing
UNION ALL SELECT symbol, open_time + INTERVAL 1 MINUTE, 'GAP', close, missing FROM g WHERE missing > 2"""
)
def str_bootstrap_plan(spark, d):
    """Chart bars, holes of up to two minutes filled with flat bars, longer ones as gaps."""
    return V.bootstrap_plan(minutes(spark, d), 2)


@R.add(
    """WITH e AS (SELECT user_id AS collector, max(ts) AS seen, max_by(event_type, (ts, event_id)) AS last, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT collector, seen, errors, CASE WHEN seen < now - INTERVAL 24 HOUR THEN 'DOWN' WHEN last = 'error' THEN 'FAILING' WHEN seen < now - INTERVAL 6 HOUR THEN 'LAGGING' ELSE 'HEALTHY' END AS status FROM e, n"""
)
def vw_collector_health(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("collector"), "ts", "event_id", F.col("event_type").alias("state"))
    return V.health(e, failing="error", lagging=6 * 3600, down=24 * 3600)


@R.add(
    f"""WITH {TAPE}, g AS (SELECT symbol, ts, epoch(ts) AS e, lag(epoch(ts)) OVER (PARTITION BY symbol ORDER BY ts, trade_id) AS p FROM tape), d AS (SELECT symbol, (e::BIGINT - p::BIGINT) AS s FROM (SELECT symbol, floor(e) AS e, floor(p) AS p FROM g))
SELECT symbol, count(*) FILTER (WHERE s >= 60) AS gaps, coalesce(sum(s) FILTER (WHERE s >= 60), 0)::BIGINT AS gap_seconds, max(s) AS longest FROM d WHERE s IS NOT NULL GROUP BY 1"""
)
def vw_gap_diagnostics(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts", "trade_id")
    s = tape(spark, d).select("symbol", (seconds("ts") - F.lag(seconds("ts")).over(w)).alias("s")).where("s is not null")
    return s.groupBy("symbol").agg(F.count_if(F.col("s") >= 60).alias("gaps"), F.coalesce(F.sum(F.when(F.col("s") >= 60, F.col("s"))), F.lit(0)).alias("gap_seconds"), F.max("s").alias("longest"))


@R.add(
    f"""{_BOTH}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS before FROM hist)
SELECT l.symbol, count(*) AS n, count(*) FILTER (WHERE l.open = p.open) AS open_raw, count(*) FILTER (WHERE l.open = coalesce(p.before, p.open)) AS open_joined,
  count(*) FILTER (WHERE l.high = p.high) AS high_raw, count(*) FILTER (WHERE l.low = p.low) AS low_raw, count(*) FILTER (WHERE l.close = p.close) AS close_raw
FROM live l JOIN p USING (symbol, open_time) GROUP BY 1"""
)
def vw_history_validation(spark, d):
    """Agreement by field of live and chart minutes, opens as they are and as the close before."""
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("open_time"))
    chart = minutes(spark, d).select("symbol", "open_time", *(F.col(c).alias(f"c_{c}") for c in ("open", "high", "low", "close")), before.alias("before"))
    both = minutes(spark, d, "live").join(chart, ["symbol", "open_time"])
    same = lambda c, other: F.count_if(F.col(c) == other)
    return both.groupBy("symbol").agg(
        F.count("*").alias("n"), same("open", F.col("c_open")).alias("open_raw"), same("open", F.coalesce("before", "c_open")).alias("open_joined"),
        same("high", F.col("c_high")).alias("high_raw"), same("low", F.col("c_low")).alias("low_raw"), same("close", F.col("c_close")).alias("close_raw"),
    )


@R.add("SELECT * FROM (SELECT l_suppkey AS variant, count(*) AS n, round(avg(l_discount) - 1.96 * stddev_samp(l_discount) / sqrt(count(*)), 8) AS bound FROM lineitem GROUP BY 1 HAVING count(*) >= 20) ORDER BY bound DESC, variant LIMIT 4")
def tk_best_by_bound(spark, d):
    """The four variants with the highest lower confidence bound."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("variant")).agg(F.count("*").alias("n"), F.avg("l_discount").alias("m"), F.stddev_samp("l_discount").alias("s"))
    bound = F.round(F.col("m") - 1.96 * F.col("s") / F.sqrt("n"), 8)
    return rows.where("n >= 20").select("variant", "n", bound.alias("bound")).orderBy(F.desc("bound"), "variant").limit(4)


@R.add(
    f"""{STRUCTURE}, {FVG}, o AS (SELECT DISTINCT symbol, created_idx, dir, bottom, top FROM fvg)
SELECT DISTINCT n.symbol, n.created_idx, n.dir FROM o n JOIN o p ON p.symbol = n.symbol AND p.dir = -n.dir AND p.created_idx < n.created_idx AND p.created_idx >= n.created_idx - 40 AND p.bottom < n.top AND p.top > n.bottom"""
)
def pat_overlapped_gaps(spark, d):
    """New gaps that overlap an opposite one of the last 40 bars."""
    zones = S.fair_value_gaps(structure(spark, d)[0], OPTIONS.fvg_min_atr).distinct()
    return V.overlapped(zones, 40).select("symbol", "created_idx", "dir")


@R.add(
    f"""{STRUCTURE}, pools AS (SELECT symbol, kind, idx AS src_idx, price, confirmed_idx FROM swings),
tk AS (SELECT p.*, (SELECT min(b.idx) FROM bars b WHERE b.symbol = p.symbol AND b.idx > p.confirmed_idx AND b.idx <= p.confirmed_idx + 100 AND CASE WHEN p.kind = 'HIGH' THEN b.high > p.price ELSE b.low < p.price END) AS taken FROM pools p)
SELECT t.symbol, t.kind, t.src_idx, t.taken AS idx FROM tk t JOIN bars b ON b.symbol = t.symbol AND b.idx = t.taken
WHERE b.atr IS NOT NULL AND abs(b.close - b.open) >= b.atr AND CASE WHEN t.kind = 'HIGH' THEN b.close > t.price ELSE b.close < t.price END"""
)
def pat_liquidity_runs(spark, d):
    """A bar with a body of an ATR or more that is the first to take a swing, and closes beyond it."""
    bars, pivots, _ = structure(spark, d)
    return V.liquidity_runs(bars, pivots, 100)


@R.add(
    f"""WITH {TAPE}, {bars_sql('dd', '1 day')}, d AS (SELECT symbol, open_time, high, low, lag(high) OVER w AS pdh, lag(low) OVER w AS pdl FROM dd WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
wk AS (SELECT symbol, date_trunc('week', open_time) AS w, max(high) AS h, min(low) AS l FROM dd GROUP BY ALL), lw AS (SELECT symbol, w, lag(h) OVER (PARTITION BY symbol ORDER BY w) AS pwh, lag(l) OVER (PARTITION BY symbol ORDER BY w) AS pwl FROM wk)
SELECT d.symbol, d.open_time, pdh, pdl, pwh, pwl FROM d JOIN lw ON lw.symbol = d.symbol AND lw.w = date_trunc('week', d.open_time) WHERE pdh IS NOT NULL AND pwh IS NOT NULL"""
)
def pat_period_pools(spark, d):
    """Highs and lows of the day and of the week before each day."""
    return V.period_pools(B.bars_of_trades(tape(spark, d), "1d")).where("pdh is not null and pwh is not null")
