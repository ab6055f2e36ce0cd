"""Queries over the tape and bars: sources, sinks, projections, aggregations, quality and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions.grid import bucket, later, seconds
from tapeloom.operators import bars as B
from tapeloom.operators import indicators as I
from tapeloom.operators import intervals as V
from tapeloom.operators.running import drawdown, running_sum
from tapeloom.plans.base import ATR, HOURS, TAPE, Registry, bars_sql, daily, hours, hours_atr, live, minutes
from tapeloom.sources.tape import merged, table, tape

R = Registry()


@R.add(f"WITH {TAPE} SELECT symbol, ts, trade_id, qty::DOUBLE AS qty, round(px, 2) AS px FROM tape")
def src_price_path(spark, d):
    return tape(spark, d).select("symbol", "ts", "trade_id", "qty", F.round("px", 2).alias("px"))


@R.add(f"WITH {TAPE}, {bars_sql('b', '1 minute')} SELECT * FROM b")
def agg_minutes_of_trades(spark, d):
    return minutes(spark, d)


@R.add(f"WITH {TAPE}, {bars_sql('b', '4 hours', offset='30 minutes')} SELECT * FROM b WHERE open_time + INTERVAL 4 HOUR <= TIMESTAMP '2024-01-30 12:00:00'")
def agg_closed_bars_on_half_hour_grid(spark, d):
    made = B.bars_of_trades(tape(spark, d), "4h", "tehran")
    return made.where(later("open_time", 14400) <= F.lit("2024-01-30 12:00:00").cast("timestamp_ntz"))


_COARSE = """b AS (
  SELECT symbol, time_bucket(INTERVAL '{w}', open_time{o}) AS open_time, first(open ORDER BY open_time) AS open, max(high) AS high,
         min(low) AS low, last(close ORDER BY open_time) AS close, sum(volume::DECIMAL(18,2))::DOUBLE AS volume, sum(n)::BIGINT AS n FROM m GROUP BY symbol, 2
)"""


@R.add(f"WITH {TAPE}, {bars_sql('m', '1 minute')}, {_COARSE.format(w='1 hour', o='')} SELECT * FROM b WHERE open_time + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20'")
def agg_coarser_bars(spark, d):
    return B.coarser(minutes(spark, d), "1h", upto="2024-01-20 00:00:00")


@R.add(
    f"""WITH {TAPE}, {bars_sql('d', '1 day')}, w AS (
  SELECT symbol, date_trunc('week', open_time) AS open_time, first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low,
         last(close ORDER BY open_time) AS close, count(*) AS days FROM d GROUP BY symbol, 2
) SELECT symbol, open_time, open, high, low, close FROM w WHERE days = 7"""
)
def agg_whole_weeks(spark, d):
    days = B.bars_of_trades(tape(spark, d), "1d")
    week = F.date_trunc("week", F.col("open_time")).cast("timestamp_ntz")
    return (
        days.groupBy("symbol", week.alias("week"))
        .agg(
            F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
            F.max_by("close", "open_time").alias("close"), F.count("*").alias("days"),
        )
        .where("days = 7")
        .select("symbol", F.col("week").alias("open_time"), "open", "high", "low", "close")
    )


_STATUS = """st AS (
  SELECT symbol, open_time, open, high, low, close, CASE WHEN n % 7 = 0 THEN NULL ELSE n END AS n,
         CASE WHEN epoch(open_time)::BIGINT // 60 % 11 = 0 THEN 'DATA_GAP' WHEN n = 1 THEN 'SYNTHETIC_NO_TRADE' ELSE 'OK' END AS status FROM m
)"""


@R.add(
    f"""WITH dense AS (SELECT l_orderkey % 5 AS s, l_shipdate, l_extendedprice AS px, l_orderkey, l_linenumber,
  TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * (date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))) AS ts FROM lineitem),
m AS (SELECT 'S' || s AS symbol, ts AS open_time, first(px ORDER BY l_orderkey, l_linenumber) AS open, max(px) AS high, min(px) AS low,
  last(px ORDER BY l_orderkey, l_linenumber) AS close, count(*) AS n FROM dense GROUP BY ALL), {_STATUS}
SELECT symbol, time_bucket(INTERVAL '5 minutes', open_time) AS open_time,
  CASE WHEN bool_or(status = 'DATA_GAP') THEN 'DATA_GAP' WHEN bool_and(status = 'SYNTHETIC_NO_TRADE') THEN 'SYNTHETIC_NO_TRADE' ELSE 'OK' END AS status,
  CASE WHEN NOT bool_or(status = 'DATA_GAP') THEN first(open ORDER BY open_time) END AS open,
  CASE WHEN NOT bool_or(status = 'DATA_GAP') THEN max(high) END AS high,
  CASE WHEN NOT bool_or(status = 'DATA_GAP') THEN min(low) END AS low,
  CASE WHEN NOT bool_or(status = 'DATA_GAP') THEN last(close ORDER BY open_time) END AS close,
  CASE WHEN NOT bool_or(status = 'DATA_GAP') AND count(n) = count(*) THEN sum(n)::DOUBLE END AS n
FROM st GROUP BY symbol, 2 HAVING count(*) = 5"""
)
def agg_five_minutes_with_quality(spark, d):
    days = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    ticks = table(spark, d, "lineitem").select(
        F.concat(F.lit("S"), (F.col("l_orderkey") % 5).cast("string")).alias("symbol"),
        F.timestamp_add("MINUTE", days, F.lit("2024-01-01").cast("timestamp_ntz")).alias("open_time"),
        F.struct("l_orderkey", "l_linenumber").alias("k"), F.col("l_extendedprice").alias("px"),
    )
    m = ticks.groupBy("symbol", "open_time").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.count("*").alias("n")
    )
    minute = F.expr("cast(timestampdiff(MINUTE, timestamp_ntz'1970-01-01 00:00:00', open_time) as bigint)")
    status = F.when(minute % 11 == 0, "DATA_GAP").when(F.col("n") == 1, "SYNTHETIC_NO_TRADE").otherwise("OK")
    return B.five_of_one(m.withColumn("status", status).withColumn("n", F.when(F.col("n") % 7 != 0, F.col("n")))).withColumn("n", F.col("n").cast("double"))


@R.add(f"WITH {TAPE} SELECT symbol, conn, count(*) AS n, count(*) FILTER (WHERE qty > 90) AS large, max(qty)::DOUBLE AS most FROM tape GROUP BY ALL")
def agg_lineage_counts(spark, d):
    return tape(spark, d).groupBy("symbol", "conn").agg(
        F.count("*").alias("n"), F.count_if(F.col("qty") > 90).alias("large"), F.max("qty").alias("most")
    )


@R.add(
    f"""WITH {TAPE}, g AS (SELECT symbol, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY ts, trade_id)) AS s FROM tape)
SELECT symbol, round(quantile_cont(s, 0.5), 4) AS p50, round(quantile_cont(s, 0.9), 4) AS p90, round(quantile_cont(s, 0.99), 4) AS p99, round(max(s), 4) AS most
FROM g GROUP BY symbol"""
)
def agg_latency_quantiles(spark, d):
    w = Window.partitionBy("symbol").orderBy("ts", "trade_id")
    micros = F.expr("timestampdiff(MICROSECOND, before, ts)")
    gap = tape(spark, d).withColumn("before", F.lag("ts").over(w)).withColumn("s", micros / F.lit(1e6))
    q = [F.round(F.percentile("s", p), 4).alias(k) for k, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))]
    return gap.groupBy("symbol").agg(*q, F.round(F.max("s"), 4).alias("most"))


@R.add("SELECT json_extract_string(props, '$.k') AS k, event_type AS symbol, count(*) AS n FROM events GROUP BY ALL")
def prj_json_field_counts(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("symbol")).agg(F.count("*").alias("n"))


@R.add(
    f"""WITH {TAPE}, {bars_sql('live', '1 minute', where='WHERE conn <> 0')}, {bars_sql('hist', '1 minute')}
SELECT *, 'live' AS source FROM live UNION ALL
SELECT *, 'history' FROM hist h WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.symbol = h.symbol AND l.open_time = h.open_time)"""
)
def src_merged_minutes(spark, d):
    one = minutes(spark, d, "live").withColumn("source", F.lit("live"))
    return merged(one, minutes(spark, d).withColumn("source", F.lit("history")), ["symbol", "open_time"])


@R.add(f"WITH {TAPE}, {HOURS}, e AS (SELECT symbol, max(idx) AS last FROM hours GROUP BY 1) SELECT hours.* EXCLUDE (idx), last - idx AS back FROM hours JOIN e USING (symbol) WHERE last - idx < 48")
def src_last_bars(spark, d):
    bars = hours(spark, d)
    w = Window.partitionBy("symbol").orderBy(F.desc("open_time"))
    return bars.withColumn("back", (F.row_number().over(w) - 1).cast("long")).where("back < 48").drop("idx")


@R.add(
    f"""WITH {TAPE}, {HOURS}, e AS (SELECT symbol, min(open_time) AS a, max(open_time) AS z FROM hours GROUP BY 1)
SELECT symbol, CASE WHEN epoch(open_time) - epoch(a) < (epoch(z) - epoch(a)) * 2 / 3 THEN 'discovery' ELSE 'holdout' END AS split, count(*) AS n
FROM hours JOIN e USING (symbol) GROUP BY ALL"""
)
def src_discovery_split(spark, d):
    bars = hours(spark, d)
    ends = bars.groupBy("symbol").agg(F.min("open_time").alias("a"), F.max("open_time").alias("z"))
    early = seconds("open_time") - seconds("a") < (seconds("z") - seconds("a")) * 2 / 3
    split = F.when(early, "discovery").otherwise("holdout")
    return bars.join(F.broadcast(ends), "symbol").groupBy("symbol", split.alias("split")).agg(F.count("*").alias("n"))


@R.add("SELECT * FROM (SELECT event_id AS trade_id, event_type AS symbol, ts FROM events WHERE event_type = ANY(['click', 'view']) AND ts >= TIMESTAMP '2024-01-10' AND NOT (event_id::VARCHAR LIKE '1%'))")
def prj_dynamic_filters(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("trade_id"), F.col("event_type").alias("symbol"), "ts")
    wanted = [F.col("symbol").isin("click", "view"), F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"), ~F.col("trade_id").cast("string").startswith("1")]
    for condition in wanted:
        e = e.where(condition)
    return e


@R.add(
    f"""WITH {TAPE}, {bars_sql('m', '1 minute')}, g AS (
  SELECT symbol, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS gap_start, open_time AS gap_end FROM m)
SELECT symbol, gap_start, gap_end, date_diff('second', gap_start, gap_end) AS gap_s FROM g WHERE gap_end - gap_start > INTERVAL 5 MINUTE"""
)
def win_gaps(spark, d):
    return V.gaps(minutes(spark, d), ["symbol"], "open_time", 300)


@R.add(
    f"""WITH {TAPE}, {HOURS}, i AS (SELECT symbol, open_time, epoch(open_time)::BIGINT - 3600 * row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS g FROM hours)
SELECT symbol, min(open_time) AS island_start, max(open_time) AS island_end, count(*) AS size FROM i GROUP BY symbol, g"""
)
def win_islands(spark, d):
    return V.islands(hours(spark, d), ["symbol"], "open_time", 3600)


@R.add(
    """WITH s AS (SELECT user_id % 50 AS k, ts AS a, ts + INTERVAL 1 HOUR * CAST(floor(value) AS BIGINT) AS z FROM events),
m AS (SELECT *, CASE WHEN a <= max(z) OVER (PARTITION BY k ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS b FROM s),
g AS (SELECT *, sum(b) OVER (PARTITION BY k ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS i FROM m)
SELECT k, min(a) AS a, max(z) AS z FROM g GROUP BY k, i"""
)
def set_interval_union(spark, d):
    e = table(spark, d, "events")
    spans = e.select((F.col("user_id") % 50).alias("k"), F.col("ts").alias("a"), F.timestamp_add("HOUR", F.floor("value").cast("int"), F.col("ts")).alias("z"))
    return V.union_of(spans, ["k"], "a", "z")


@R.add(
    f"""WITH {TAPE}, {bars_sql('m', '1 minute')}, g AS (
  SELECT symbol, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS a, open_time AS z FROM m), gaps AS (SELECT * FROM g WHERE z - a > INTERVAL 1 HOUR),
{bars_sql('h', '1 hour')}
SELECT DISTINCT h.symbol, h.open_time, a, z FROM h JOIN gaps g ON g.symbol = h.symbol AND h.open_time < z AND h.open_time + INTERVAL 1 HOUR > a"""
)
def jn_interval_overlap(spark, d):
    found = V.gaps(minutes(spark, d), ["symbol"], "open_time", 3600).select("symbol", F.col("gap_start").alias("a"), F.col("gap_end").alias("z"))
    return V.overlapping(hours(spark, d).select("symbol", "open_time"), found, ["symbol"], 3600, "open_time", "a", "z")


@R.add(
    f"""WITH {TAPE}, {bars_sql('m', '1 minute')}, c AS (SELECT symbol, unnest(generate_series(min(open_time), max(open_time), INTERVAL 1 MINUTE)) AS open_time FROM m GROUP BY symbol)
SELECT symbol, strftime(c.open_time, '%Y-%m-%d') AS day, count(*) AS expected, count(m.n) AS present, count(*) - count(m.n) AS missing
FROM c LEFT JOIN m USING (symbol, open_time) GROUP BY ALL"""
)
def vw_minute_calendar(spark, d):
    m = minutes(spark, d)
    ends = m.groupBy("symbol").agg(F.min("open_time").alias("a"), F.max("open_time").alias("z"))
    calendar = ends.select("symbol", F.explode(F.expr("sequence(a, z, interval 1 minute)")).alias("open_time"))
    joined = calendar.join(m.select("symbol", "open_time", "n"), ["symbol", "open_time"], "left")
    return joined.groupBy("symbol", F.date_format("open_time", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("expected"), F.count("n").alias("present"), (F.count("*") - F.count("n")).alias("missing")
    )


@R.add(
    f"""WITH {TAPE}, {bars_sql('m', '1 minute')}, c AS (SELECT symbol, unnest(generate_series(min(open_time), max(open_time), INTERVAL 1 MINUTE)) AS open_time FROM m GROUP BY symbol),
j AS (SELECT symbol, c.open_time, m.close, m.n, CASE WHEN m.n IS NULL AND epoch(c.open_time)::BIGINT // 60 % 97 = 0 THEN 1 ELSE 0 END AS broken FROM c LEFT JOIN m USING (symbol, open_time)),
s AS (SELECT *, sum(broken) OVER (PARTITION BY symbol ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS seg FROM j),
f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol, seg ORDER BY open_time ROWS UNBOUNDED PRECEDING) AS anchor FROM s)
SELECT symbol, CASE WHEN broken = 1 THEN 'DATA_GAP' WHEN n IS NOT NULL THEN 'OK' WHEN anchor IS NULL THEN 'UNANCHORED' ELSE 'SYNTHETIC_NO_TRADE' END AS status,
  count(*) AS minutes, round(sum(coalesce(anchor, 0)), 2) AS total FROM f GROUP BY ALL"""
)
def win_carried_anchor(spark, d):
    m = minutes(spark, d)
    ends = m.groupBy("symbol").agg(F.min("open_time").alias("a"), F.max("open_time").alias("z"))
    calendar = ends.select("symbol", F.explode(F.expr("sequence(a, z, interval 1 minute)")).alias("open_time"))
    j = calendar.join(m.select("symbol", "open_time", "close", "n"), ["symbol", "open_time"], "left")
    minute = F.expr("cast(timestampdiff(MINUTE, timestamp_ntz'1970-01-01 00:00:00', open_time) as bigint)")
    j = j.withColumn("broken", F.when(F.col("n").isNull() & (minute % 97 == 0), 1).otherwise(0))
    upto = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("seg", F.sum("broken").over(upto))
    inside = Window.partitionBy("symbol", "seg").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("anchor", F.last("close", True).over(inside))
    status = F.when(F.col("broken") == 1, "DATA_GAP").when(F.col("n").isNotNull(), "OK").when(F.col("anchor").isNull(), "UNANCHORED").otherwise("SYNTHETIC_NO_TRADE")
    return j.groupBy("symbol", status.alias("status")).agg(
        F.count("*").alias("minutes"), F.round(F.sum(F.coalesce("anchor", F.lit(0.0)).cast("decimal(18,2)")), 2).cast("double").alias("total")
    )


@R.add(
    f"""WITH {TAPE}, {bars_sql('m', '1 minute')}, g AS (SELECT *, date_diff('second', lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time), open_time) AS gap FROM m)
SELECT symbol, count(*) AS present, count(*) FILTER (WHERE gap > 60) AS holes, count(*) FILTER (WHERE gap > 3600) AS long_holes,
  count(*) FILTER (WHERE low > open OR low > close OR high < open OR high < close) AS impossible, count(*) FILTER (WHERE volume = 0) AS empty FROM g GROUP BY symbol"""
)
def agg_quality_profile(spark, d):
    w = Window.partitionBy("symbol").orderBy("open_time")
    g = minutes(spark, d).withColumn("gap", seconds("open_time") - seconds(F.lag("open_time").over(w)))
    odd = (F.col("low") > F.least("open", "close")) | (F.col("high") < F.greatest("open", "close"))
    return g.groupBy("symbol").agg(
        F.count("*").alias("present"), F.count_if(F.col("gap") > 60).alias("holes"), F.count_if(F.col("gap") > 3600).alias("long_holes"),
        F.count_if(odd).alias("impossible"), F.count_if(F.col("volume") == 0).alias("empty"),
    )


@R.add(f"WITH RECURSIVE {TAPE}, {HOURS}, {ATR} SELECT symbol, idx, round(tr, 6) AS tr, round(atr, 6) AS atr FROM bars")
def win_wilder_atr(spark, d):
    return hours_atr(spark, d).select("symbol", "idx", F.round("tr", 6).alias("tr"), F.round("atr", 6).alias("atr"))


@R.add(
    f"""WITH RECURSIVE {TAPE}, {HOURS}, rec(symbol, idx, total, ema) AS (
  SELECT symbol, idx, close, CAST(NULL AS DOUBLE) FROM hours WHERE idx = 0 UNION ALL
  SELECT h.symbol, h.idx, r.total + h.close, CASE WHEN h.idx < 19 THEN NULL WHEN h.idx = 19 THEN (r.total + h.close) / 20
    ELSE r.ema * (1 - 2.0::DOUBLE / 21) + h.close * (2.0::DOUBLE / 21) END FROM rec r JOIN hours h ON h.symbol = r.symbol AND h.idx = r.idx + 1)
SELECT symbol, idx, round(ema, 4) AS ema, coalesce(sign(round(ema, 4) - round(lag(ema, 6) OVER (PARTITION BY symbol ORDER BY idx), 4)), 0)::INT AS slope FROM rec"""
)
def win_ema_slope(spark, d):
    e = I.with_ema(hours(spark, d), 20).withColumn("ema", F.round("ema", 4))
    return I.with_slope(e, "ema", 6).select("symbol", "idx", "ema", "slope")


@R.add(
    f"""WITH RECURSIVE {TAPE}, {HOURS}, {ATR}, s AS (
  SELECT symbol, idx, CASE WHEN close > lag(high) OVER w + lag(atr) OVER w THEN 1 WHEN close < lag(low) OVER w - lag(atr) OVER w THEN -1 END AS own
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx))
SELECT symbol, idx, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) AS state FROM s"""
)
def win_displacement_state(spark, d):
    return I.with_displacement(hours_atr(spark, d)).select("symbol", "idx", F.col("state").cast("int").alias("state"))


@R.add(
    """WITH r AS (SELECT l_orderkey % 7 AS k, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(floor(l_extendedprice * (0.05 - l_discount) * 100 + 0.5) AS BIGINT) AS r FROM lineitem),
e AS (SELECT *, sum(r) OVER w AS equity FROM r WINDOW w AS (PARTITION BY k ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, r ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(max(equity) OVER (PARTITION BY k ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, r ROWS UNBOUNDED PRECEDING), 0) AS peak FROM e)
SELECT k, max(peak - equity)::DOUBLE AS max_drawdown, count(*) AS n, count(*) FILTER (WHERE r > 0) AS wins,
  round(sum(r) FILTER (WHERE r > 0)::DOUBLE / nullif(-sum(r) FILTER (WHERE r <= 0)::DOUBLE, 0), 6) AS profit_factor FROM p GROUP BY k"""
)
def agg_performance_summary(spark, d):
    gain = F.floor(F.col("l_extendedprice") * (0.05 - F.col("l_discount")) * 100 + 0.5)
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 7).alias("k"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", gain.alias("r"))
    w = drawdown(rows.withColumn("chunk", F.floor(F.col("l_orderkey") / 100_000)), ["k"], "chunk", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "r"], "r")
    won, lost = F.sum(F.when(F.col("r") > 0, F.col("r"))), F.sum(F.when(F.col("r") <= 0, F.col("r")))
    return w.groupBy("k").agg(
        F.max("drawdown").cast("double").alias("max_drawdown"), F.count("*").alias("n"), F.count_if(F.col("r") > 0).alias("wins"),
        F.round(won.cast("double") / F.nullif(-lost.cast("double"), F.lit(0.0)), 6).alias("profit_factor"),
    )


@R.add(
    """SELECT coalesce(market, '') AS market, coalesce(side, '') AS side, coalesce(quarter, 0) AS quarter, count(*) AS n, sum(p)::DOUBLE AS total FROM (
  SELECT o_orderpriority AS market, CASE WHEN o_totalprice > 150000 THEN 'LONG' ELSE 'SHORT' END AS side, quarter(o_orderdate) AS quarter,
         CAST(o_totalprice AS DECIMAL(18,2)) AS p FROM orders)
GROUP BY GROUPING SETS ((market), (side), (quarter), (market, side))"""
)
def agg_breakdowns(spark, d):
    return spark.sql(
        """SELECT coalesce(market, '') AS market, coalesce(side, '') AS side, coalesce(quarter, 0) AS quarter, count(*) AS n, cast(sum(p) as double) AS total FROM (
             SELECT o_orderpriority AS market, CASE WHEN o_totalprice > 150000 THEN 'LONG' ELSE 'SHORT' END AS side,
                    cast(quarter(o_orderdate) as bigint) AS quarter, cast(o_totalprice as decimal(18,2)) AS p FROM {orders})
           GROUP BY GROUPING SETS ((market), (side), (quarter), (market, side))""",
        orders=table(spark, d, "orders"),
    )


@R.add("SELECT o_custkey AS k, o_orderkey, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def agg_distinct_latest(spark, d):
    newest = F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(newest.alias("x")).select("k", "x.o_orderkey", F.col("x.o_orderstatus").alias("status"))


@R.add("SELECT o_custkey AS k, (array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey))[1] AS first_key, list_sort(array_agg(o_orderkey) FILTER (WHERE o_orderstatus = 'F'))::VARCHAR AS filled FROM orders GROUP BY 1")
def agg_ordered_array(spark, d):
    o = table(spark, d, "orders")
    first = F.min_by("o_orderkey", F.struct(-F.col("o_totalprice"), F.col("o_orderkey")))
    filled = F.array_sort(F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))))
    text = F.when(F.size(filled) > 0, F.concat(F.lit("["), F.array_join(filled.cast("array<string>"), ", "), F.lit("]")))
    return o.groupBy(F.col("o_custkey").alias("k")).agg(first.alias("first_key"), text.alias("filled"))


@R.add(
    """WITH t AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice AS p, o_orderkey AS key FROM orders)
SELECT symbol, strftime(ts, '%Y-%m') AS month, count(*) AS n, first(p ORDER BY ts, key) AS open, last(p ORDER BY ts, key) AS close FROM t GROUP BY ALL"""
)
def agg_monthly_bars_of_orders(spark, d):
    t = daily(spark, d)
    k = F.struct("ts", "key")
    return t.groupBy("symbol", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.min_by(F.col("price").cast("double"), k).alias("open"), F.max_by(F.col("price").cast("double"), k).alias("close")
    )


@R.add(f"WITH {TAPE} SELECT symbol, trade_id, ts, qty::DOUBLE AS qty FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY qty DESC, trade_id) AS r FROM tape) WHERE r <= 20")
def tk_largest_trades(spark, d):
    w = Window.partitionBy("symbol").orderBy(F.desc("qty"), "trade_id")
    return tape(spark, d).withColumn("r", F.row_number().over(w)).where("r <= 20").select("symbol", "trade_id", "ts", "qty")


@R.add("SELECT event_id, ts, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def tk_top_of_all(spark, d):
    return table(spark, d, "events").orderBy(F.desc("value"), "event_id").limit(100).select("event_id", "ts", "value")


@R.add(
    """WITH a AS (SELECT user_id % 20 AS k, event_type AS s FROM events WHERE event_id % 2 = 0), b AS (SELECT user_id % 20 AS k, event_type AS s FROM events WHERE event_id % 3 = 0)
SELECT 'only_a' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'only_b', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""
)
def set_symmetric_difference(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("k"), F.col("event_type").alias("s"), "event_id")
    a, b = (e.where(f"event_id % {m} = 0").select("k", "s") for m in (2, 3))
    return a.exceptAll(b).select(F.lit("only_a").alias("side"), "k", "s").unionByName(b.exceptAll(a).select(F.lit("only_b").alias("side"), "k", "s"))


@R.add(
    """WITH c AS (SELECT user_id % 3 AS conn, event_type AS s, CAST(floor(value) AS BIGINT) AS fp, count(*) AS n FROM events GROUP BY ALL)
SELECT s, fp, unnest(range(1, max(n) + 1)) AS occurrence FROM c GROUP BY s, fp"""
)
def set_multiset_union(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 3).alias("conn"), F.col("event_type").alias("s"), F.floor("value").alias("fp"))
    most = e.groupBy("conn", "s", "fp").count().groupBy("s", "fp").agg(F.max("count").alias("n"))
    return most.select("s", "fp", F.explode(F.expr("sequence(1L, n)")).alias("occurrence"))


@R.add("SELECT event_type AS symbol, user_id, min(ts) AS first_ts FROM events GROUP BY ALL")
def set_distinct_min(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("symbol"), "user_id").agg(F.min("ts").alias("first_ts"))


@R.add(
    """SELECT l_orderkey, l_linenumber, sum(CAST(floor(l_extendedprice * (1 - l_discount) * 100 + 0.5) AS BIGINT)) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)::DOUBLE AS balance FROM lineitem"""
)
def sim_ledger_balance(spark, d):
    amount = F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100 + 0.5)
    rows = table(spark, d, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    done = running_sum(rows, ["l_suppkey"], "month", ["l_shipdate", "l_orderkey", "l_linenumber"], amount, "balance")
    return done.select("l_orderkey", "l_linenumber", F.col("balance").cast("double").alias("balance"))


@R.add(
    f"""WITH {TAPE}, l AS (SELECT symbol, px, lag(px) OVER (PARTITION BY symbol ORDER BY px, trade_id) AS prev FROM tape),
c AS (SELECT *, sum(CASE WHEN px - prev <= 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY px ROWS UNBOUNDED PRECEDING) AS cluster FROM l)
SELECT symbol, round(min(px), 2) AS bottom, round(max(px), 2) AS top, count(*) AS n FROM c GROUP BY symbol, cluster HAVING count(*) >= 2"""
)
def win_equal_levels(spark, d):
    """Runs of prices of which none is more than 0.5 above the one before; equal prices are counted
    first, so a series has one row a price."""
    levels = tape(spark, d).groupBy("symbol", "px").agg(F.count("*").alias("n"))
    w = Window.partitionBy("symbol").orderBy("px")
    near = levels.withColumn("begins", F.when(F.col("px") - F.lag("px").over(w) <= 0.5, 0).otherwise(1))
    c = near.withColumn("cluster", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("symbol", "cluster").agg(F.round(F.min("px"), 2).alias("bottom"), F.round(F.max("px"), 2).alias("top"), F.sum("n").alias("n")).where("n >= 2").drop("cluster")


@R.add(
    f"""WITH {TAPE}, {bars_sql('m', '1 minute')}
SELECT symbol, open_time, sha256(concat_ws('|', symbol, strftime(open_time, '%Y-%m-%d %H:%M'), printf('%.2f', open), printf('%.2f', close), n::VARCHAR)) AS source_hash FROM m"""
)
def snk_source_hash(spark, d):
    m = minutes(spark, d)
    parts = ["symbol", F.date_format("open_time", "yyyy-MM-dd HH:mm"), *(F.col(c).cast("decimal(18,2)").cast("string") for c in ("open", "close")), F.col("n").cast("string")]
    return m.select("symbol", "open_time", F.sha2(F.concat_ws("|", *parts), 256).alias("source_hash"))


@R.add(f"WITH {TAPE}, {HOURS} SELECT symbol, open_time, open_time + INTERVAL 1 HOUR > TIMESTAMP '2024-01-29 10:20:00' AS forming, close >= open AS up, round((high + low) / 2, 4) AS mid FROM hours")
def prj_chart_candles(spark, d):
    ends = later("open_time", 3600)
    return hours(spark, d).select(
        "symbol", "open_time", (ends > F.lit("2024-01-29 10:20:00").cast("timestamp_ntz")).alias("forming"),
        (F.col("close") >= F.col("open")).alias("up"), F.round((F.col("high") + F.col("low")) / 2, 4).alias("mid"),
    )


@R.add("SELECT split_part(o_orderpriority, '-', 1) AS kind, lower(o_orderpriority) AS priority, count(*) AS n FROM orders GROUP BY ALL" )
def prj_split_part(spark, d):
    o = table(spark, d, "orders")
    return o.groupBy(F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("kind"), F.lower("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
