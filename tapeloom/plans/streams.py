"""Queries that run a stream to its end and return what it wrote, and views over the feed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions.grid import seconds
from tapeloom.operators.persist import made_once, shared_folder
from tapeloom.plans.base import TAPE, Registry, bars_sql
from tapeloom.sources.tape import table, tape
from tapeloom.streaming import minutes as S

R = Registry()


#: Files of the stream, days of a file; every LATEth trade comes two files later.
FILES, DAYS, LATE = 6, 8, 97
_DAY = "(epoch(ts)::BIGINT // 86400 - (SELECT min(epoch(ts))::BIGINT // 86400 FROM tape))"
DELIVERED = f"""dl AS (SELECT *, least({_DAY} // {DAYS}, {FILES - 3}) + CASE WHEN trade_id % {LATE} = 0 THEN 2 ELSE 0 END AS file FROM tape)"""
_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"


def _deliveries(spark, d, folder, again: bool = False):
    """The tape as a stream of FILES files, one a trigger, in which some trades come late; with
    again, every 31st trade is delivered twice."""
    t = tape(spark, d).select("symbol", "ts", "trade_id", "px", F.col("qty").cast("double").alias("qty"), F.expr(_US).alias("us"))
    first = F.broadcast(t.agg(F.floor(F.min("us") / 86_400_000_000).alias("first")))
    day = F.floor(F.col("us") / 86_400_000_000) - F.col("first")
    late = F.when(F.col("trade_id") % LATE == 0, 2).otherwise(0)
    rows = t.join(first).withColumn("file", F.least(F.floor(day / DAYS), F.lit(FILES - 3)) + late).drop("first")
    if again:
        rows = rows.unionByName(rows.where("trade_id % 31 = 0"))
    rows = made_once(rows.withColumn("ts", F.col("ts").cast("timestamp")), "deliveries")
    for k in range(FILES):  # a file stream takes older files first
        rows.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return S.read_tape(spark, f"{folder}/in", ", ".join(f"{n} {t}" for n, t in rows.drop("file").dtypes), files=1)


@R.add(
    f"""WITH {TAPE}, {DELIVERED}, marks AS (SELECT f.file, (SELECT max(ts) - INTERVAL 2 SECOND FROM dl WHERE dl.file <= f.file - 2) AS mark FROM (SELECT DISTINCT file FROM dl) f),
ok AS (SELECT dl.* FROM dl JOIN marks USING (file) WHERE mark IS NULL OR time_bucket(INTERVAL '1 minute', ts) + INTERVAL 1 MINUTE > mark),
{bars_sql('m', '1 minute', 'ok')}, last AS (SELECT max(ts) - INTERVAL 2 SECOND AS mark FROM dl)
SELECT m.symbol, m.open_time, m.close, m.n FROM m, last WHERE m.open_time + INTERVAL 1 MINUTE <= mark"""
)
def str_closed_minutes(spark, d):
    """A trade is dropped as late once the watermark of the batch before had passed its minute."""
    folder = shared_folder(spark, "stream")
    S.run_to_end(S.closed_minutes(_deliveries(spark, d, folder)), f"{folder}/out", f"{folder}/state")
    done = spark.read.parquet(f"{folder}/out")
    return done.select("symbol", F.col("open_time").cast("timestamp_ntz").alias("open_time"), "close", "n")


@R.add(
    f"""WITH {TAPE}, {DELIVERED}, u AS (SELECT *, epoch_us(ts) AS us FROM dl),
ends AS (SELECT symbol, file, max((us - 2000000) // 60000000 * 60000000) AS e FROM u GROUP BY ALL),
marks AS (SELECT f.symbol, f.file, coalesce(max(e.e), 0) AS mark FROM (SELECT DISTINCT symbol, file FROM u) f LEFT JOIN ends e ON e.symbol = f.symbol AND e.file < f.file GROUP BY ALL),
t AS (SELECT u.*, us < mark AS late FROM u JOIN marks USING (symbol, file)),
last AS (SELECT symbol, max(e) AS mark FROM ends GROUP BY 1),
m AS (SELECT symbol, us // 60000000 * 60000000 AS open_us, first(px ORDER BY us, trade_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY us, trade_id) AS close, count(*) AS n
  FROM t WHERE NOT late GROUP BY ALL)
SELECT symbol, 'M1' AS kind, open_us, open, high, low, close, n FROM m JOIN last USING (symbol) WHERE open_us < mark
UNION ALL SELECT symbol, 'LATE', us, px, px, px, px, 1 FROM t WHERE late
UNION ALL SELECT symbol, 'LATE', us, px, px, px, px, 1 FROM t WHERE late AND trade_id % 31 = 0"""
)
def str_stateful_minutes(spark, d):
    """Late trades are reported at every delivery; repeated ones count once in a minute."""
    folder = shared_folder(spark, "stream")
    stream = _deliveries(spark, d, folder, again=True).select("symbol", "us", "trade_id", "px")
    S.run_to_end(S.minutes_with_late(stream), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


@R.add(f"WITH {TAPE}, {bars_sql('h', '1 hour')} SELECT symbol, max(open_time) AS open_time, max_by(open, open_time) AS open, max_by(close, open_time) AS close, max_by(n, open_time) AS n FROM h GROUP BY symbol")
def str_forming_bar(spark, d):
    """The last state of a stream in complete mode, batch by batch."""
    folder = shared_folder(spark, "stream")
    S.each_batch(S.forming(_deliveries(spark, d, folder)), lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/batch{number:04d}"), f"{folder}/state", "complete")
    bars = spark.read.parquet(f"{folder}/batch{FILES - 1:04d}").withColumn("open_time", F.col("open_time").cast("timestamp_ntz"))
    latest = F.max_by(F.struct("open_time", "open", "close", "n"), "open_time")
    return bars.groupBy("symbol").agg(latest.alias("x")).select("symbol", "x.*")


@R.add(f"WITH {TAPE}, {bars_sql('m', '1 minute')} SELECT symbol, open_time, close, n FROM m")
def str_late_revision(spark, d):
    """Each batch is added to the stored trades, and the minutes it touches are made anew."""
    folder = shared_folder(spark, "stream")
    S.revise_batches(_deliveries(spark, d, folder), folder, f"{folder}/state")
    done = S.revised_minutes(spark, folder)
    return done.select("symbol", F.col("open_time").cast("timestamp_ntz").alias("open_time"), "close", "n")


@R.add(
    """WITH e AS (SELECT user_id AS conn, ts, event_id, CASE event_type WHEN 'signup' THEN 'CONNECTED' WHEN 'view' THEN 'CONFIRMED' WHEN 'error' THEN 'CLOSED' END AS kind FROM events),
f AS (SELECT *, min(CASE WHEN kind = 'CONFIRMED' THEN ts END) OVER (PARTITION BY conn ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS back FROM e WHERE kind IS NOT NULL)
SELECT conn, count(*) FILTER (WHERE kind = 'CLOSED') AS disconnects, count(*) FILTER (WHERE kind = 'CLOSED' AND back IS NOT NULL) AS reconnects,
  round(avg(epoch_us(back) - epoch_us(ts)) FILTER (WHERE kind = 'CLOSED') / 1e6, 3) AS mean_down_s FROM f GROUP BY conn HAVING count(*) FILTER (WHERE kind = 'CLOSED' AND back IS NOT NULL) > 0"""
)
def vw_feed_report(spark, d):
    kind = F.when(F.col("event_type") == "signup", "CONNECTED").when(F.col("event_type") == "view", "CONFIRMED").when(F.col("event_type") == "error", "CLOSED")
    e = table(spark, d, "events").select(F.col("user_id").alias("conn"), "ts", "event_id", kind.alias("kind")).where("kind is not null")
    ahead = Window.partitionBy("conn").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    f = e.withColumn("back", F.min(F.when(F.col("kind") == "CONFIRMED", F.col("ts"))).over(ahead))
    closed = F.col("kind") == "CLOSED"
    down = F.when(closed, F.expr("timestampdiff(MICROSECOND, ts, back)"))
    return f.groupBy("conn").agg(
        F.count_if(closed).alias("disconnects"), F.count_if(closed & F.col("back").isNotNull()).alias("reconnects"), F.round(F.avg(down) / 1e6, 3).alias("mean_down_s")
    ).where("reconnects > 0")


@R.add(
    f"""WITH {TAPE}, l AS (SELECT symbol, max(ts) AS seen, max_by(px, (ts, trade_id)) AS px, count(*) AS trades FROM tape GROUP BY 1)
SELECT symbol, seen, round(px, 2) AS last, trades, CASE WHEN seen < (SELECT max(ts) FROM tape) - INTERVAL 30 MINUTE THEN 'STALE' ELSE 'LIVE' END AS status FROM l"""
)
def vw_market_summary(spark, d):
    t = tape(spark, d)
    newest = F.max_by("px", F.struct("ts", "trade_id"))
    one = t.groupBy("symbol").agg(F.max("ts").alias("seen"), newest.alias("px"), F.count("*").alias("trades"))
    end = F.broadcast(t.agg(F.max("ts").alias("end")))
    stale = seconds("seen") < seconds("end") - 1800
    return one.join(end).select("symbol", "seen", F.round("px", 2).alias("last"), "trades", F.when(stale, "STALE").otherwise("LIVE").alias("status"))
