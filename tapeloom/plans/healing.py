"""Queries of a store of trades and minutes that is healed."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import heal as H
from tapeloom.operators.bars import bars_of_trades
from tapeloom.operators.persist import made_once, shared_folder
from tapeloom.plans.base import TAPE, Registry
from tapeloom.sources.tape import tape

R = Registry()

#: The tape runs this much faster, so that most of its minutes have trades.
FAST, AGAIN = 100, 1_000_000_000
OVERLAP, MOST = 10, 30
_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
_BARS = "first(px ORDER BY ts, trade_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY ts, trade_id) AS close, sum(qty)::DOUBLE AS volume, count(*) AS n"

STORE = f"""q AS (SELECT symbol, trade_id, px, qty, conn, make_timestamp(epoch_us(ts) // {FAST}) AS ts, epoch_us(ts) // {FAST} // 60000000 AS m FROM tape),
known AS (SELECT * FROM q WHERE m % 29 NOT IN (7, 8) AND m % 211 NOT BETWEEN 100 AND 140 AND (conn <> 0 OR trade_id % 4 IN (0, 1))),
twin AS (
  SELECT symbol, trade_id + {AGAIN} AS trade_id, px, qty, ts + to_microseconds((trade_id * 7919) % 400000 - 20000) AS ts FROM known WHERE conn <> 0 AND trade_id % 6 = 0
), twins AS (SELECT *, epoch_us(ts) // 60000000 AS m FROM twin WHERE (epoch_us(ts) // 60000000) % 29 NOT IN (7, 8) AND (epoch_us(ts) // 60000000) % 211 NOT BETWEEN 100 AND 140),
was AS (SELECT symbol, m, {_BARS} FROM (SELECT symbol, m, ts, trade_id, px, qty FROM known WHERE conn <> 0 OR trade_id % 4 = 0 UNION ALL SELECT symbol, m, ts, trade_id, px, qty FROM twins) WHERE m % 17 <> 3 GROUP BY ALL),
ist AS (SELECT symbol, m, {_BARS} FROM known GROUP BY ALL),
mins AS (SELECT i.*, CASE WHEN w.m IS NULL OR (w.open, w.high, w.low, w.close, w.volume, w.n) = (i.open, i.high, i.low, i.close, i.volume, i.n) THEN 0 ELSE 1 END AS revision FROM ist i LEFT JOIN was w USING (symbol, m)),
hist AS (SELECT symbol, m, {_BARS} FROM q WHERE m % 31 <> 11 AND NOT (conn = 0 AND trade_id % 20 = 2) GROUP BY ALL),
holes AS (SELECT symbol, p + 1 AS a, m - 1 AS b FROM (SELECT symbol, m, lag(m) OVER (PARTITION BY symbol ORDER BY m) AS p FROM mins) WHERE m - p > 1),
cmp AS (
  SELECT h.symbol, h.a, count(*) AS compared, count(*) FILTER (WHERE (x.open, x.high, x.low, x.close) = (y.open, y.high, y.low, y.close)) AS exact,
    max(greatest(abs(x.high - y.high) / y.high, abs(x.low - y.low) / y.low)) AS off
  FROM holes h JOIN mins x ON x.symbol = h.symbol AND x.m >= h.a - {OVERLAP} AND x.m < h.a JOIN hist y ON y.symbol = x.symbol AND y.m = x.m GROUP BY 1, 2
), hav AS (SELECT h.symbol, h.a, count(*) AS have FROM holes h JOIN hist y ON y.symbol = h.symbol AND y.m BETWEEN h.a AND h.b GROUP BY 1, 2),
dec AS (
  SELECT h.*, CASE WHEN b - a + 1 > {MOST} THEN 'TOO_LONG' WHEN coalesce(have, 0) < b - a + 1 THEN 'INCOMPLETE' WHEN coalesce(compared, 0) < 5 THEN 'TOO_FEW'
    WHEN exact * 5 < compared * 4 THEN 'INEXACT' WHEN off > 0.001 THEN 'OUT_OF_RANGE' ELSE 'REPAIRED' END AS code
  FROM holes h LEFT JOIN cmp USING (symbol, a) LEFT JOIN hav USING (symbol, a)
)"""


def _known(rows):
    m = F.col("m")
    return rows.where(~(m % 29).isin(7, 8) & ~(m % 211).between(100, 140))


def _minute(rows):
    return rows.withColumn("m", F.floor(F.expr(_US) / 60_000_000))


def stored(spark, d):
    """A store as a feed with faults left it, the log of dropped fills, and the chart history."""
    t = tape(spark, d).select("symbol", "trade_id", "px", "qty", "conn", F.expr(f"timestampadd(MICROSECOND, ({_US}) div {FAST}, timestamp_ntz'1970-01-01 00:00:00')").alias("ts"))
    q = made_once(_minute(t), "fast")
    live, first = F.col("conn") != 0, F.col("trade_id") % 4
    known = _known(q).where(live | first.isin(0, 1))
    offset = (F.col("trade_id") * 7919 % 400_000 - 20_000).cast("int")
    twin = known.where(live & (F.col("trade_id") % 6 == 0)).select(
        "symbol", (F.col("trade_id") + AGAIN).alias("trade_id"), "px", "qty", F.timestamp_add("MICROSECOND", offset, F.col("ts")).alias("ts"), F.lit("REST").alias("source")
    )
    columns = ["symbol", "ts", "trade_id", "px", "qty", "source"]
    own = known.where(live | (first == 0)).withColumn("source", F.when(live, "WS").otherwise("REST"))
    trades = made_once(own.select(*columns).unionByName(_known(_minute(twin)).select(*columns)), "stored")
    path = shared_folder(spark, "store")
    minutes = bars_of_trades(_minute(trades).where("m % 17 <> 3"), "1m")
    H.create(trades, minutes.withColumn("volume", F.col("volume").cast("double")), path)
    history = bars_of_trades(q.where(~((F.col("conn") == 0) & (F.col("trade_id") % 20 == 2)) & (F.col("m") % 31 != 11)), "1m").withColumn("volume", F.col("volume").cast("double"))
    return path, known.where(~live & (first == 1)).select("symbol", "ts", "trade_id", "px", "qty"), made_once(history, "history")


def _healed(spark, d):
    path, dropped, history = stored(spark, d)
    H.heal(spark, path, dropped, history, overlap=OVERLAP, most=MOST)
    return path


@R.add(
    f"""WITH {TAPE}, {STORE} SELECT symbol, make_timestamp(m * 60000000) AS open_time, open, high, low, close, volume, n, 'LIVE' AS quality, revision FROM mins
UNION ALL SELECT y.symbol, make_timestamp(y.m * 60000000), y.open, y.high, y.low, y.close, y.volume, -1, 'HISTORY', 0 FROM dec JOIN hist y ON y.symbol = dec.symbol AND y.m BETWEEN a AND b WHERE code = 'REPAIRED'"""
)
def str_healed_minutes(spark, d):
    """Minutes after lost fills came back, second records were marked, and holes were filled from history."""
    rows = H.minutes_of(spark, _healed(spark, d))
    return rows.select("symbol", "open_time", "open", "high", "low", "close", "volume", F.coalesce("n", F.lit(-1)).alias("n"), "quality", "revision")


@R.add(f"WITH {TAPE}, {STORE} SELECT symbol, make_timestamp(a * 60000000) AS first, b - a + 1 AS minutes, code FROM dec")
def str_backfill_decisions(spark, d):
    """What became of each hole between stored minutes."""
    return spark.read.schema(H.REPAIRS).parquet(f"{_healed(spark, d)}/repairs").select("symbol", "first", "minutes", "code")
