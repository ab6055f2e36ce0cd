"""Queries of feeds: coverage by proof, released trades, several sinks, resumed trades, integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.grid import seconds
from tapeloom.operators import feed
from tapeloom.operators.intervals import gaps
from tapeloom.operators.persist import made_once, shared_folder
from tapeloom.plans.base import TAPE, Registry, bars_sql, minutes
from tapeloom.plans.streams import _deliveries
from tapeloom.sources.tape import table, tape
from tapeloom.streaming import minutes as S

R = Registry()
SAFETY = 500_000

FEED = f"""ctl AS (
  SELECT user_id % 3 AS conn, epoch_us(ts) AS at_us, event_id AS id, event_id AS trade_id, CASE event_type WHEN 'view' THEN 'PONG' WHEN 'error' THEN 'LOST' ELSE 'TRADE' END AS kind, epoch_us(ts) - 1000000 AS sent_us FROM events
  UNION ALL SELECT (user_id + 1) % 3, epoch_us(ts) + 2000000, event_id, event_id, 'TRADE', NULL FROM events WHERE event_type NOT IN ('view', 'error') AND event_id % 2 = 0
), ss AS (SELECT *, sum(CASE WHEN kind = 'LOST' THEN 1 ELSE 0 END) OVER (PARTITION BY conn ORDER BY at_us, id) AS session FROM ctl),
pf0 AS (SELECT conn, session, min(at_us) FILTER (WHERE kind = 'PONG') + {SAFETY} AS s, max(sent_us) FILTER (WHERE kind = 'PONG') AS proven FROM ss GROUP BY ALL),
pf AS (SELECT *, greatest(s, proven - {SAFETY}) AS e, session < max(session) OVER (PARTITION BY conn) AS ended FROM pf0)"""


def feed_rows(spark, d):
    """Control rows and receipts of three connections; every other trade comes on two of them."""
    e = table(spark, d, "events").withColumn("at_us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"))
    kind = F.when(F.col("event_type") == "view", "PONG").when(F.col("event_type") == "error", "LOST").otherwise("TRADE")
    own = e.select((F.col("user_id") % 3).alias("conn"), "at_us", F.col("event_id").alias("id"), kind.alias("kind"), (F.col("at_us") - 1_000_000).alias("sent_us"))
    again = e.where("event_type not in ('view', 'error') and event_id % 2 = 0").select(
        ((F.col("user_id") + 1) % 3).alias("conn"), (F.col("at_us") + 2_000_000).alias("at_us"), F.col("event_id").alias("id"), F.lit("TRADE").alias("kind"), F.lit(None).cast("long").alias("sent_us")
    )
    return own.unionByName(again)


def _feed(spark, d):
    rows = made_once(feed.with_sessions(feed_rows(spark, d)), "feed")
    return rows, made_once(feed.proofs(rows, SAFETY), "proofs")


COVERAGE = f"""WITH {FEED}, o AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM pf WHERE s IS NOT NULL),
i AS (SELECT s, e, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT min(s) AS start_us, max(e) AS end_us FROM i GROUP BY island"""


@R.add(COVERAGE)
def str_coverage(spark, d):
    return feed.coverage(_feed(spark, d)[1]).select(F.col("start").alias("start_us"), F.col("end").alias("end_us"))


RELEASED = f"""WITH {FEED}, r AS (SELECT ss.trade_id, coalesce(at_us <= proven, false) AS shown, coalesce(at_us <= proven AND s <= at_us, false) AS covered, ended FROM ss JOIN pf USING (conn, session) WHERE kind = 'TRADE')
SELECT trade_id, CASE WHEN bool_or(covered) THEN 'PROVEN' WHEN bool_or(shown) THEN 'IN_GAP' WHEN bool_and(ended) THEN 'ORPHAN' ELSE 'PENDING' END AS state FROM r GROUP BY trade_id"""


@R.add(RELEASED)
def str_released_trades(spark, d):
    rows, proven = _feed(spark, d)
    return feed.released(rows.where("kind = 'TRADE'").select(F.col("id").alias("trade_id"), "conn", "session", "at_us"), proven)


@R.add(
    f"""WITH {TAPE} SELECT 'journal' AS target, count(*) AS n, sum(trade_id)::BIGINT AS ids FROM tape
UNION ALL SELECT 'trades', count(*), sum(trade_id)::BIGINT FROM tape UNION ALL SELECT 'large', count(*), sum(trade_id)::BIGINT FROM tape WHERE qty > 100"""
)
def snk_fan_out(spark, d):
    """Each batch of trades goes to a journal of JSON lines, a table, and a table of large trades."""
    folder = shared_folder(spark, "stream")
    trades = F.struct(F.lit("TRADE").alias("kind"), "symbol", "trade_id", "px")
    sinks = {"journal": lambda rows: rows.select(F.to_json(trades).alias("line")), "trades": lambda rows: rows.select("symbol", "trade_id", "px"), "large": lambda rows: rows.where("qty > 100").select("symbol", "trade_id", "px")}
    S.fan_out(_deliveries(spark, d, folder), sinks, f"{folder}/out", f"{folder}/state")
    number = {"journal": F.get_json_object("line", "$.trade_id").cast("long")}
    counts = [spark.read.parquet(f"{folder}/out/{n}").agg(F.count("*").alias("n"), F.sum(number.get(n, F.col("trade_id"))).alias("ids")).select(F.lit(n).alias("target"), "n", "ids") for n in sinks]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@R.add(
    f"""WITH {TAPE}, {bars_sql('m', '1 minute')}, g AS (SELECT symbol, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) AS a, open_time AS b FROM m),
u AS (SELECT 'GAP' AS kind, symbol AS subject, a AS moment, epoch(b)::BIGINT - epoch(a)::BIGINT AS size FROM g WHERE epoch(b) - epoch(a) > 3600
  UNION ALL SELECT 'LOST', (user_id % 3)::VARCHAR, ts, 0 FROM events WHERE event_type = 'error')
SELECT kind, subject, count(*) AS n, sum(size)::BIGINT AS total, max(moment) AS latest FROM u GROUP BY ALL"""
)
def snk_operational_rows(spark, d):
    """Gaps and lost connections are appended to one table of what happened."""
    path = shared_folder(spark, "operations")
    found = gaps(minutes(spark, d), ["symbol"], "open_time", 3600)
    rows = found.select(F.lit("GAP").alias("kind"), F.col("symbol").alias("subject"), F.col("gap_start").alias("moment"), F.col("gap_s").cast("long").alias("size"))
    lost = table(spark, d, "events").where("event_type = 'error'").select(F.lit("LOST").alias("kind"), (F.col("user_id") % 3).cast("string").alias("subject"), F.col("ts").alias("moment"), F.lit(0).cast("long").alias("size"))
    for part in (rows, lost):
        part.write.mode("append").parquet(path)
    return spark.read.parquet(path).groupBy("kind", "subject").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.max("moment").alias("latest"))


@R.add(
    f"""WITH {TAPE}, {bars_sql('live', '1 minute', where='WHERE conn <> 0')}, {bars_sql('hist', '1 minute')},
b AS (SELECT symbol, open_time, l.n AS ln, h.n AS hn, l.close AS lc, h.close AS hc FROM hist h LEFT JOIN live l USING (symbol, open_time)),
q AS (SELECT symbol, 'quality' AS section, CASE WHEN ln IS NULL THEN 'MISSING' WHEN ln < hn THEN 'PARTIAL' ELSE 'WHOLE' END AS detail FROM b UNION ALL SELECT symbol, 'revisions', CASE WHEN lc <> hc THEN 'CLOSE' ELSE 'VOLUME' END FROM b WHERE ln < hn)
SELECT symbol, section, detail, count(*) AS n FROM q GROUP BY ALL
UNION ALL SELECT symbol, 'latest', 'minute', max(epoch(open_time))::BIGINT FROM hist GROUP BY symbol
UNION ALL SELECT symbol, 'latest', 'trade', max(trade_id) FROM tape GROUP BY symbol"""
)
def vw_integrity(spark, d):
    live = minutes(spark, d, "live").select("symbol", "open_time", F.col("n").alias("ln"), F.col("close").alias("lc"))
    both = minutes(spark, d).join(live, ["symbol", "open_time"], "left")
    quality = F.when(F.col("ln").isNull(), "MISSING").when(F.col("ln") < F.col("n"), "PARTIAL").otherwise("WHOLE")
    revision = F.when(F.col("ln") < F.col("n"), F.when(F.col("lc") != F.col("close"), "CLOSE").otherwise("VOLUME"))
    notes = F.array(F.struct(F.lit("quality").alias("section"), quality.alias("detail")), F.struct(F.lit("revisions").alias("section"), revision.alias("detail")))
    counts = both.select("symbol", F.inline(notes)).where("detail is not null").groupBy("symbol", "section", "detail").agg(F.count("*").alias("n"))

    def latest(rows, detail, value):
        return rows.groupBy("symbol").agg(F.max(value).cast("long").alias("n")).select("symbol", F.lit("latest").alias("section"), F.lit(detail).alias("detail"), "n")

    return counts.unionByName(latest(minutes(spark, d), "minute", seconds("open_time"))).unionByName(latest(tape(spark, d), "trade", F.col("trade_id")))
