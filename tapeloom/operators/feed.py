"""What a feed's connections prove: sessions, covered time, and trades released by proof.

rows: conn, at_us (receive time), id, kind (PONG, LOST or TRADE), sent_us (when the ping of a PONG
was sent). A LOST row ends the session of its connection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.portfolio import clusters
from tapeloom.operators.running import running_sum

DAY_US = 86_400_000_000


def with_sessions(rows: DataFrame) -> DataFrame:
    """rows with session: how often the connection was lost so far."""
    lost = F.when(F.col("kind") == "LOST", 1).otherwise(0)
    return running_sum(rows.withColumn("_day", F.floor(F.col("at_us") / DAY_US)), ["conn"], "_day", ["at_us", "id"], lost, "session").drop("_day")


def proofs(rows: DataFrame, safety_us: int) -> DataFrame:
    """conn, session, start, end, proven, ended of the rows of with_sessions.

    start: the first pong's arrival and the safety; end: the last ping's sending less the safety,
    start if that is earlier; proven: the last ping's sending, before which all that the server
    sent has arrived; all null without a pong. ended: the connection was lost later.
    """
    pong = F.col("kind") == "PONG"
    by_session = rows.groupBy("conn", "session").agg(
        (F.min(F.when(pong, F.col("at_us"))) + safety_us).alias("start"), F.max(F.when(pong, F.col("sent_us"))).alias("proven")
    )
    last = by_session.groupBy("conn").agg(F.max("session").alias("_last"))
    end = F.when(F.col("proven").isNotNull(), F.greatest("start", F.col("proven") - safety_us))
    return by_session.join(last, "conn").withColumn("end", end).withColumn("ended", F.col("session") < F.col("_last")).drop("_last")


def coverage(proven: DataFrame, width_us: int = 7 * DAY_US) -> DataFrame:
    """start, end: the time that some connection covers; spans that overlap or touch are one."""
    spans = proven.where("start is not null").select(F.concat_ws(":", "conn", "session").alias("id"), "start", "end", (F.col("end") + 1).alias("_after"))
    return clusters(spans, [], "start", "_after", width_us).groupBy("cluster").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("cluster")


def released(receipts: DataFrame, proven: DataFrame) -> DataFrame:
    """trade_id, state of trades by their receipts (trade_id, conn, session, at_us) on connections.

    PROVEN: a connection that had it by its proven time covers its arrival; IN_GAP: it had it before
    its cover began; ORPHAN: none proves it and all have ended; PENDING: one still may.
    """
    r = receipts.join(proven, ["conn", "session"])
    shown = F.coalesce(F.col("at_us") <= F.col("proven"), F.lit(False))
    each = r.select("trade_id", shown.alias("shown"), (shown & (F.col("start") <= F.col("at_us"))).alias("covered"), "ended")
    by_trade = each.groupBy("trade_id").agg(F.bool_or("covered").alias("c"), F.bool_or("shown").alias("s"), F.bool_and("ended").alias("e"))
    return by_trade.select("trade_id", F.when(F.col("c"), "PROVEN").when(F.col("s"), "IN_GAP").when(F.col("e"), "ORPHAN").otherwise("PENDING").alias("state"))
