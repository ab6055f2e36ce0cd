"""Coverage of a feed and release of its trades as a stream, by proofs that move on.

A pong proves that all that the server sent before its ping has arrived.  State is kept by
connection: when it was lost, what its sessions cover so far, and receipts that no proof covers yet.
Control rows and trades come in one stream; pongs may come late, losses and trades come in order.
proofs() holds a connection's state and the rows of a batch in one task; prove_batches() keeps the
same state in tables, so that few connections with many rows are dealt over all tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.feed import DAY_US
from tapeloom.operators.persist import made_once
from tapeloom.operators.running import running_sum
from tapeloom.streaming.held import ROCKS
from tapeloom.streaming.minutes import each_batch

OUT = "kind string, conn long, session long, trade_id long, start_us long, proven_us long"


class Proofs(StatefulProcessor):
    """State by connection: losses, spans of sessions, receipts that are not covered."""

    def __init__(self, safety_us: int, keep_us: int):
        self.safety, self.keep = safety_us, keep_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.lost = handle.getListState("lost", "at_us long, id long, session long")
        self.spans = handle.getListState("spans", "session long, start_us long, proven_us long")
        self.receipts = handle.getListState("receipts", "trade_id long, session long, at_us long, shown boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        conn = int(key[0])
        frame = pd.concat(list(rows)).sort_values(["at_us", "id"])
        losses = sorted(tuple(x) for x in self.lost.get()) if self.lost.exists() else []
        spans = {s: (a, z) for s, a, z in self.spans.get()} if self.spans.exists() else {}
        held = [tuple(r) for r in self.receipts.get()] if self.receipts.exists() else []
        out, moved = [], set()

        def session(at: int, number: int) -> int:
            k = bisect_right(losses, (at, number, 1 << 62))
            return losses[k - 1][2] if k else losses[0][2] - 1 if losses else 0

        for row in frame.itertuples():
            at, number = int(row.at_us), int(row.id)
            if row.kind == "LOST":
                if (at, number) not in {x[:2] for x in losses[-1:]}:  # one that comes again
                    losses.append((at, number, (losses[-1][2] if losses else 0) + 1))
                    out.append(("ENDED", conn, losses[-1][2] - 1, None, None, None))
                continue
            own = session(at, number)
            if row.kind == "PONG":
                before = spans.get(own)
                start, proven = at + self.safety, int(row.sent_us)
                spans[own] = (min(start, before[0]), max(proven, before[1])) if before else (start, proven)
                if spans[own] != before:
                    moved.add(own)
            else:
                held.append((number, own, at, False))
                out.append(("RECEIPT", conn, own, number, None, None))
        out += [("SPAN", conn, s, None, *spans[s]) for s in sorted(moved)]
        still = []
        for number, own, at, shown in held:
            start, proven = spans.get(own, (0, -1))
            if at <= proven:
                if start <= at:
                    out.append(("COVERED", conn, own, number, None, None))
                    continue
                if not shown:
                    out.append(("SHOWN", conn, own, number, None, None))
                shown = True
            still.append((number, own, at, shown))
        # sessions that ended long ago get no more pongs
        oldest = (int(frame.at_us.max()) if len(frame) else 0) - self.keep
        gone = max((s - 1 for at, _, s in losses if at < oldest), default=-1)
        still = [r for r in still if r[1] > gone]
        for state, values in (
            (self.lost, [x for x in losses if x[2] >= gone]), (self.spans, [(s, a, z) for s, (a, z) in spans.items() if s > gone]), (self.receipts, still),
        ):
            if values:
                state.put(values)
            else:
                state.clear()
        names = [field.split()[0] for field in OUT.split(", ")]
        yield pd.DataFrame(out, columns=names).astype({n: "Int64" for n in names[1:]})

    def close(self) -> None:
        pass


def proofs(rows: DataFrame, safety_us: int, keep_us: int) -> DataFrame:
    """What a feed's rows (conn, at_us, id, kind PONG, LOST or TRADE, sent_us) prove, as it becomes known.

    kinds: SPAN (a session's start and proven time so far), ENDED (a session whose connection was
    lost), RECEIPT (a trade came), SHOWN (a proof has passed a trade that came before the cover began),
    COVERED (a trade that came under cover). A pong may come late as long as its session ended no
    longer than keep_us before the last row; then its receipts leave the state.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy("conn").transformWithStateInPandas(Proofs(safety_us, keep_us), OUT, "Append", "None")


ROWS = "conn long, at_us long, id long, session long, kind string, batch int"
SPANS = "conn long, session long, start_us long, proven_us long, batch int"
MARKS = "kind string, conn long, session long, trade_id long, batch int"


def _table(spark: SparkSession, path: str, schema: str, before: int) -> DataFrame:
    """What the batches before this one wrote."""
    if not before:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).where(F.col("batch") < before)


def _with_sessions(rows: DataFrame, losses: DataFrame, first: int) -> DataFrame:
    """Rows of a batch, whose first is at first, with session: how often their connection was lost so
    far. losses: those of earlier batches, with the session that each began."""
    names = ["conn", "at_us", "id"]
    lost = rows.where("kind = 'LOST'").dropDuplicates(names).join(losses.where(F.col("at_us") >= first).select(*names), names, "left_anti")
    known = losses.where(F.col("at_us") >= first).select(*names, F.lit("KNOWN").alias("kind"), F.lit(None).cast("long").alias("sent_us"))
    every = rows.where("kind <> 'LOST'").unionByName(lost.select(*rows.columns)).unionByName(known)
    loss = F.col("kind").isin("LOST", "KNOWN")
    chunked = every.withColumn("_day", F.floor(F.col("at_us") / DAY_US))
    counted = running_sum(chunked, ["conn"], "_day", ["at_us", "id", ~loss], F.when(loss, 1).otherwise(0), "_count")
    begun = losses.where(F.col("at_us") < first).groupBy("conn").agg(F.max("session").alias("_begun"))
    numbered = counted.where("kind <> 'KNOWN'").join(F.broadcast(begun), "conn", "left")
    return numbered.select(*names, "kind", "sent_us", (F.col("_count") + F.coalesce("_begun", F.lit(0))).cast("long").alias("session"))


def prove_batches(stream: DataFrame, path: str, checkpoint: str, safety_us: int, keep_us: int) -> None:
    """What proofs() finds, batch by batch, until all input that is there was read; events_of() gives it.

    Below path each batch has folders of its own, which it overwrites if it comes again: rows (each
    with its session, by kind), spans (sessions whose proof moved, as they are now) and marks
    (receipts that it finds SHOWN or COVERED). A batch looks at its own rows, and at earlier receipts
    of the sessions that moved.
    """
    spark = stream.sparkSession

    def work(rows: DataFrame, number: int) -> None:
        rows = rows.select(F.col("conn").cast("long").alias("conn"), "at_us", "id", "kind", "sent_us")
        ends = rows.agg(F.min("at_us").alias("first"), F.max("at_us").alias("last")).first()
        stored = _table(spark, f"{path}/rows", ROWS, number)
        losses = stored.where("kind = 'LOST'")
        own = f"{path}/rows/batch={number}"
        first = ends["first"] if ends["first"] is not None else 0
        _with_sessions(rows, losses, first).write.mode("overwrite").partitionBy("kind").parquet(own)
        fresh = spark.read.schema("conn long, at_us long, id long, session long, sent_us long, kind string").parquet(own)
        losses = losses.select("conn", "at_us", "session").unionByName(fresh.where("kind = 'LOST'").select("conn", "at_us", "session"))

        # sessions that ended long ago get no more pongs
        gone = losses.where(F.col("at_us") < (ends["last"] or 0) - keep_us).groupBy("conn").agg(F.max("session").alias("_kept"))
        pongs = fresh.where("kind = 'PONG'").join(F.broadcast(gone), "conn", "left").where("_kept is null or session >= _kept")
        pongs = pongs.groupBy("conn", "session").agg((F.min("at_us") + safety_us).alias("_start"), F.max("sent_us").alias("_proven"))
        before = _table(spark, f"{path}/spans", SPANS, number).groupBy("conn", "session").agg(F.min("start_us").alias("_start0"), F.max("proven_us").alias("_proven0"))
        now = before.join(pongs, ["conn", "session"], "full_outer").select(
            "conn", "session", "_start0", "_proven0", F.least("_start", "_start0").alias("start_us"), F.greatest("_proven", "_proven0").alias("proven_us")
        )
        moves = F.col("_start0").isNull() | (F.col("start_us") < F.col("_start0")) | (F.col("proven_us") > F.col("_proven0"))
        now = made_once(now.withColumn("moved", moves), "sessions")
        now.where("moved").select("conn", "session", "start_us", "proven_us").write.mode("overwrite").parquet(f"{path}/spans/batch={number}")

        trade = F.col("kind") == "TRADE"
        names = ["conn", "session", "at_us", "id"]
        none = F.lit(None).cast("long")
        new = fresh.where(trade).select(*names).join(now.withColumns({"_start0": none, "_proven0": none}).drop("moved"), ["conn", "session"])
        old = stored.where(trade).select(*names).join(now.where("moved").drop("moved"), ["conn", "session"])
        passed = lambda proven: F.coalesce(F.col("at_us") <= F.col(proven), F.lit(False))
        held = lambda start, proven: passed(proven) & (F.col(start) <= F.col("at_us"))
        mark = F.when(held("start_us", "proven_us"), F.when(~F.coalesce(held("_start0", "_proven0"), F.lit(False)), "COVERED")).when(passed("proven_us") & ~passed("_proven0"), "SHOWN")
        marks = new.unionByName(old).select(mark.alias("kind"), "conn", "session", F.col("id").alias("trade_id")).where("kind is not null")
        marks.write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    each_batch(stream, work, checkpoint, "append")


def events_of(spark: SparkSession, path: str) -> DataFrame:
    """The events that prove_batches() found, in the form of those of proofs()."""
    rows, spans = spark.read.schema(ROWS).parquet(f"{path}/rows"), spark.read.schema(SPANS).parquet(f"{path}/spans")
    none = F.lit(None).cast("long")
    of = lambda kind, session, trade, start, proven: (F.lit(kind).alias("kind") if isinstance(kind, str) else kind, "conn", session.alias("session"), trade.alias("trade_id"), start.alias("start_us"), proven.alias("proven_us"))
    session = F.col("session")
    ended = rows.where("kind = 'LOST'").select(*of("ENDED", session - 1, none, none, none))
    receipts = rows.where("kind = 'TRADE'").select(*of("RECEIPT", session, F.col("id"), none, none))
    moved = spans.select(*of("SPAN", session, none, F.col("start_us"), F.col("proven_us")))
    marks = spark.read.schema(MARKS).parquet(f"{path}/marks").select(*of(F.col("kind"), session, F.col("trade_id"), none, none))
    return ended.unionByName(receipts).unionByName(moved).unionByName(marks)


def spans_of(events: DataFrame, safety_us: int) -> DataFrame:
    """conn, session, start, end of the spans that events show; coverage() of operators/feed takes them."""
    last = events.where("kind = 'SPAN'").groupBy("conn", "session").agg(F.min("start_us").alias("start"), F.max("proven_us").alias("proven"))
    return last.select("conn", "session", "start", F.greatest("start", F.col("proven") - safety_us).alias("end"))


def releases(events: DataFrame) -> DataFrame:
    """trade_id, state (PROVEN, IN_GAP, ORPHAN, PENDING) of the trades that came so far."""
    ended = events.where("kind = 'ENDED'").select("conn", "session", F.lit(True).alias("ended")).distinct()
    of = lambda kind: F.bool_or(F.col("kind") == kind)
    by_trade = (
        events.where("trade_id is not null").join(ended, ["conn", "session"], "left").groupBy("trade_id")
        .agg(of("COVERED").alias("c"), of("SHOWN").alias("s"), F.bool_and(F.coalesce("ended", F.lit(False))).alias("e"))
    )
    return by_trade.select("trade_id", F.when(F.col("c"), "PROVEN").when(F.col("s"), "IN_GAP").when(F.col("e"), "ORPHAN").otherwise("PENDING").alias("state"))
