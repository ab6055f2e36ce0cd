"""Healing of stored trades and minutes: lost fills, second records of a trade, wrong and missing minutes.

A store is a folder of tables: trades and minutes by day, revisions (the audit of minutes) and
repairs (what became of each hole).  Every step looks for what is wrong in the tables as they are,
writes the audit rows that are not there yet, and then replaces the days that change.  So a second
run changes nothing, and a run that was cut off is completed by the next one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.grid import later
from tapeloom.operators.bars import bars_of_trades
from tapeloom.operators.intervals import gaps
from tapeloom.operators.persist import made_once
from tapeloom.operators.reconcile import aligned, insert_new

VALUES = ["open", "high", "low", "close", "volume", "n"]
KEYS = ["symbol", "open_time"]
REVISIONS = "symbol string, open_time timestamp_ntz, revision int, action string, reason string, old string, new string"
REPAIRS = "symbol string, first timestamp_ntz, last timestamp_ntz, code string, minutes long"


def _days(rows: DataFrame, time: str) -> DataFrame:
    return rows.withColumn("day", F.to_date(time))


def _of_days(rows: DataFrame, dated: DataFrame) -> DataFrame:
    """rows of the days that dated has. The days, a row each, are sent to all tasks: dealt by day, all
    rows of a day would go to one task, be written as one file and be read by one task again."""
    return rows.join(F.broadcast(dated.select("day").distinct()), "day", "left_semi")


def _replace(rows: DataFrame, path: str) -> None:
    """Put rows, all of the days they are of, in the place of those days."""
    made = made_once(rows, "days")
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def _append_new(spark: SparkSession, rows: DataFrame, path: str, schema: str, keys: list[str]) -> None:
    """Append the rows whose keys the table does not have yet."""
    try:
        stored = spark.read.schema(schema).parquet(path)
    except AnalysisException:  # no such table yet
        stored = spark.createDataFrame([], schema)
    made_once(insert_new(stored, rows, keys), "audit").write.mode("append").parquet(path)


def create(trades: DataFrame, minutes: DataFrame, path: str) -> None:
    """A store with trades (symbol, ts, trade_id, px, qty, source) and minutes (KEYS, VALUES)."""
    _days(trades.withColumn("sources", F.lit(None).cast("string")), "ts").write.partitionBy("day").parquet(f"{path}/trades")
    _days(minutes.select(*KEYS, *VALUES, F.lit("LIVE").alias("quality"), F.lit(0).alias("revision")), "open_time").write.partitionBy("day").parquet(f"{path}/minutes")


def trades_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/trades")


def minutes_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/minutes")


def restore(spark: SparkSession, path: str, dropped: DataFrame) -> None:
    """Store the fills of a log of dropped ones (symbol, ts, trade_id, px, qty) that are not stored."""
    rows = dropped.select("symbol", "ts", "trade_id", "px", "qty", F.lit("RECOVERED").alias("source"), F.lit(None).cast("string").alias("sources"))
    fresh = made_once(_days(insert_new(trades_of(spark, path), rows, ["symbol", "trade_id"]), "ts"), "restored")
    fresh.write.mode("append").partitionBy("day").parquet(f"{path}/trades")


def _canonical(trades: DataFrame) -> DataFrame:
    """Trades without those that are marked as second records."""
    return trades.where(~F.coalesce(F.col("sources").startswith("DUPLICATE_OF:"), F.lit(False)))


def dedupe(spark: SparkSession, path: str, early: float, late: float) -> None:
    """Mark REST rows that are second records of a WS row: sources DUPLICATE_OF:<its trade_id>.

    Rows are aligned in order by price and quantity; a REST row may come early seconds before or late
    seconds after its twin. Marked rows stay; days without a new mark are not written.
    """
    trades = trades_of(spark, path)
    t = (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / 1e6).alias("t")
    keys = ["symbol", "px", "qty"]
    of = lambda source: trades.where((F.col("source") == source) & F.col("sources").isNull()).select(*keys, F.col("trade_id").alias("id"), t)
    twins = aligned(of("WS"), of("REST"), keys, early, late).select(F.col("right_id").alias("trade_id"), F.concat(F.lit("DUPLICATE_OF:"), "left_id").alias("_twin"))
    twins = made_once(twins, "twins")
    marked = trades.join(twins, "trade_id", "left").withColumn("_twin", F.when((F.col("source") == "REST") & F.col("sources").isNull(), F.col("_twin")))
    touched = marked.where("_twin is not null")
    _replace(_of_days(marked, touched).withColumn("sources", F.coalesce("sources", "_twin")).select(*trades.columns), f"{path}/trades")


def revise(spark: SparkSession, path: str, reason: str) -> None:
    """Make live minutes what their trades say: INSERTED, REVISED (revision + 1), or WITHDRAWN where no
    trade is left. Both versions go to revisions first; minutes from history are left alone."""
    stored = minutes_of(spark, path)
    fresh = bars_of_trades(_canonical(trades_of(spark, path)), "1m").select(*KEYS, F.struct(*(F.col(v).cast(stored.schema[v].dataType).alias(v) for v in VALUES)).alias("new"))
    own = stored.select(*KEYS, "quality", "revision", F.struct(*VALUES).alias("old"))
    both = own.join(fresh, KEYS, "full_outer").where("quality is null or quality = 'LIVE'")
    action = F.when(F.col("old").isNull(), "INSERTED").when(F.col("new").isNull(), "WITHDRAWN").when(~F.col("old").eqNullSafe(F.col("new")), "REVISED")
    changes = both.withColumn("action", action).where("action is not null")
    revision = F.when(F.col("action") == "INSERTED", 0).otherwise(F.col("revision") + 1)
    changes = made_once(changes.select(*KEYS, "action", revision.alias("revision"), "old", "new"), "changes")
    _audit(spark, path, changes, reason)
    _apply(spark, path, changes, "LIVE")


def _audit(spark: SparkSession, path: str, changes: DataFrame, reason: str) -> None:
    rows = changes.select(*KEYS, F.col("revision").cast("int").alias("revision"), "action", F.lit(reason).alias("reason"), F.to_json("old").alias("old"), F.to_json("new").alias("new"))
    _append_new(spark, rows, f"{path}/revisions", REVISIONS, [*KEYS, "revision", "action"])


def _apply(spark: SparkSession, path: str, changes: DataFrame, quality: str) -> None:
    """Write the days of changes anew, with what changes says of their minutes."""
    stored = minutes_of(spark, path)
    dated = _days(changes, "open_time")
    kept = _of_days(stored, dated).join(changes.select(*KEYS), KEYS, "left_anti")
    made = dated.where("new is not null").select(*KEYS, "new.*", F.lit(quality).alias("quality"), F.col("revision").cast("int").alias("revision"), "day")
    empty = dated.select("day").distinct().join(kept.select("day").unionByName(made.select("day")).distinct(), "day", "left_anti").collect()  # days that lose all
    _replace(kept.select(*stored.columns).unionByName(made.select(*stored.columns)), f"{path}/minutes")
    for row in empty:
        spark.createDataFrame([], stored.drop("day").schema).write.mode("overwrite").parquet(f"{path}/minutes/day={row['day']}")


def _minute_range(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(first, last, F.expr("interval 1 minute")))


def backfill(spark: SparkSession, path: str, history: DataFrame, overlap: int, most: int, least: int = 5, far: float = 0.001) -> None:
    """Fill holes between stored minutes from history (KEYS, VALUES) that agrees with what is stored.

    A hole of at most ``most`` minutes is filled (quality HISTORY, n unknown) if history has all of it
    and, in the ``overlap`` minutes before, at least ``least`` live minutes to compare, four of five of
    them equal, and no high or low off by more than the share far. repairs gets a row a hole: REPAIRED,
    TOO_LONG, INCOMPLETE, TOO_FEW, INEXACT, OUT_OF_RANGE. Stored minutes are never changed. A hole
    reads its own minutes and those before, so the join is as large as the holes.
    """
    stored = minutes_of(spark, path)
    found = gaps(stored, ["symbol"], "open_time", 60)
    holes = found.select("symbol", later("gap_start", 60).alias("first"), later(F.expr("timestampadd(SECOND, gap_s, gap_start)"), -60).alias("last"), F.floor(F.col("gap_s") / 60 - 1).cast("long").alias("minutes"))
    holes = made_once(holes, "holes")
    short = holes.where(F.col("minutes") <= most)
    chart = history.select(*KEYS, *(F.col(v).alias(f"h_{v}") for v in VALUES))
    needed = short.select("symbol", "first", _minute_range(F.col("first"), F.col("last")).alias("open_time")).join(chart, KEYS)
    needed = made_once(needed, "needed")
    before = short.select("symbol", "first", _minute_range(later("first", -60 * overlap), later("first", -60)).alias("open_time"))
    live = stored.where("quality = 'LIVE'").select(*KEYS, *VALUES)
    prices = ("open", "high", "low", "close")
    equal = F.lit(True)
    for v in prices:
        equal = equal & (F.col(v) == F.col(f"h_{v}"))
    off = F.greatest(*(F.abs(F.col(v) - F.col(f"h_{v}")) / F.col(f"h_{v}") for v in ("high", "low")))
    seen = before.join(live, KEYS).join(chart, KEYS).groupBy("symbol", "first").agg(F.count("*").alias("compared"), F.count_if(equal).alias("exact"), F.max(off).alias("off"))
    have = needed.groupBy("symbol", "first").agg(F.count("*").alias("have"))
    compared, exact = F.coalesce("compared", F.lit(0)), F.coalesce("exact", F.lit(0))
    code = (
        F.when(F.col("minutes") > most, "TOO_LONG").when(F.coalesce("have", F.lit(0)) < F.col("minutes"), "INCOMPLETE").when(compared < least, "TOO_FEW")
        .when(exact * 5 < compared * 4, "INEXACT").when(F.col("off") > far, "OUT_OF_RANGE").otherwise("REPAIRED")
    )
    decided = holes.join(seen, ["symbol", "first"], "left").join(have, ["symbol", "first"], "left").withColumn("code", code)
    decided = made_once(decided.select("symbol", "first", "last", "code", "minutes"), "decided")
    fills = needed.join(decided.where("code = 'REPAIRED'").select("symbol", "first"), ["symbol", "first"], "left_semi")
    kinds = stored.schema
    new = F.struct(*((F.lit(None) if v == "n" else F.col(f"h_{v}")).cast(kinds[v].dataType).alias(v) for v in VALUES))
    changes = made_once(fills.select(*KEYS, F.lit("INSERTED").alias("action"), F.lit(0).alias("revision"), F.lit(None).cast(new_type(kinds)).alias("old"), new.alias("new")), "changes")
    _append_new(spark, decided, f"{path}/repairs", REPAIRS, ["symbol", "first", "last", "code"])
    _audit(spark, path, changes, "BACKFILL")
    _apply(spark, path, changes, "HISTORY")


def new_type(kinds) -> str:
    return "struct<" + ",".join(f"{v}:{kinds[v].dataType.simpleString()}" for v in VALUES) + ">"


def heal(spark: SparkSession, path: str, dropped: DataFrame, history: DataFrame, early: float = 1.0, late: float = 3.0, overlap: int = 10, most: int = 30) -> None:
    """All steps in order: lost fills, second records, minutes by their trades, holes from history."""
    restore(spark, path, dropped)
    dedupe(spark, path, early, late)
    revise(spark, path, "TRADES")
    backfill(spark, path, history, overlap, most)
