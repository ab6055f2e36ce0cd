"""Sources, state columns, repair rules and operational views as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.grid import later, seconds
from tapeloom.operators.passage import BLOCK, first_passage
from tapeloom.operators.persist import made_once
from tapeloom.operators.reconcile import insert_new


def parse_trades(messages: DataFrame, symbols: list[str]) -> DataFrame:
    """trade_id, symbol, px of the trades of symbols in messages (raw); anything else gives no row:
    other kinds of messages, other symbols, malformed text, and prices that are not above 0."""
    m = F.from_json("raw", "e string, s string, t long, p string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = messages.select(m.alias("m")).where("m._bad is null and m.e = 'trade'")
    priced = rows.where(F.col("m.s").isin(symbols)).select(F.col("m.t").alias("trade_id"), F.col("m.s").alias("symbol"), F.expr("try_cast(m.p as double)").alias("px"))
    return priced.where("px > 0")


def valid_batches(bars: DataFrame, batch: list[str]) -> DataFrame:
    """bars of the batches that have no malformed bar, with synthetic and n: a bar without volume is
    synthetic, must be flat, and has no trade; the count of any other bar is unknown."""
    flat = (F.col("high") == F.col("low")) & (F.col("open") == F.col("close"))
    ordered = (F.col("low") <= F.least("open", "close")) & (F.col("high") >= F.greatest("open", "close"))
    valid = F.coalesce(ordered & ((F.col("volume") > 0) | ((F.col("volume") == 0) & flat)), F.lit(False))
    good = bars.withColumn("_valid", valid).groupBy(*batch).agg(F.bool_and("_valid").alias("_whole")).where("_whole").select(*batch)
    synthetic = F.col("volume") == 0
    return bars.join(good, batch, "left_semi").withColumn("synthetic", synthetic).withColumn("n", F.when(synthetic, 0))


def since_resume(trades: DataFrame, done: DataFrame, sources: list[str]) -> DataFrame:
    """Trades from the end of their market's last final minute on, of the sources named; a null
    source is kept, a duplicate's mark is not."""
    at = F.broadcast(done.groupBy("symbol").agg(later(F.max("open_time"), 60).alias("resume_at")))
    own = F.col("source").isNull() | (F.col("source").isin(sources) & ~F.col("source").startswith("DUPLICATE_OF:"))
    return trades.join(at, "symbol").where((F.col("ts") >= F.col("resume_at")) & own)


def append_new(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> None:
    """Append the rows whose keys the table at path has not; doing it again adds nothing."""
    insert_new(spark.read.parquet(path), rows, keys).select(*spark.read.parquet(path).columns).write.mode("append").parquet(path)


def merged_status(beats: DataFrame, key: str, time: str, status: str) -> DataFrame:
    """key, at, beats, status: the maps of a key merged, later values first."""
    entry = beats.select(key, time, F.explode_outer(status).alias("k", "v"))
    newest = entry.where("k is not null").groupBy(key, "k").agg(F.max_by("v", time).alias("v"))
    maps = newest.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("status"))  # a few keys each
    return beats.groupBy(key).agg(F.max(time).alias("at"), F.count("*").alias("beats")).join(maps, key, "left")


def zone_status(lookback: int) -> tuple[Column, Column]:
    """Status and last bar of a zone with tested_idx, mitigated_idx, and last, its market's last bar."""
    over = F.col("created_idx") + lookback < F.col("last")
    status = F.when(F.col("mitigated_idx").isNotNull(), "MITIGATED").when(over, "EXPIRED").when(F.col("tested_idx").isNotNull(), "TESTED").otherwise("FRESH")
    return status, F.coalesce("mitigated_idx", F.when(over, F.col("created_idx") + lookback).otherwise(F.col("last")))


def live_state() -> Column:
    """What a forming bar with high and low does to a zone with dir, bottom and top."""
    long = F.col("dir") == 1
    filled = F.when(long, F.col("low") <= F.col("bottom")).otherwise(F.col("high") >= F.col("top"))
    touched = F.when(long, F.col("low") <= F.col("top")).otherwise(F.col("high") >= F.col("bottom"))
    return F.when(filled, "FILLED").when(touched, "TOUCHED").otherwise("UNTOUCHED")


def sequence_classes(trades: DataFrame, keys: list[str], price: str, at: str) -> DataFrame:
    """keys, n, class of the trades that share a sequence number."""
    one = trades.groupBy(*keys).agg(F.count("*").alias("n"), F.min(price).alias("p0"), F.max(price).alias("p1"), F.min(at).alias("t0"), F.max(at).alias("t1"))
    kind = F.when(F.col("n") == 1, "SINGLE").when(F.col("t0") != F.col("t1"), "TIMESTAMP_CONFLICT").when(F.col("p0") != F.col("p1"), "MULTI_FILL").otherwise("REPEATED")
    return one.select(*keys, "n", kind.alias("class"))


def extremes_since(bars: DataFrame, since: DataFrame) -> DataFrame:
    """symbol, high, low, bars of the bars from since (symbol, since) on."""
    own = bars.join(F.broadcast(since), "symbol").where(F.col("open_time") >= F.col("since"))
    return own.groupBy("symbol").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.count("*").alias("bars"))


def nearest_ranks(rows: DataFrame, group: str, value: str, p: float) -> DataFrame:
    """group, inner_p90 and outer_p90: the values of rank int(p * (n - 1)) and int(p * n), from 0.

    Equal values are counted first, and running counts go over the distinct values only.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(value)
    upto = counts.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum("c").over(Window.partitionBy(group))
    inner, outer = F.floor(p * (n - 1)), F.least(n - 1, F.floor(p * n))
    at = upto.select(group, value, (F.col("upto") > inner).alias("i"), (F.col("upto") > outer).alias("o"))
    return at.groupBy(group).agg(F.min(F.when(F.col("i"), F.col(value))).alias("inner_p90"), F.min(F.when(F.col("o"), F.col(value))).alias("outer_p90"))


def range_extremes(spans: DataFrame, bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """spans (id, symbol, lo, hi) with the highest high and lowest low of their bars.

    bars are numbered by idx from 0 without holes. A span over several blocks of bars reads four rows
    at most, whatever its length: what its first block has from lo on, what its last block has up to
    hi, and two runs of whole blocks that overlap, of the longest power of two that fits between. A
    span within one block reads its bars. Runs of each length are made from those of half of it, by
    joins on the block; only as many lengths as the longest span needs.
    """
    numbered = bars.select("symbol", "idx", "high", "low", F.floor(F.col("idx") / block).alias("at"))
    own = Window.partitionBy("symbol", "at").orderBy("idx")
    upto, onward = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    row = lambda kind, at, high, low: (F.lit(kind).alias("kind"), at.alias("at"), high.alias("high"), low.alias("low"))
    tables = numbered.select("symbol", *row(-1, F.col("idx"), F.col("high"), F.col("low")))
    tables = tables.unionByName(numbered.select("symbol", *row(-2, F.col("idx"), F.max("high").over(onward), F.min("low").over(onward))))
    tables = tables.unionByName(numbered.select("symbol", *row(-3, F.col("idx"), F.max("high").over(upto), F.min("low").over(upto))))
    runs = made_once(numbered.groupBy("symbol", "at").agg(F.max("high").alias("high"), F.min("low").alias("low")), "blocks")
    whole = bars.groupBy("symbol").agg(F.max("idx").alias("_end"))
    asked = spans.select("id", "symbol", "lo", "hi").join(F.broadcast(whole), "symbol").withColumn("lo", F.greatest("lo", F.lit(0))).withColumn("hi", F.least("hi", "_end")).where("hi >= lo")
    first, last = F.floor(F.col("lo") / block), F.floor(F.col("hi") / block)
    between = last - first - 1
    power = F.floor(F.log2(F.greatest(between, F.lit(1)).cast("double")) + 1e-9).cast("int")
    longest = made_once(asked.select("*", first.alias("first"), last.alias("last"), between.alias("between"), power.alias("power")), "spans")
    levels = longest.agg(F.max(F.when(F.col("between") > 0, F.col("power")))).first()[0]
    for level in range(0 if levels is None else levels + 1):
        tables = tables.unionByName(runs.select("symbol", *row(level, F.col("at"), F.col("high"), F.col("low"))))
        half = runs.select("symbol", (F.col("at") - (1 << level)).alias("at"), F.col("high").alias("_high"), F.col("low").alias("_low"))
        if level < levels:
            runs = made_once(runs.join(half, ["symbol", "at"]).select("symbol", "at", F.greatest("high", "_high").alias("high"), F.least("low", "_low").alias("low")), "runs")
    part = lambda kind, at: F.struct((F.lit(kind) if isinstance(kind, int) else kind).alias("kind"), at.cast("long").alias("at"))
    inner = F.when(F.col("between") > 0, F.array(part(F.col("power"), F.col("first") + 1), part(F.col("power"), F.col("last") - F.pow(F.lit(2.0), F.col("power")).cast("long")))).otherwise(F.array())
    ends = F.array(part(-2, F.col("lo")), part(-3, F.col("hi")))
    single = F.transform(F.sequence("lo", "hi"), lambda x: part(-1, x))
    reads = F.when(F.col("first") == F.col("last"), single).otherwise(F.concat(ends, inner))
    met = longest.select("id", "symbol", F.explode(reads).alias("x")).select("id", "symbol", "x.*")
    found = met.join(tables, ["symbol", "kind", "at"]).groupBy("id").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    return spans.join(found, "id")


def switch_lag(flips: DataFrame, switches: DataFrame, within: int) -> DataFrame:
    """symbol, idx, lag: bars from the last switch of the same sign, less than within back, to a flip."""
    own = F.floor(F.col("idx") / within)
    a = flips.withColumn("_b", own).alias("a")
    b = switches.withColumn("_b", F.explode(F.array(own, own + 1))).alias("b")
    same = (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.s") == F.col("b.s")) & (F.col("a._b") == F.col("b._b"))
    near = a.join(b, same).where("b.idx <= a.idx and b.idx > a.idx - " + str(within))
    return near.groupBy("a.symbol", "a.idx").agg((F.col("a.idx") - F.max("b.idx")).alias("lag"))


def covered(minutes: DataFrame, spans: DataFrame, length: int, block: int = 86_400) -> DataFrame:
    """minutes (symbol, open_time) with covered: does one span (symbol, a, b) hold the whole minute?
    Spans are disjoint; both meet by blocks of time."""
    m = minutes.withColumn("_b", F.floor(seconds("open_time") / block)).alias("m")
    s = spans.withColumn("_b", F.explode(F.sequence(F.floor(seconds("a") / block), F.floor(seconds("b") / block)))).alias("s")
    holds = (F.col("m.symbol") == F.col("s.symbol")) & (F.col("m._b") == F.col("s._b")) & (F.col("s.a") <= F.col("m.open_time"))
    inside = m.join(s, holds & (seconds(F.col("s.b")) >= seconds(F.col("m.open_time")) + length), "left_semi").select("symbol", "open_time", F.lit(True).alias("covered"))
    return minutes.join(inside, ["symbol", "open_time"], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def history_verdict(live: DataFrame, chart: DataFrame, least: int = 5, far: float = 0.001) -> DataFrame:
    """symbol, compared, exact, verdict: may chart minutes stand for missing live ones?"""
    c = chart.select("symbol", "open_time", *(F.col(x).alias(f"c_{x}") for x in ("high", "low", "close")))
    both = live.join(c, ["symbol", "open_time"]).groupBy("symbol").agg(
        F.count("*").alias("compared"), F.count_if(F.col("close") == F.col("c_close")).alias("exact"),
        F.greatest(*(F.max(F.abs(F.col(x) - F.col(f"c_{x}")) / F.col(f"c_{x}")) for x in ("high", "low"))).alias("off"),
    )
    few, inexact = F.col("compared") < least, F.col("exact") * 5 < F.col("compared") * 4
    return both.select("symbol", "compared", "exact", F.when(few, "TOO_FEW").when(inexact, "INEXACT").when(F.col("off") > far, "OUT_OF_RANGE").otherwise("OK").alias("verdict"))


def bootstrap_plan(bars: DataFrame, most: int) -> DataFrame:
    """symbol, open_time, kind, close, size: the bars, flat bars in holes of at most ``most`` minutes,
    and a GAP row for each longer hole."""
    after = F.lead("open_time").over(Window.partitionBy("symbol").orderBy("open_time"))
    missing = F.expr("timestampdiff(SECOND, open_time, nxt) div 60 - 1")
    g = bars.withColumn("nxt", after).withColumn("missing", F.coalesce(missing, F.lit(0)))
    step = lambda i, kind, size: F.struct(F.timestamp_add("MINUTE", i, F.col("open_time")).alias("open_time"), F.lit(kind).alias("kind"), size.cast("long").alias("size"))
    own = F.array(step(F.lit(0), "BAR", F.lit(1)))
    filled = F.transform(F.sequence(F.lit(1).cast("long"), F.col("missing")), lambda i: step(i.cast("int"), "SYNTHETIC", F.lit(1)))
    more = F.when(F.col("missing").between(1, most), filled).when(F.col("missing") > most, F.array(step(F.lit(1), "GAP", F.col("missing"))))
    rows = F.when(more.isNull(), own).otherwise(F.concat(own, more))
    return g.select("symbol", "close", F.explode(rows).alias("x")).select("symbol", "x.open_time", "x.kind", "close", "x.size")


def health(events: DataFrame, failing: str, lagging: int, down: int) -> DataFrame:
    """collector, seen, errors, status by the last event of each collector."""
    one = events.groupBy("collector").agg(F.max("ts").alias("seen"), F.max_by("state", F.struct("ts", "event_id")).alias("last"), F.count_if(F.col("state") == failing).alias("errors"))
    end = F.broadcast(events.agg(F.max("ts").alias("now")))
    before = lambda s: F.col("seen") < F.timestamp_add("SECOND", F.lit(-s), F.col("now"))
    status = F.when(before(down), "DOWN").when(F.col("last") == failing, "FAILING").when(before(lagging), "LAGGING").otherwise("HEALTHY")
    return one.join(end).select("collector", "seen", "errors", status.alias("status"))


def overlapped(zones: DataFrame, within: int) -> DataFrame:
    """zones (symbol, created_idx, dir, bottom, top) that overlap an opposite one made at most within
    bars before."""
    own = F.floor(F.col("created_idx") / within)
    n = zones.withColumn("_b", own).alias("n")
    p = zones.withColumn("_b", F.explode(F.array(own, own + 1))).alias("p")
    met = (
        (F.col("n.symbol") == F.col("p.symbol")) & (F.col("n._b") == F.col("p._b")) & (F.col("p.dir") == -F.col("n.dir"))
        & (F.col("p.created_idx") < F.col("n.created_idx")) & (F.col("p.created_idx") >= F.col("n.created_idx") - within)
        & (F.col("p.bottom") < F.col("n.top")) & (F.col("p.top") > F.col("n.bottom"))
    )
    return n.join(p, met, "left_semi").drop("_b").distinct()


def liquidity_runs(bars: DataFrame, pivots: DataFrame, within: int) -> DataFrame:
    """symbol, kind, src_idx, idx: swings whose first taker closes beyond them with a body of an ATR."""
    asks = pivots.select(
        "symbol", "kind", F.col("idx").alias("src_idx"), "price", F.concat_ws(":", "symbol", "kind", "idx").alias("id"),
        (F.col("confirmed_idx") + 1).alias("lo"), (F.col("confirmed_idx") + within).alias("hi"),
    )
    beyond = F.when(F.col("a.kind") == "HIGH", F.col("b.high") > F.col("a.price")).otherwise(F.col("b.low") < F.col("a.price"))
    taken = first_passage(asks, bars, beyond, "at", extra={c: F.col(f"b.{c}") for c in ("open", "close", "atr")}).where("at is not null")
    closes = F.when(F.col("kind") == "HIGH", F.col("close") > F.col("price")).otherwise(F.col("close") < F.col("price"))
    return taken.where(closes & (F.abs(F.col("close") - F.col("open")) >= F.col("atr"))).select("symbol", "kind", "src_idx", F.col("at").alias("idx"))


def period_pools(days: DataFrame) -> DataFrame:
    """symbol, open_time, pdh, pdl, pwh, pwl: extremes of the day before and of the week before."""
    day = Window.partitionBy("symbol").orderBy("open_time")
    week = F.date_trunc("week", F.col("open_time")).cast("timestamp_ntz")
    weeks = days.groupBy("symbol", week.alias("week")).agg(F.max("high").alias("h"), F.min("low").alias("l"))
    own = Window.partitionBy("symbol").orderBy("week")
    before = weeks.select("symbol", "week", F.lag("h").over(own).alias("pwh"), F.lag("l").over(own).alias("pwl"))
    rows = days.select("symbol", "open_time", week.alias("week"), F.lag("high").over(day).alias("pdh"), F.lag("low").over(day).alias("pdl"))
    return rows.join(before, ["symbol", "week"]).drop("week")
