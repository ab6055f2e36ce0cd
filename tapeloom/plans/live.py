"""Queries of repair, live state and wallets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.grid import seconds
from tapeloom.operators import feed, repair
from tapeloom.operators import views as V
from tapeloom.operators import wallet as W
from tapeloom.operators.persist import made_once, shared_folder
from tapeloom.operators.running import running_sum
from tapeloom.plans import facts, feeds, records, views
from tapeloom.plans.base import TAPE, Registry
from tapeloom.sources.messages import messages, without_errors
from tapeloom.sources.tape import tape
from tapeloom.streaming import advance, held, matching, proof
from tapeloom.streaming import minutes as S

R = Registry()

_US = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
#: The tape runs this much faster, so that its trades are seconds apart.
FAST = 200
D_MIN, D_MAX = -100_000, 500_000
GROUP = 40

GAPS = f"""f0 AS (
  SELECT trade_id AS id, symbol, epoch_us(ts) // {FAST} AS us, floor(qty / 25)::BIGINT AS price, trade_id % 2 AS qty,
    row_number() OVER (PARTITION BY symbol ORDER BY ts, trade_id) - 1 AS k FROM tape
), f AS (SELECT *, symbol || ':' || (k // {GROUP}) AS gap_id, k // {GROUP} AS g, k % {GROUP} AS p FROM f0),
gp AS (
  SELECT gap_id, any_value(symbol) AS symbol, any_value(g) AS g, min(us) FILTER (WHERE p = 18) AS start_us, min(us) FILTER (WHERE p = 18 + any_span) AS end_us FROM
    (SELECT *, 1 + g % 5 AS any_span FROM f) GROUP BY gap_id HAVING count(*) = {GROUP}
), gaps AS (SELECT gap_id, symbol, g, start_us, greatest(end_us, start_us + 1) AS end_us, greatest(end_us, start_us + 1) + CASE WHEN g % 11 = 3 THEN 400000 ELSE 3000000 END AS fetched_us FROM gp),
rest AS (
  SELECT f.gap_id, f.id, f.us + (f.id * 7919) % 450000 - 20000 + CASE WHEN g.g % 13 = 4 AND f.p = 12 THEN 300000 ELSE 0 END AS created_us, f.price, f.qty
  FROM f JOIN gaps g USING (gap_id) WHERE f.p >= CASE WHEN g.g % 11 = 5 THEN 18 ELSE 6 END AND f.p < 30 AND g.g % 11 <> 7
), live AS (
  SELECT f.symbol, f.id, f.us, f.price, f.qty FROM f LEFT JOIN gaps g USING (gap_id) WHERE g.gap_id IS NULL OR NOT ((f.us >= g.start_us AND f.us < g.end_us) OR (g.g % 17 = 6 AND f.us = g.end_us))
)"""


def _gaps(spark, d):
    """Gaps of the tape, the windows that were asked for them, and what came live."""
    t = tape(spark, d).select(F.col("trade_id").alias("id"), "symbol", F.expr(f"({_US}) div {FAST}").alias("us"), F.floor(F.col("qty") / 25).alias("price"), (F.col("trade_id") % 2).alias("qty"), "ts")
    k = running_sum(t.withColumn("_day", F.to_date("ts")), ["symbol"], "_day", ["ts", "id"], F.lit(1), "k").withColumn("k", F.col("k") - 1).drop("_day", "ts")
    f = k.withColumn("g", F.floor(F.col("k") / GROUP)).withColumn("p", F.col("k") % GROUP).withColumn("gap_id", F.concat_ws(":", "symbol", "g"))
    f = made_once(f, "fast")
    end = F.min(F.when(F.col("p") == 19 + F.col("g") % 5, F.col("us")))
    gp = f.groupBy("gap_id", "symbol", "g").agg(F.count("*").alias("n"), F.min(F.when(F.col("p") == 18, F.col("us"))).alias("start_us"), end.alias("end_us")).where(F.col("n") == GROUP)
    gp = gp.withColumn("end_us", F.greatest("end_us", F.col("start_us") + 1)).withColumn("fetched_us", F.col("end_us") + F.when(F.col("g") % 11 == 3, 400_000).otherwise(3_000_000)).drop("n")
    gp = made_once(gp, "gaps")
    of = f.join(gp.select("gap_id", "start_us", "end_us"), "gap_id", "left")
    slow = F.when((F.col("g") % 13 == 4) & (F.col("p") == 12), 300_000).otherwise(0)
    asked = of.where("start_us is not null").where((F.col("p") >= F.when(F.col("g") % 11 == 5, 18).otherwise(6)) & (F.col("p") < 30) & (F.col("g") % 11 != 7))
    rest = asked.select("gap_id", "id", (F.col("us") + (F.col("id") * 7919) % 450_000 - 20_000 + slow).alias("created_us"), "price", "qty")
    lost = ((F.col("us") >= F.col("start_us")) & (F.col("us") < F.col("end_us"))) | ((F.col("g") % 17 == 6) & (F.col("us") == F.col("end_us")))
    live = of.where(~F.coalesce(lost, F.lit(False))).select("symbol", "id", "us", "price", "qty")
    return gp, rest, live


#: Matching in order, each live trade once, as a walk over a gap's window.
MATCH = f"""win AS (
  SELECT r.*, g.symbol, g.start_us, g.end_us FROM rest r JOIN gaps g USING (gap_id) WHERE r.created_us >= g.start_us + {D_MIN} AND r.created_us < g.end_us + {D_MAX}
), near AS (
  SELECT g.gap_id, l.id, l.us, l.price, l.qty FROM gaps g JOIN live l ON l.symbol = g.symbol AND l.us // 60000000 BETWEEN g.start_us // 60000000 - 1 AND g.end_us // 60000000 + 1
), wk AS (SELECT *, row_number() OVER (PARTITION BY gap_id, price, qty ORDER BY created_us, id) AS k FROM win),
cand AS (
  SELECT w.gap_id, w.price, w.qty, w.k, w.id, list(struct_pack(d := abs(w.created_us - n.us), i := n.id) ORDER BY abs(w.created_us - n.us), n.id) FILTER (WHERE n.id IS NOT NULL) AS c
  FROM wk w LEFT JOIN near n ON n.gap_id = w.gap_id AND n.price = w.price AND n.qty = w.qty AND abs(w.created_us - n.us) <= 1000000 GROUP BY ALL
), walk(gap_id, price, qty, k, id, used, got) AS (
  SELECT DISTINCT gap_id, price, qty, 0::BIGINT, -1::BIGINT, []::BIGINT[], NULL::BIGINT FROM cand
  UNION ALL
  SELECT gap_id, price, qty, k, id, CASE WHEN got IS NULL THEN used ELSE list_append(used, got) END, got FROM (
    SELECT c.gap_id, c.price, c.qty, c.k, c.id, w.used, (list_filter(c.c, lambda x: NOT list_contains(w.used, x.i))[1]).i AS got
    FROM walk w JOIN cand c ON c.gap_id = w.gap_id AND c.price = w.price AND c.qty = w.qty AND c.k = w.k + 1)
), met AS (SELECT gap_id, id, got FROM walk WHERE got IS NOT NULL),
off AS (SELECT m.gap_id, count(*) AS matched, min(r.created_us - n.us) AS low_us, max(r.created_us - n.us) AS high_us
  FROM met m JOIN win r ON r.gap_id = m.gap_id AND r.id = m.id JOIN near n ON n.gap_id = m.gap_id AND n.id = m.got GROUP BY 1),
ms AS (SELECT w.*, greatest(created_us - {D_MAX}, start_us) AS lo, least(created_us - ({D_MIN}), end_us - 1) AS hi FROM win w ANTI JOIN met USING (gap_id, id)),
pl AS (SELECT gap_id, arg_min(why, (created_us, id)) AS place FROM (
  SELECT *, CASE WHEN lo // 60000000 <> hi // 60000000 THEN 'AMBIGUOUS_MINUTE' END AS why FROM ms) WHERE why IS NOT NULL GROUP BY 1),
tm AS (SELECT DISTINCT gap_id, lo // 60000000 AS minute FROM ms),
sp AS (SELECT n.gap_id, t.minute, n.us AS lo, n.us AS hi, n.price FROM near n JOIN tm t ON t.gap_id = n.gap_id AND n.us // 60000000 = t.minute
  UNION ALL SELECT gap_id, lo // 60000000, lo, hi, price FROM ms),
sb AS (SELECT *, min(hi) OVER w AS fb, max(lo) OVER w AS lb FROM sp WINDOW w AS (PARTITION BY gap_id, minute)),
se AS (SELECT gap_id, minute, count(DISTINCT price) FILTER (WHERE lo <= fb) > 1 AS o, count(DISTINCT price) FILTER (WHERE hi >= lb) > 1 AS c FROM sb GROUP BY ALL),
en AS (SELECT gap_id, arg_min(CASE WHEN o THEN 'AMBIGUOUS_OPEN' ELSE 'AMBIGUOUS_CLOSE' END, minute) AS ends FROM se WHERE o OR c GROUP BY 1),
old AS (SELECT gap_id, min(created_us) AS oldest FROM rest GROUP BY 1),
dec AS (
  SELECT g.gap_id, CASE WHEN oldest IS NULL THEN 'NO_REST_TRADES' WHEN fetched_us < end_us + {D_MAX} THEN 'FETCHED_TOO_EARLY' WHEN oldest >= start_us THEN 'REST_WINDOW_TOO_SHORT'
    WHEN low_us < {D_MIN} OR high_us > {D_MAX} THEN 'TIME_MODEL_VIOLATION' ELSE coalesce(place, ends, 'REPAIRED') END AS code, coalesce(matched, 0) AS matched, low_us, high_us
  FROM gaps g LEFT JOIN old USING (gap_id) LEFT JOIN off USING (gap_id) LEFT JOIN pl USING (gap_id) LEFT JOIN en USING (gap_id)
)"""
REPAIR = f"WITH RECURSIVE {TAPE}, {GAPS}, {MATCH}"


def _repaired(spark, d):
    return repair.repaired(*_gaps(spark, d), D_MIN, D_MAX)


@R.add(
    f"""{REPAIR} SELECT d.gap_id, code, matched, coalesce(low_us, 0) AS low_us, coalesce(high_us, 0) AS high_us, CASE WHEN code = 'REPAIRED' THEN coalesce(n, 0) ELSE 0 END AS recovered
FROM dec d LEFT JOIN (SELECT gap_id, count(*) AS n FROM ms GROUP BY 1) USING (gap_id)"""
)
def str_gap_repair(spark, d):
    """What becomes of each gap; sf0.01 and more have every code."""
    decisions = _repaired(spark, d)[0]
    zero = F.lit(0)
    return decisions.select("gap_id", "code", "matched", F.coalesce("low_us", zero).alias("low_us"), F.coalesce("high_us", zero).alias("high_us"), "recovered")


@R.add(
    f"""{REPAIR} SELECT gap_id, id, (lo + hi) // 2 AS us, price, qty, row_number() OVER (PARTITION BY gap_id, created_us, price, qty ORDER BY id) AS copy
FROM ms JOIN dec USING (gap_id) WHERE code = 'REPAIRED'"""
)
def str_gap_repair_trades(spark, d):
    """The trades that repaired gaps get."""
    return _repaired(spark, d)[1]


#: Every fifth hour of a symbol has a gap; each third of them is repaired in time, too late, or never.
START, LENGTH, IN_TIME, TOO_LATE = 630_000_000, 1_175_000_000, 300_000_007, 900_000_007
GRACE, DEADLINE, FILES = 2_000_000, 600_000_000, 6
HELD = f"""tu AS (SELECT *, epoch_us(ts) AS us, epoch_us(ts) // 3600000000 AS h FROM tape),
hg AS (SELECT symbol, h, h * 3600000000 + {START} AS s, h * 3600000000 + {START + LENGTH} AS e, (h // 5) % 3 AS fate FROM (SELECT DISTINCT symbol, h FROM tu WHERE h % 5 = 0)),
rel AS (SELECT *, CASE WHEN fate = 0 THEN e + {IN_TIME} ELSE e + {DEADLINE} END AS release FROM hg),
tr AS (SELECT t.symbol, t.trade_id, t.px, t.us, t.us // 60000000 * 60000000 AS m, g.fate, t.us + CASE WHEN trade_id % 97 = 0 THEN 200000000 ELSE 100000 END AS recv
  FROM tu t LEFT JOIN hg g ON g.symbol = t.symbol AND g.h = t.h AND t.us >= g.s AND t.us < g.e),
fm AS (SELECT x.symbol, x.m, greatest(x.m + 60000000 + {GRACE}, coalesce(max(r.release), 0)) AS due FROM (SELECT DISTINCT symbol, m FROM tr) x LEFT JOIN rel r ON r.symbol = x.symbol AND r.s < x.m + 60000000 GROUP BY x.symbol, x.m),
clk AS (SELECT max(c) // 1000 * 1000 AS clock FROM (SELECT max(recv) AS c FROM tr WHERE fate IS NULL UNION ALL SELECT max(e) FROM hg UNION ALL SELECT max(e + CASE fate WHEN 0 THEN {IN_TIME} ELSE {TOO_LATE} END) FROM hg WHERE fate < 2)),
ok AS (SELECT tr.*, due FROM tr JOIN fm USING (symbol, m) WHERE fate = 0 OR (fate IS NULL AND due > recv)),
mm AS (SELECT symbol, m, first(px ORDER BY us, trade_id) AS open, max(px) AS high, min(px) AS low, last(px ORDER BY us, trade_id) AS close, count(*) AS n FROM ok, clk WHERE due <= clock GROUP BY ALL),
mk AS (SELECT mm.*, (SELECT max(fate) FROM hg WHERE hg.symbol = mm.symbol AND hg.s < mm.m + 60000000 AND hg.e > mm.m) AS fate FROM mm)"""


def _held_rows(spark, d):
    """The rows of the feed, and the file that each comes in."""
    t = tape(spark, d).select("symbol", "trade_id", "px", F.expr(_US).alias("us")).withColumn("h", F.floor(F.col("us") / 3_600_000_000))
    g = t.where("h % 5 = 0").select("symbol", "h").distinct().withColumn("s", F.col("h") * 3_600_000_000 + START).withColumn("e", F.col("s") + LENGTH).withColumn("fate", F.floor(F.col("h") / 5) % 3)
    t = t.join(g, ["symbol", "h"], "left").withColumn("fate", F.when((F.col("us") >= F.col("s")) & (F.col("us") < F.col("e")), F.col("fate")))
    fixed = F.col("e") + F.when(F.col("fate") == 0, IN_TIME).otherwise(TOO_LATE)
    none, row = F.lit(-1), held.control_rows
    order = lambda rank: F.lit(rank << 40) + (F.col("trade_id") if rank in (2, 3) else F.lit(0))
    recv = F.col("us") + F.when(F.col("trade_id") % 97 == 0, 200_000_000).otherwise(100_000)
    parts = [
        row(g, "LOST", F.col("s"), F.col("s"), order(0), F.col("h")),
        row(g, "BACK", F.col("e"), F.col("e"), order(1), F.col("h")),
        row(t.where("fate is null"), "TRADE", F.col("us"), recv, order(2), none, F.col("trade_id"), F.col("px")),
        row(t.where("fate < 2"), "REPAIR", F.col("us"), fixed, order(3), F.col("h"), F.col("trade_id"), F.col("px")),
        row(g.where("fate < 2"), "RESOLVED", F.col("s"), fixed, order(4), F.col("h")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = made_once(rows, "held")
    ends = rows.agg(F.min("recv_us").alias("a"), F.max("recv_us").alias("z"))
    share = (F.col("recv_us") - F.col("a")) / (F.col("z") - F.col("a") + 1)
    return rows.join(F.broadcast(ends)).withColumn("file", F.floor(share * FILES)).drop("a", "z")


@R.add(
    f"""WITH {TAPE}, {HELD} SELECT symbol, CASE WHEN fate IS NULL THEN 'OK' WHEN fate = 0 THEN 'REPAIRED' ELSE 'DATA_GAP' END AS kind, m AS open_us, open, high, low, close, n FROM mk
UNION ALL SELECT symbol, 'LATE', us, px, px, px, px, 1 FROM tr JOIN fm USING (symbol, m) WHERE fate IS NULL AND due <= recv
UNION ALL SELECT symbol, 'LATE_REPAIR', h, -1, -1, -1, -1, 0 FROM hg WHERE fate = 1"""
)
def str_held_minutes(spark, d):
    """Minutes wait for repairs: some come before the deadline, some after it, some never."""
    folder = shared_folder(spark, "stream")
    rows = _held_rows(spark, d)
    for k in range(FILES):  # a file stream takes older files first
        rows.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = S.read_tape(spark, f"{folder}/in", ", ".join(f"{n} {t}" for n, t in rows.drop("file").dtypes))
    S.run_to_end(held.held_minutes(stream, GRACE, DEADLINE), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("symbol", "kind", "open_us", *(F.coalesce(c, F.lit(-1.0)).alias(c) for c in ("open", "high", "low", "close")), "n")


@R.add(
    f"""{facts.TRADES} SELECT o.id, coalesce(filled_idx, -1) AS filled_idx, coalesce(exit_idx, -1) AS exit_idx, coalesce(state, 'PENDING') AS state FROM orders_ o LEFT JOIN race r USING (id)"""
)
def str_advanced_trades(spark, d):
    """Orders advance with a stream of bars that stops half-way and goes on from its checkpoint."""
    bars, orders = facts._orders(spark, d)
    orders, folder = made_once(orders, "orders"), shared_folder(spark, "stream")
    nothing = {n: F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in advance.ROW.split(", "))}
    names = list(nothing)
    b = bars.select("symbol", "idx", "high", "low", F.lit("BAR").alias("kind"))
    o = orders.select("symbol", F.col("created_idx").alias("idx"), "id", "dir", "entry", "stop", "target", F.lit("ORDER").alias("kind"))
    rows = made_once(b.select(*(F.col(n) if n in b.columns else nothing[n] for n in names)).unionByName(o.select(*(F.col(n) if n in o.columns else nothing[n] for n in names))), "rows")
    end = rows.agg(F.max("idx").alias("end"))
    file = F.least(F.floor(F.col("idx") * FILES / (F.col("end") + 1)), F.lit(FILES - 1))
    rows = rows.join(F.broadcast(end)).withColumn("file", file).drop("end")
    for part in (range(FILES // 2), range(FILES // 2, FILES)):
        for k in part:
            rows.where(F.col("file") == k).drop("file").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = S.read_tape(spark, f"{folder}/in", advance.ROW)
        S.run_to_end(advance.advanced_orders(stream, hold=48, expiry=24), f"{folder}/out", f"{folder}/state")
    got = advance.order_states(spark.read.parquet(f"{folder}/out"))
    return got.select("id", F.coalesce("filled_idx", F.lit(-1)).alias("filled_idx"), F.coalesce("exit_idx", F.lit(-1)).alias("exit_idx"), "state")


def _in_batches(spark, rows, file, folder, run, n: int = FILES):
    """Give rows to run as a stream in n batches: the stream goes on from its checkpoint as each has come."""
    staged, names = shared_folder(spark, "rows"), rows.columns
    rows.withColumn("_file", file.cast("int")).write.partitionBy("_file").parquet(staged)
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    staged = spark.read.schema(f"{schema}, _file int").parquet(staged)
    for k in range(n):
        staged.where(F.col("_file") == k).select(*names).write.mode("append").parquet(f"{folder}/in")
        run(S.read_tape(spark, f"{folder}/in", schema, files=1_000_000))


def _share(rows, column: str, n: int):
    """rows with _a and _z, and the file of each by its place between the least and the largest value."""
    ends = F.broadcast(rows.agg(F.min(column).alias("_a"), F.max(column).alias("_z")))
    return rows.join(ends), F.floor((F.col(column) - F.col("_a")) * n / (F.col("_z") - F.col("_a") + 1)).cast("int")


def _proofs(spark, d):
    """What the three connections of the feed prove over six files; every 13th pong comes two files late."""
    folder = shared_folder(spark, "stream")
    rows, place = _share(feeds.feed_rows(spark, d), "at_us", FILES - 2)
    late = F.when((F.col("kind") == "PONG") & (F.col("id") % 13 == 0), 2).otherwise(0)
    found = rows.withColumn("_of", place + late).drop("_a", "_z")
    run = lambda stream: proof.prove_batches(stream.drop("_of"), folder, f"{folder}/state", feeds.SAFETY, 90 * feed.DAY_US)
    _in_batches(spark, found, F.col("_of"), folder, run)
    return proof.events_of(spark, folder)


@R.add(feeds.COVERAGE)
def str_coverage_stream(spark, d):
    """The same spans as the batch form, from state, with pongs that come late."""
    spans = proof.spans_of(_proofs(spark, d), feeds.SAFETY)
    return feed.coverage(spans).select(F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@R.add(feeds.RELEASED)
def str_released_stream(spark, d):
    """The same states as the batch form, as proofs move on."""
    return proof.releases(_proofs(spark, d))


EARLY, LATE, SETTLE = 60.0, 600.0, 3600.0


def _reconciled(spark, d):
    """Two feeds in five batches; rows near a border come in both batches, some a batch late."""
    a, b = records._feeds(spark, d)
    rows = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    rows, place = _share(rows.select("side", "event_type", "fp", "id", "t"), "t", 4)
    into = (F.col("t") - F.col("_a")) * 4 / (F.col("_z") - F.col("_a") + 1) - place  # share of the batch
    width = (F.col("_z") - F.col("_a") + 1) / 4
    near = into * width > width - SETTLE / 2  # the last half of the time in which rows may come late
    again = F.when(near & (F.col("id") % 3 == 0), F.array(place, place + 1)).when(near & (F.col("id") % 3 == 1), F.array(place + 1)).otherwise(F.array(place))
    folder = shared_folder(spark, "stream")
    rows = rows.withColumn("_of", F.explode(again)).drop("_a", "_z")
    run = lambda stream: matching.align_batches(stream.drop("_of"), folder, f"{folder}/state", ["event_type", "fp"], EARLY, LATE, SETTLE)
    _in_batches(spark, rows, F.col("_of"), folder, run, 5)
    return folder


@R.add()
def str_rest_reconciled(spark, d):
    """No SQL: a dynamic programme a group. tests hold it against one alignment of everything."""
    matched, single = matching.finish(spark, _reconciled(spark, d), ["event_type", "fp"], EARLY, LATE)
    pairs = matched.select(F.lit("MATCHED").alias("state"), "left_id", "right_id")
    none = F.lit(None).cast("long")
    alone = single.select(F.when(F.col("side") == 0, "REST_ONLY").otherwise("WS_ONLY").alias("state"), F.when(F.col("side") == 0, F.col("id")).otherwise(none).alias("left_id"), F.when(F.col("side") == 1, F.col("id")).otherwise(none).alias("right_id"))
    return pairs.unionByName(alone)


MAKER, TAKER, RATE, EVERY = 0.0008, 0.00095, 0.0001, 8
WALLETS = [
    ("plain", 1000.0, 0.01, 10.0, 1e-5, 0.0, 0.005), ("bold", 1000.0, 0.9, 400.0, 1e-5, 0.0, 0.005), ("tight", 1000.0, 0.02, 1.5, 1e-5, 0.0, 0.005),
    ("tiny", 5.0, 0.01, 10.0, 0.01, 0.0, 0.005), ("guarded", 1000.0, 0.9, 50.0, 1e-3, 1.0, 0.005), ("coarse", 200.0, 0.2, 2.0, 0.02, 0.0, 0.005), ("untouched", 0.0, 0.01, 10.0, 1e-5, 0.0, 0.005),
]
_NAMES = ["wallet", "initial", "risk", "leverage", "step", "buffer", "maintenance"]
_VALUES = ", ".join("('{}', {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE, {}::DOUBLE)".format(*(w[0], *(f"{x:.10f}" for x in w[1:]))) for w in WALLETS)
BOOK = f"""wl(wallet, initial, risk, leverage, step, buffer, maintenance) AS (SELECT * FROM (VALUES {_VALUES})),
hz AS (SELECT symbol, idx, open, close, floor(epoch(open_time) / 3600)::BIGINT AS hour FROM bars),
td AS (
  SELECT o.id, o.symbol, o.dir, o.entry, o.stop, a.hour AS created_at, f.hour AS filled_at, z.hour AS ended_at,
    CASE r.state WHEN 'SL' THEN o.stop WHEN 'TP' THEN o.target ELSE z.close END AS price
  FROM orders_ o JOIN race r USING (id) JOIN hz a ON a.symbol = o.symbol AND a.idx = o.created_idx
  LEFT JOIN hz f ON f.symbol = o.symbol AND f.idx = r.filled_idx LEFT JOIN hz z ON z.symbol = o.symbol AND z.idx = r.exit_idx
), fd AS (SELECT t.id, b.hour AS moment, b.open AS price FROM td t JOIN hz b ON b.symbol = t.symbol AND b.hour > t.filled_at AND b.hour <= coalesce(t.ended_at, 1000000000) AND b.hour % {EVERY} = 0),
ee AS (
  SELECT created_at AS moment, 2 AS rank, id, 'OPEN' AS kind, entry, stop, dir, 0.0::DOUBLE AS price, false AS filled FROM td
  UNION ALL SELECT ended_at, CASE WHEN ended_at = created_at THEN 3 ELSE 1 END, id, 'END', entry, stop, dir, price, filled_at IS NOT NULL FROM td WHERE ended_at IS NOT NULL
  UNION ALL SELECT fd.moment, 0, id, 'FUNDING', entry, stop, dir, fd.price, true FROM fd JOIN td USING (id)
), ek AS (SELECT *, row_number() OVER (ORDER BY moment, rank, id) AS k FROM ee),
lg(wallet, k, id, moment, kind, note, qty, amount, fees, balance, margin, held) AS (
  SELECT wallet, 0::BIGINT, '', 0::BIGINT, 'DEPOSIT', '', 0.0::DOUBLE, initial, 0.0::DOUBLE, initial, 0.0::DOUBLE, []::STRUCT(i VARCHAR, q DOUBLE, m DOUBLE)[] FROM wl
  UNION ALL
  SELECT wallet, k, id, moment, booked, note, qty, amount, fees, balance + amount AS balance,
    CASE WHEN booked = 'OPENED' THEN margin + qty * entry / leverage WHEN booked IN ('RELEASED', 'REALIZED_PNL') THEN CASE WHEN len(held) = 1 THEN 0 ELSE margin - own.m END ELSE margin END,
    CASE WHEN booked = 'OPENED' THEN list_append(held, struct_pack(i := id, q := qty, m := qty * entry / leverage)) WHEN booked IN ('RELEASED', 'REALIZED_PNL') THEN list_filter(held, lambda x: x.i <> id) ELSE held END
  FROM (
    SELECT *, CASE booked WHEN 'FUNDING' THEN -(qty * {RATE}::DOUBLE * price * dir) WHEN 'REALIZED_PNL' THEN qty * (price - entry) * dir - fees ELSE 0 END AS amount FROM (
      SELECT *, CASE WHEN booked = 'REALIZED_PNL' THEN qty * (entry * {MAKER}::DOUBLE + price * {TAKER}::DOUBLE) ELSE 0 END AS fees FROM (
        SELECT *, CASE WHEN kind = 'OPEN' THEN CASE WHEN q3 > 0 THEN 'OPENED' ELSE 'REJECTED' END WHEN own IS NULL THEN 'NONE' WHEN kind = 'FUNDING' THEN 'FUNDING' WHEN filled THEN 'REALIZED_PNL' ELSE 'RELEASED' END AS booked,
          CASE WHEN kind = 'OPEN' THEN CASE WHEN q3 > 0 THEN n3 WHEN balance <= 0 THEN 'WALLET_EMPTY' WHEN n3 = 'LIQ_LIMITED' THEN n3 WHEN n3 <> '' THEN 'NO_FREE_MARGIN' ELSE 'SIZE_BELOW_STEP' END ELSE '' END AS note,
          CASE WHEN kind = 'OPEN' THEN greatest(q3, 0) ELSE coalesce(own.q, 0) END AS qty FROM (
          SELECT *, CASE WHEN balance <= 0 THEN 0 WHEN buffer > 0 AND q2 > cap THEN floor(cap / step) * step ELSE q2 END AS q3, CASE WHEN buffer > 0 AND q2 > cap THEN 'LIQ_LIMITED' ELSE n2 END AS n3 FROM (
            SELECT *, CASE WHEN q1 * entry / leverage > balance - margin THEN floor(greatest(balance - margin, 0) * leverage / entry / step) * step ELSE q1 END AS q2,
              CASE WHEN q1 * entry / leverage > balance - margin THEN 'MARGIN_LIMITED' ELSE '' END AS n2,
              greatest(balance - margin, 0) / ((1 + buffer) * abs(entry - stop) + maintenance * entry) AS cap FROM (
              SELECT l.wallet, l.balance, l.margin, l.held, e.k, e.moment, e.id, e.kind, e.entry, e.stop, e.dir, e.price, e.filled, w.leverage, w.step, w.buffer, w.maintenance,
                floor(l.balance * w.risk / abs(e.entry - e.stop) / w.step) * w.step AS q1, list_filter(l.held, lambda x: x.i = e.id)[1] AS own
              FROM lg l JOIN ek e ON e.k = l.k + 1 JOIN wl w ON w.wallet = l.wallet))))))
), led AS (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY k) AS seq FROM lg WHERE k > 0 AND kind <> 'NONE')"""


def _wallets(spark):
    return spark.createDataFrame(WALLETS, "wallet string, initial double, risk double, leverage double, step double, buffer double, maintenance double")


def _booked(spark, d):
    bars, rows = facts._raced(spark, d)
    at = made_once(bars.select("symbol", "idx", "open", "close", F.floor(seconds("open_time") / 3600).alias("hour")), "hours")

    def hour(of: str, name: str, *more: str):
        return at.select("symbol", F.col("idx").alias(of), F.col("hour").alias(name), *more)

    t = rows.join(hour("created_idx", "created_at"), ["symbol", "created_idx"]).join(hour("filled_idx", "filled_at"), ["symbol", "filled_idx"], "left")
    t = t.join(hour("exit_idx", "ended_at", "close"), ["symbol", "exit_idx"], "left")
    price = F.when(F.col("state") == "SL", F.col("stop")).when(F.col("state") == "TP", F.col("target")).otherwise(F.col("close"))
    trades = made_once(t.select("id", "symbol", "dir", "entry", "stop", "created_at", "filled_at", "ended_at", price.alias("price")), "trades")
    due = at.where(F.col("hour") % EVERY == 0).select("symbol", F.col("hour").alias("at"), F.col("open").alias("price"))
    last = at.groupBy("symbol").agg(F.max("hour").alias("last"), F.max_by("close", "hour").alias("price"))
    filled = trades.where("filled_at is not null").join(F.broadcast(last.select("symbol", "last")), "symbol")
    first = (F.floor(F.col("filled_at") / EVERY) + 1) * EVERY
    end = F.coalesce("ended_at", "last")
    times = filled.where(first <= end).select("id", "symbol", F.explode(F.sequence(first, end, F.lit(EVERY).cast("long"))).alias("at"))
    fundings = times.join(due, ["symbol", "at"]).select("id", "at", "price")
    wallets = _wallets(spark)
    return W.ledger(W.events_of(trades, fundings), wallets, MAKER, TAKER, RATE), wallets, trades, last.select("symbol", "price")


@R.add(
    f"""{facts.TRADES}, {BOOK} SELECT wallet, seq, moment, id, kind, note, round(qty, 5) AS qty, round(amount, 6) AS amount, round(fees, 6) AS fees, round(balance, 6) AS balance, round(margin, 6) AS margin FROM led"""
)
def sim_wallet_ledger(spark, d):
    """Seven wallets over the same orders; every reason of rejection and of a smaller size occurs."""
    rows = _booked(spark, d)[0]
    return rows.select("wallet", "seq", F.col("at").alias("moment"), "id", "kind", "note", F.round("qty", 5).alias("qty"), *(F.round(F.col(c) + 0.0, 6).alias(c) for c in ("amount", "fees", "balance", "margin")))


@R.add(
    f"""{facts.TRADES}, {BOOK}, lt AS (SELECT symbol, arg_max(close, hour) AS price FROM hz GROUP BY 1),
la AS (SELECT wallet, arg_max(balance, seq) AS balance, arg_max(margin, seq) AS margin, sum(fees) AS fees, count(*) FILTER (WHERE kind = 'REJECTED') AS rejected FROM led GROUP BY 1),
so AS (SELECT o.wallet, o.qty, t.filled_at, t.dir * (l.price - t.entry) - t.entry * {MAKER}::DOUBLE - l.price * {TAKER}::DOUBLE AS net
  FROM led o JOIN td t USING (id) JOIN lt l ON l.symbol = t.symbol WHERE o.kind = 'OPENED' AND NOT EXISTS (SELECT 1 FROM led x WHERE x.wallet = o.wallet AND x.id = o.id AND x.kind IN ('RELEASED', 'REALIZED_PNL'))),
un AS (SELECT wallet, count(*) AS open, sum(CASE WHEN filled_at IS NOT NULL THEN qty * net ELSE 0 END) AS unrealized FROM so GROUP BY 1),
v AS (SELECT w.wallet, w.initial, coalesce(la.balance, w.initial) AS balance, coalesce(la.margin, 0) AS margin, coalesce(fees, 0) AS fees, coalesce(rejected, 0) AS rejected, coalesce(open, 0) AS open, coalesce(unrealized, 0) AS unrealized
  FROM wl w LEFT JOIN la USING (wallet) LEFT JOIN un USING (wallet))
SELECT wallet, round(balance, 5) AS balance, round(balance + unrealized, 5) AS equity, round(unrealized, 5) AS unrealized, round(margin, 5) AS margin, round(balance - margin, 5) AS free, round(balance - initial, 5) AS realized, round(fees, 5) AS fees, open, rejected FROM v"""
)
def sim_wallet_view(spark, d):
    rows, wallets, trades, prices = _booked(spark, d)
    got = W.views(made_once(rows, "ledger"), wallets, trades, prices, MAKER, TAKER)
    return got.select("wallet", *(F.round(F.col(c) + 0.0, 5).alias(c) for c in ("balance", "equity", "unrealized", "margin", "free", "realized", "fees")), "open", "rejected")


@R.add("SELECT event_id AS trade_id, event_type AS symbol, value AS px FROM events WHERE user_id % 10 <> 0 AND user_id % 7 <> 0 AND event_type IN ('click', 'view') AND value > 0")
def src_message_stream(spark, d):
    """Messages as a stream of text segments: half of them are read, then the query starts again from
    its checkpoint and reads what has come since; each message counts once."""
    folder = shared_folder(spark, "messages")
    rows = made_once(views._messages(spark, d), "raw_messages")
    for half in range(2):
        for k in range(2 * half, 2 * half + 2):
            rows.where(F.col("event_id") % 4 == k).select("raw").write.text(f"{folder}/in/{k:05d}")
        found = without_errors(messages(spark, f"{folder}/in", stream=True))
        S.run_to_end(V.parse_trades(found, ["click", "view"]), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("trade_id", "symbol", "px")
