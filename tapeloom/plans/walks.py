"""Queries over taken trades: other readings and exits, baselines, open results, states, audits."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import simulate as M
from tapeloom.operators import structure as S
from tapeloom.operators.passage import first_passage
from tapeloom.operators.persist import made_once
from tapeloom.plans import facts
from tapeloom.plans.base import BREAKS, FVG, OPTIONS, STRUCTURE, SWINGS, TAPE, Registry, structure
from tapeloom.sources.tape import tape

R = Registry()
HOLD = 48
FACTORS = (0.0, 0.5, 1.0, 2.0, 4.0)
SNAPSHOTS = range(50, 701, 50)
#: Cuts of a series, evenly over its length.
CUTS = 20


def _renamed(sql: str, prefix: str, *names: str) -> str:
    return re.sub(rf"\b({'|'.join(names)})\b", rf"{prefix}\1", sql)


def _reading(prefix: str, sql: str) -> str:
    return _renamed(sql, prefix, "fl", "st", "fi", "ex", "race")


TARGET_FIRST = _reading("tf_", facts.RACE.replace("s1 <= coalesce(t1", "s1 < coalesce(t1"))
THROUGH = _reading("th_", facts.RACE.replace("b.low <= entry ELSE b.high >= entry", "b.low < entry ELSE b.high > entry"))


@R.add(
    f"""{facts.TRADES}, {TARGET_FIRST}, {THROUGH}, r AS (SELECT 'stop_first' AS reading, state FROM race UNION ALL SELECT 'target_first', state FROM tf_race UNION ALL SELECT 'through', state FROM th_race)
SELECT reading, state, count(*) AS n FROM r GROUP BY ALL"""
)
def sim_readings(spark, d):
    bars, placed = facts._orders(spark, d)
    placed = made_once(placed, "orders")
    kinds = {"stop_first": {}, "target_first": {"target_first": True}, "through": {"through": True}}
    runs = [M.race(placed, bars, hold=HOLD, expiry=24, **options).select(F.lit(name).alias("reading"), "state") for name, options in kinds.items()]
    return runs[0].unionByName(runs[1]).unionByName(runs[2]).groupBy("reading", "state").agg(F.count("*").alias("n"))


@R.add(
    f"""{facts.TRADES}, c AS (
  SELECT r.id, r.state, r.exit_idx, (SELECT min(e.break_idx) FROM ev e WHERE e.symbol = o.symbol AND e.kind = 'CHOCH' AND e.dir = -o.dir
    AND e.break_idx > r.filled_idx AND e.break_idx < coalesce(r.exit_idx, r.filled_idx + {HOLD + 1})) AS at_idx
  FROM race r JOIN orders_ o USING (id) WHERE r.filled_idx IS NOT NULL)
SELECT id, CASE WHEN at_idx IS NOT NULL THEN 'INVALIDATED' ELSE state END AS state, coalesce(at_idx, exit_idx, -1) AS exit_idx FROM c"""
)
def sim_structure_exit(spark, d):
    _, rows = facts._raced(spark, d)
    against = structure(spark, d)[2].where("kind = 'CHOCH'").select("symbol", F.col("break_idx").alias("idx"), F.col("dir").alias("side"))
    asks = rows.where("filled_idx is not null").withColumn("lo", F.col("filled_idx") + 1).withColumn("hi", F.coalesce(F.col("exit_idx") - 1, F.col("filled_idx") + HOLD))
    found = first_passage(asks, against, F.col("b.side") == -F.col("a.dir"), "at_idx")
    state = F.when(F.col("at_idx").isNotNull(), "INVALIDATED").otherwise(F.col("state"))
    return found.select("id", state.alias("state"), F.coalesce("at_idx", "exit_idx", F.lit(-1)).alias("exit_idx"))


@R.add()  # DuckDB does not end on its SQL; tested against a plain walk
def sim_trailing_exit(spark, d):
    bars, rows = facts._raced(spark, d)
    got = M.trailing(rows.where("filled_idx is not null"), bars, HOLD, 3.0)
    return got.select("id", F.coalesce("exit_idx", F.lit(-1)).alias("exit_idx"), "rule", F.coalesce(F.round("price", 4), F.lit(-1.0)).alias("price"))


@R.add(
    f"""{facts.TRADES}{facts.NET}, f AS (SELECT unnest([0.0, 0.5, 1.0, 2.0, 4.0])::DOUBLE AS factor), v AS (
  SELECT factor, (o.dir * (CASE n.state WHEN 'SL' THEN o.stop WHEN 'TP' THEN o.target ELSE b.close END - o.entry) - 0.001::DOUBLE * factor * (o.entry + CASE n.state WHEN 'SL' THEN o.stop WHEN 'TP' THEN o.target ELSE b.close END))
    / (abs(o.entry - o.stop) + 0.001::DOUBLE * factor * (o.entry + o.stop)) AS r
  FROM net n JOIN orders_ o USING (id) JOIN bars b ON b.symbol = o.symbol AND b.idx = n.exit_idx, f)
SELECT factor, count(*) AS n, round(avg(r), 6) AS mean_r FROM v GROUP BY factor"""
)
def sim_cost_scaling(spark, d):
    bars, rows = facts._raced(spark, d)
    done = rows.where(F.col("state").isin("SL", "TP", "TIMEOUT")).join(bars.select("symbol", F.col("idx").alias("exit_idx"), "close"), ["symbol", "exit_idx"])
    each = done.withColumn("factor", F.explode(F.array(*(F.lit(f) for f in FACTORS))))
    r = M.net_r(F.col("state"), F.col("dir"), F.col("entry"), F.col("stop"), F.col("target"), F.col("close"), 0.001 * F.col("factor"))
    return each.groupBy("factor").agg(F.count("*").alias("n"), F.round(F.avg(r), 6).alias("mean_r"))


@R.add(
    f"""{facts.TRADES}, l AS (SELECT symbol, max(idx) - {HOLD} AS room FROM bars GROUP BY 1), p AS (
  SELECT o.id, o.symbol, o.dir, abs(o.entry - o.stop) AS unit, ('0x' || substr(md5(o.id || ':' || g.draw), 1, 7))::BIGINT % l.room AS idx
  FROM orders_ o JOIN l USING (symbol), (SELECT unnest(range(1, 21)) AS draw) g WHERE l.room > 0 AND o.entry <> o.stop)
SELECT p.id, count(*) AS draws, round(avg(p.dir * (z.close - a.close) / p.unit), 6) AS mean_r FROM p JOIN bars a ON a.symbol = p.symbol AND a.idx = p.idx
JOIN bars z ON z.symbol = p.symbol AND z.idx = p.idx + {HOLD} GROUP BY p.id"""
)
def sim_random_entries(spark, d):
    bars, rows = facts._orders(spark, d)
    trades = rows.where("entry <> stop").select("id", "symbol", "dir", F.abs(F.col("entry") - F.col("stop")).alias("unit"))
    return M.random_entries(trades, bars, HOLD, 20).withColumn("mean_r", F.round("mean_r", 6))


@R.add(
    f"""{facts.TRADES}, s AS (SELECT unnest(range(50, 701, 50)) AS at_idx)
SELECT s.at_idx, count(*) AS n, round(sum(o.dir * (b.close - o.entry) * 10 / abs(o.entry - o.stop)), 4) AS open_result
FROM race r JOIN orders_ o USING (id), s JOIN bars b ON b.symbol = o.symbol AND b.idx = s.at_idx WHERE r.filled_idx <= s.at_idx AND (r.exit_idx IS NULL OR r.exit_idx > s.at_idx) GROUP BY s.at_idx"""
)
def sim_open_result(spark, d):
    bars, rows = facts._raced(spark, d)
    each = rows.withColumn("at_idx", F.explode(F.array(*(F.lit(k).cast("long") for k in SNAPSHOTS))))
    held = each.where("filled_idx <= at_idx and (exit_idx is null or exit_idx > at_idx)").join(bars.select("symbol", F.col("idx").alias("at_idx"), "close"), ["symbol", "at_idx"])
    mark = F.col("dir") * (F.col("close") - F.col("entry")) * 10 / F.abs(F.col("entry") - F.col("stop"))
    return held.groupBy("at_idx").agg(F.count("*").alias("n"), F.round(F.sum(mark), 4).alias("open_result"))


STATES = f"""sn AS (SELECT unnest(range(50, 701, 50)) AS at_idx), states AS (
  SELECT s.at_idx, a.symbol, a.symbol || ':' || a.break_idx || ':' || a.dir AS id, CASE WHEN a.dir = 1 THEN a.top ELSE a.bottom END AS edge,
    CASE WHEN s.at_idx < a.created_idx THEN 'WAITING' WHEN a.armed_idx IS NULL OR s.at_idx < a.armed_idx THEN CASE WHEN s.at_idx <= a.created_idx + {OPTIONS.lookback} THEN 'FRESH' ELSE 'EXPIRED' END
      WHEN r.exit_idx <= s.at_idx THEN CASE WHEN r.filled_idx IS NULL THEN 'GONE' ELSE 'USED' END WHEN r.filled_idx <= s.at_idx THEN 'OPEN' ELSE 'ARMED' END AS state
  FROM armed a LEFT JOIN race r ON r.id = a.symbol || ':' || a.break_idx || ':' || a.dir, sn s)"""


def _states(spark, d):
    """Every setup's state at the snapshots."""
    armed = facts._armed(spark, d)[1].select("id", "symbol", F.col("created_idx").alias("known_idx"), "armed_idx", F.when(F.col("dir") == 1, F.col("top")).otherwise(F.col("bottom")).alias("edge"))
    bars, rows = facts._raced(spark, d)
    both = armed.join(rows.select("id", "filled_idx", "exit_idx"), "id", "left")
    each = both.withColumn("at_idx", F.explode(F.array(*(F.lit(k).cast("long") for k in SNAPSHOTS))))
    at_idx = F.col("at_idx")
    unarmed = F.col("armed_idx").isNull() | (at_idx < F.col("armed_idx"))
    state = (
        F.when(at_idx < F.col("known_idx"), "WAITING")
        .when(unarmed, F.when(at_idx <= F.col("known_idx") + OPTIONS.lookback, "FRESH").otherwise("EXPIRED"))
        .when(F.col("exit_idx") <= at_idx, F.when(F.col("filled_idx").isNull(), "GONE").otherwise("USED"))
        .when(F.col("filled_idx") <= at_idx, "OPEN")
        .otherwise("ARMED")
    )
    return bars, each.select("at_idx", "symbol", "id", "edge", state.alias("state"))


@R.add(f"{facts.TRADES}, {STATES} SELECT at_idx, id, state FROM states")
def prj_setup_states(spark, d):
    return _states(spark, d)[1].select("at_idx", "id", "state")


@R.add(
    f"""{facts.TRADES}, {STATES}, k AS (SELECT s.at_idx, s.id, rank() OVER (PARTITION BY s.at_idx, s.symbol ORDER BY abs(s.edge - b.close)) AS place
FROM states s JOIN bars b ON b.symbol = s.symbol AND b.idx = s.at_idx WHERE s.state IN ('FRESH', 'ARMED')) SELECT * FROM k WHERE place <= 3"""
)
def tk_nearest_setups(spark, d):
    bars, rows = _states(spark, d)
    near = rows.where(F.col("state").isin("FRESH", "ARMED")).join(bars.select("symbol", F.col("idx").alias("at_idx"), "close"), ["symbol", "at_idx"])
    place = F.rank().over(Window.partitionBy("at_idx", "symbol").orderBy(F.abs(F.col("edge") - F.col("close"))))
    return near.withColumn("place", place).where("place <= 3").select("at_idx", "id", "place")


@R.add(
    f"""{STRUCTURE}, u AS (SELECT symbol, confirmed_idx AS at_idx, 'swing' AS what, kind AS detail, idx AS ref FROM swings UNION ALL SELECT symbol, break_idx, 'break', kind, level_idx FROM ev)
SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY at_idx, what, detail, ref) AS place FROM u"""
)
def tk_chronological_merge(spark, d):
    _, pivots, events = structure(spark, d)
    both = pivots.select("symbol", F.col("confirmed_idx").alias("at_idx"), F.lit("swing").alias("what"), F.col("kind").alias("detail"), F.col("idx").alias("ref")).unionByName(
        events.select("symbol", F.col("break_idx").alias("at_idx"), F.lit("break").alias("what"), F.col("kind").alias("detail"), F.col("level_idx").alias("ref"))
    )
    return both.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("at_idx", "what", "detail", "ref")))


_CUT = _renamed(f"{SWINGS}, {BREAKS}, {FVG}, {facts.SWEEPS}", "x_", "piv", "bars", "swings", "force", "hb", "lb", "ev0", "ev", "fvg", "tk", "lv", "sweeps")


def _objects(p: str) -> str:
    return f"""SELECT symbol, 'SWING' AS kind, confirmed_idx AS known, kind || ':' || idx AS name, price AS a, price AS b FROM {p}swings
  UNION ALL SELECT symbol, 'BREAK', break_idx, kind || ':' || dir || ':' || level_idx, level, level FROM {p}ev
  UNION ALL SELECT symbol, 'GAP', created_idx, dir::VARCHAR, bottom, top FROM {p}fvg
  UNION ALL SELECT symbol, 'SWEEP', idx, dir::VARCHAR, level, wick FROM {p}sweeps"""


@R.add(
    f"""{STRUCTURE}, {FVG}, {facts.SWEEPS}, cuts AS (SELECT symbol, k, n * k // {CUTS + 1} AS cut FROM (SELECT symbol, count(*) AS n FROM bars GROUP BY 1), range(1, {CUTS + 1}) t(k)),
x_bars AS (SELECT b.* REPLACE (b.symbol || '#' || c.k AS symbol) FROM bars b JOIN cuts c ON c.symbol = b.symbol AND b.idx < c.cut), {_CUT},
fo AS ({_objects('')}), xo AS ({_objects('x_')}),
mk AS (SELECT c.k, f.kind, f.symbol || '#' || c.k AS symbol, f.known, f.name, f.a, f.b, 1 AS side FROM fo f JOIN cuts c ON c.symbol = f.symbol AND f.known < c.cut
  UNION ALL SELECT split_part(symbol, '#', 2)::BIGINT, kind, symbol, known, name, a, b, -1 FROM xo),
ct AS (SELECT k, kind, count(*) FILTER (WHERE side = 1) AS f, count(*) FILTER (WHERE side = -1) AS c FROM mk GROUP BY k, kind, symbol, known, name, a, b)
SELECT k, kind, sum(f)::BIGINT AS in_full, sum(c)::BIGINT AS in_cut, sum(abs(f - c))::BIGINT AS differing FROM ct GROUP BY k, kind"""
)
def vw_prefix_invariance(spark, d):
    """Twenty cuts of every series: swings, breaks, gaps and sweeps of what was known then against those
    of the whole that were known by then.

    A cut series is a series of its own name, so one plan finds the structure of all cuts.
    """
    bars, pivots, events = structure(spark, d)
    ends = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    cuts = F.broadcast(ends.select("symbol", F.explode(F.sequence(F.lit(1), F.lit(CUTS))).alias("k"), "n").select("symbol", "k", F.floor(F.col("n") * F.col("k") / (CUTS + 1)).alias("cut")))
    named = F.concat_ws("#", "symbol", "k")
    cut_bars = made_once(bars.join(cuts, "symbol").where("idx < cut").withColumn("symbol", named).select(*bars.columns), "cut_bars")
    cut_pivots = made_once(S.swings(cut_bars, OPTIONS.swing_len), "cut_swings")
    full = _found(bars, pivots, events).join(cuts, "symbol").where(F.col("at") < F.col("cut")).withColumn("symbol", named).drop("cut", "k")
    part = _found(cut_bars, cut_pivots, S.breaks(cut_bars, cut_pivots))
    marks = full.withColumn("side", F.lit(1)).unionByName(part.withColumn("side", F.lit(-1)))
    counts = marks.groupBy("symbol", "kind", "at", "name", "a", "b").agg(F.count_if(F.col("side") == 1).alias("f"), F.count_if(F.col("side") == -1).alias("c"))
    k = F.split_part("symbol", F.lit("#"), F.lit(2)).cast("long")
    return counts.groupBy(k.alias("k"), "kind").agg(F.sum("f").alias("in_full"), F.sum("c").alias("in_cut"), F.sum(F.abs(F.col("f") - F.col("c"))).alias("differing"))


def _found(bars, pivots, events):
    """symbol, kind, at (when it is known), name, a, b of all that structure has."""
    text = lambda *c: F.concat_ws(":", *(F.col(x).cast("string") for x in c))
    row = lambda kind, at, name, a, b: ("symbol", F.lit(kind).alias("kind"), F.col(at).cast("long").alias("at"), name.alias("name"), F.col(a).alias("a"), F.col(b).alias("b"))
    out = pivots.select(*row("SWING", "confirmed_idx", text("kind", "idx"), "price", "price"))
    out = out.unionByName(events.select(*row("BREAK", "break_idx", text("kind", "dir", "level_idx"), "level", "level")))
    out = out.unionByName(S.fair_value_gaps(bars, OPTIONS.fvg_min_atr).select(*row("GAP", "created_idx", text("dir"), "bottom", "top")))
    return out.unionByName(S.sweeps(bars, pivots, facts.LB, OPTIONS.eq_tol_atr).select(*row("SWEEP", "idx", text("dir"), "level", "wick")))


@R.add(
    f"""WITH {TAPE}, s AS (SELECT symbol, abs(px - lag(px) OVER (PARTITION BY symbol ORDER BY ts, trade_id)) / px * 10000 AS step FROM tape)
SELECT symbol, count(step) AS n, round(quantile_cont(step, 0.5), 6) AS half, round(quantile_cont(step, 0.9), 6) AS most, round(quantile_cont(step, 0.99), 6) AS nearly_all FROM s GROUP BY symbol"""
)
def vw_price_steps(spark, d):
    price = F.col("px")
    before = F.lag(price).over(Window.partitionBy("symbol").orderBy("ts", "trade_id"))
    moved = F.abs(price - before)
    # a path may come to 0, where SQL has infinity, or NaN without a move
    share = F.when(price != 0, moved / price).when(moved > 0, F.lit(float("inf"))).when(moved == 0, F.lit(float("nan")))
    steps = tape(spark, d).select("symbol", (share * 10000).alias("step"))
    return steps.groupBy("symbol").agg(
        F.count("step").alias("n"), *(F.round(F.percentile("step", F.lit(q)), 6).alias(n) for q, n in ((0.5, "half"), (0.9, "most"), (0.99, "nearly_all")))
    )
