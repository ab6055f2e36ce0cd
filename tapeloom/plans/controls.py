"""Queries of matched and random controls of events, and what is left of an event's edge against them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import controls as C
from tapeloom.operators import simulate as M
from tapeloom.operators import structure as S
from tapeloom.operators.indicators import windowed
from tapeloom.operators.persist import made_once
from tapeloom.operators.stats import bootstrap_mean
from tapeloom.plans import facts
from tapeloom.plans.base import FVG, OPTIONS, STRUCTURE, Registry, once_a_query, structure

R = Registry()
CONTROLS, HORIZON = 5, 40
DAYS, WARM, WINDOW, SPLIT, TICK = 10, 48, 24, 0.6, 0.01

MATCHED = f"""bod AS (
  SELECT symbol, idx, close, atr, abs(close - open) / atr AS x, lag(high - low) OVER (PARTITION BY symbol ORDER BY idx) / atr AS y FROM bars
), evn AS (
  SELECT b.symbol, b.idx, e.dir, b.close, b.atr, x, y FROM bod b JOIN ev e ON e.symbol = b.symbol AND e.break_idx = b.idx WHERE b.atr > 0 AND y IS NOT NULL
), poo AS (
  SELECT * FROM bod b WHERE atr > 0 AND y IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.symbol = b.symbol AND e.break_idx = b.idx)
), mat AS (
  SELECT e.symbol, e.dir, e.idx AS event_idx, p.idx AS control_idx, (e.x - p.x) * (e.x - p.x) + (e.y - p.y) * (e.y - p.y) AS d2,
    row_number() OVER (PARTITION BY e.symbol, e.idx ORDER BY (e.x - p.x) * (e.x - p.x) + (e.y - p.y) * (e.y - p.y), p.idx) AS rank
  FROM evn e JOIN poo p ON p.symbol = e.symbol QUALIFY rank <= {CONTROLS}
)"""


@once_a_query
def _matched(spark, d):
    """Hourly bars, and symbol, dir, event_idx, rank, control_idx, distance2: bars without a break whose
    body and whose bar before have about the size, in ATR, of those of a bar with a break."""
    bars, _, events = structure(spark, d)
    sized = windowed(bars, lambda w: {"_before": F.lag(F.col("high") - F.col("low")).over(w)}, before=1).where("atr > 0 and _before is not null")
    sized = sized.select("symbol", "idx", (F.abs(F.col("close") - F.col("open")) / F.col("atr")).alias("x"), (F.col("_before") / F.col("atr")).alias("y"))
    sides = events.select("symbol", F.col("break_idx").alias("idx"), "dir")
    own = sized.join(sides, ["symbol", "idx"]).withColumn("event_id", F.struct("idx", "dir"))
    found = C.nearest_controls(own, sized.join(sides, ["symbol", "idx"], "left_anti").withColumn("control_id", F.struct("idx", "symbol")), "symbol", CONTROLS)
    rows = found.select(
        F.col("control_id.symbol").alias("symbol"), F.col("event_id.dir").alias("dir"), F.col("event_id.idx").alias("event_idx"), "rank",
        F.col("control_id.idx").alias("control_idx"), "distance2",
    )
    return bars, made_once(rows, "matched")


@R.add(f"{STRUCTURE}, {MATCHED} SELECT symbol, event_idx, rank, control_idx, round(d2, 9) AS distance2 FROM mat")
def sim_matched_controls(spark, d):
    return _matched(spark, d)[1].select("symbol", "event_idx", "rank", "control_idx", F.round("distance2", 9).alias("distance2"))


_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
#: What facts.OUTCOMES selects, before and after its first column.
_HEAD, _TAIL = facts.OUTCOMES.rsplit("SELECT id, coalesce(t1", 1)
RESULTS = f"{_HEAD}, res AS (SELECT id, coalesce(t1{_TAIL})"
EDGE = """asks AS (
  SELECT symbol || ':' || event_idx || ':0' AS id, symbol, dir, event_idx AS k FROM (SELECT DISTINCT symbol, dir, event_idx FROM mat)
  UNION ALL SELECT symbol || ':' || event_idx || ':' || rank, symbol, dir, control_idx FROM mat
), orders_ AS (
  SELECT a.id, a.symbol, a.dir, a.k + 1 AS created_idx, b.close AS entry, b.close - a.dir * b.atr AS stop FROM asks a JOIN bars b ON b.symbol = a.symbol AND b.idx = a.k
)"""


@R.add(
    f"""{STRUCTURE}, {MATCHED}, {EDGE}, {RESULTS},
sp AS (SELECT split_part(id, ':', 1) AS symbol, split_part(id, ':', 2)::BIGINT AS event_idx, split_part(id, ':', 3) = '0' AS own, mfe FROM res),
pr AS (SELECT symbol AS g, event_idx, max(mfe) FILTER (WHERE own) - avg(mfe) FILTER (WHERE NOT own) AS v FROM sp GROUP BY 1, 2),
r AS (SELECT g, symbol_id AS id, v FROM (SELECT *, g || ':' || event_idx AS symbol_id FROM pr) WHERE v IS NOT NULL),
s AS (SELECT g, {_DRAW.format("id || ':bin'")} % 1000 AS bin, sum(v) AS v, count(*) AS c FROM r GROUP BY ALL),
dr AS (SELECT g, v, c, b, {_DRAW.format("bin::VARCHAR || ':' || b::VARCHAR")} % 100000 AS u FROM s, range(1, 2001) t(b)),
wt AS (SELECT *, (u >= 36788)::INT + (u >= 73576)::INT + (u >= 91970)::INT + (u >= 98101)::INT + (u >= 99634)::INT + (u >= 99941)::INT + (u >= 99992)::INT AS w FROM dr),
mm AS (SELECT g, b, sum(w * v) / sum(w * c) AS m FROM wt GROUP BY ALL)
SELECT g AS symbol, n, round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high
FROM mm JOIN (SELECT g, avg(v) AS mean, count(*) AS n FROM r GROUP BY 1) USING (g) GROUP BY ALL"""
)
def sim_matched_edge(spark, d):
    """How much farther breaks go, in ATR before the stop, than their matched controls on average:
    the paired difference with a bootstrap interval."""
    bars, found = _matched(spark, d)
    own = found.select("symbol", "dir", "event_idx", F.lit(0).alias("rank"), F.col("event_idx").alias("k")).distinct()
    asks = own.unionByName(found.select("symbol", "dir", "event_idx", "rank", F.col("control_idx").alias("k")))
    priced = asks.join(bars.select("symbol", F.col("idx").alias("k"), "close", "atr"), ["symbol", "k"])
    touches = priced.select(
        F.concat_ws(":", "symbol", "event_idx", "rank").alias("id"), "symbol", "dir", (F.col("k") + 1).alias("idx"),
        F.col("close").alias("entry"), (F.col("close") - F.col("dir") * F.col("atr")).alias("stop"),
    )
    part = F.split("id", ":")
    done = M.outcomes(touches, bars, HORIZON).select(part[0].alias("symbol"), part[1].alias("event_idx"), (part[2] == "0").alias("own"), F.round("mfe", 6).alias("mfe"))
    ahead = F.max(F.when(F.col("own"), F.col("mfe"))) - F.avg(F.when(~F.col("own"), F.col("mfe")))
    pairs = done.groupBy("symbol", "event_idx").agg(ahead.alias("v")).where("v is not null").withColumn("id", F.concat_ws(":", "symbol", "event_idx"))
    pairs = made_once(pairs, "pairs")
    spread = bootstrap_mean(pairs, "symbol", "id", "v", 2000)
    counted = pairs.groupBy("symbol").agg(F.count("*").alias("n")).join(spread, "symbol")
    return counted.select("symbol", "n", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


LEVELS = f"""zo AS (
  SELECT f.symbol || ':' || f.created_idx || ':' || f.dir AS id, f.*, CASE WHEN f.dir = 1 THEN f.top ELSE f.bottom END AS entry FROM fvg f
), lst AS (SELECT symbol, max(idx) AS last_idx FROM bars GROUP BY 1
), rm0 AS (
  SELECT z.id, z.symbol, z.dir, z.created_idx AS idx, last_idx, floor(last_idx * {SPLIT}::DOUBLE)::BIGINT AS cut, z.dir * (b.close - z.entry) / b.atr AS far, (z.top - z.bottom) / b.atr AS wide
  FROM zo z JOIN bars b ON b.symbol = z.symbol AND b.idx = z.created_idx JOIN lst l ON l.symbol = z.symbol WHERE b.atr > 0
), rm AS (
  SELECT *, greatest({WARM}, idx - {24 * DAYS}, CASE WHEN idx < cut THEN 0 ELSE cut END) AS lo, least(last_idx - {WINDOW} - {HORIZON}, idx + {24 * DAYS}, CASE WHEN idx < cut THEN cut ELSE last_idx END) AS hi FROM rm0
), dw AS (
  SELECT *, lo + {_DRAW.format("id || ':' || j::VARCHAR")} % (hi - lo) AS drawn FROM rm, range(1, {CONTROLS + 1}) t(j) WHERE far >= 0 AND wide > 0 AND hi > lo
), lvs AS (
  SELECT d.id || '/' || j AS id, d.id AS zone, d.symbol, d.dir, d.drawn, b.close - d.dir * d.far * b.atr AS entry, b.close - d.dir * d.far * b.atr - d.dir * d.wide * b.atr - d.dir * {TICK}::DOUBLE AS stop, b.atr
  FROM dw d JOIN bars b ON b.symbol = d.symbol AND b.idx = d.drawn - 1 WHERE b.atr > 0
), tch AS (
  SELECT l.*, (SELECT min(b.idx) FROM bars b WHERE b.symbol = l.symbol AND b.idx >= l.drawn AND b.idx < l.drawn + {WINDOW} AND CASE WHEN l.dir = 1 THEN b.low <= l.entry ELSE b.high >= l.entry END) AS touch_idx FROM lvs l
)"""


@once_a_query
def _levels(spark, d):
    bars = structure(spark, d)[0]
    gaps = S.fair_value_gaps(bars, OPTIONS.fvg_min_atr)
    zones = gaps.select(
        F.concat_ws(":", "symbol", "created_idx", "dir").alias("id"), "symbol", "dir", F.col("created_idx").alias("idx"),
        F.when(F.col("dir") == 1, F.col("top")).otherwise(F.col("bottom")).alias("entry"), "top", "bottom",
    )
    return bars, made_once(C.random_levels(zones, bars, CONTROLS, DAYS, WARM, WINDOW, HORIZON, TICK, SPLIT), "levels")


@R.add(f"{STRUCTURE}, {FVG}, {LEVELS} SELECT id, zone, drawn AS drawn_idx, round(entry, 4) AS entry, round(stop, 4) AS stop, coalesce(touch_idx, -1) AS touch_idx FROM tch")
def sim_random_levels(spark, d):
    rows = _levels(spark, d)[1]
    return rows.select("id", "zone", "drawn_idx", F.round("entry", 4).alias("entry"), F.round("stop", 4).alias("stop"), F.coalesce("touch_idx", F.lit(-1)).alias("touch_idx"))


@R.add(
    f"""{STRUCTURE}, {FVG}, {LEVELS}, orders_ AS (SELECT id, symbol, dir, touch_idx AS created_idx, entry, stop FROM tch WHERE touch_idx IS NOT NULL),
{RESULTS}
SELECT split_part(id, '/', 1) AS zone, count(*) AS n, round(avg(hit1::INT), 6) AS hit1, round(avg(hit2::INT), 6) AS hit2, round(avg(hit3::INT), 6) AS hit3, round(avg(mfe), 9) AS mfe, round(avg(mae), 9) AS mae FROM res GROUP BY 1"""
)
def sim_level_outcomes(spark, d):
    """Each zone's random levels that were touched: how often one to three units were reached, and the
    average best and worst move; zones of which none was touched are left out."""
    bars, rows = _levels(spark, d)
    touches = rows.where("touch_idx is not null").select("id", "symbol", "dir", F.col("touch_idx").alias("idx"), "entry", "stop")
    done = M.outcomes(touches, bars, HORIZON).withColumns({c: F.round(c, 6) for c in ("mfe", "mae")})
    means = [F.round(F.avg(F.col(c).cast("int")), 6).alias(c) for c in ("hit1", "hit2", "hit3")] + [F.round(F.avg(c), 9).alias(c) for c in ("mfe", "mae")]
    return done.groupBy(F.split_part("id", F.lit("/"), F.lit(1)).alias("zone")).agg(F.count("*").alias("n"), *means)
