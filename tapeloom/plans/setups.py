"""Queries from armed zones to orders: confirmation, targets, evaluation, and walks of taken trades."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.operators import setups as P
from tapeloom.operators import structure as S
from tapeloom.operators.passage import spans
from tapeloom.operators.persist import made_once
from tapeloom.plans import facts
from tapeloom.plans.base import BREAKS, OB, OPTIONS, STRUCTURE, SWINGS, Registry, bars_sql, minutes, structure, once_a_query
from tapeloom.sources.tape import tape

R = Registry()
O = P.OrderOptions(lookback=OPTIONS.lookback)
HORIZON = 60 * OPTIONS.lookback
CONFIRM_WINDOW = 1440

MINUTES = bars_sql("m0", "1 minute") + ", mins AS (SELECT *, (epoch(open_time) / 60)::BIGINT AS k FROM m0)"
ARMED = f"""zb AS (SELECT *, (epoch(open_time) / 60)::BIGINT + 60 AS end_k FROM bars), marm AS (
  SELECT s.*, s.symbol || ':' || s.break_idx || ':' || s.dir AS id,
    (SELECT min(m.k) FROM mins m WHERE m.symbol = s.symbol AND m.k >= c.end_k AND m.k < c.end_k + {HORIZON}
       AND CASE WHEN s.dir = 1 THEN m.low <= s.gap_top ELSE m.high >= s.gap_bottom END) AS armed_k
  FROM setups s JOIN zb c ON c.symbol = s.symbol AND c.idx = s.created_idx
)"""
BASE = f"{STRUCTURE}, {OB}, {facts.SWEEPS}, {facts.SETUPS}, {MINUTES}, {ARMED}"


def _rounding(value: str) -> str:
    return f"CASE WHEN dir = 1 THEN floor(({value}) * 100) / 100 ELSE ceil(({value}) * 100) / 100 END"


PLANS = f"""pl0 AS (
  SELECT a.*, b.idx AS kz, b.atr, b.end_k AS kz_end FROM marm a ASOF JOIN zb b ON a.symbol = b.symbol AND a.armed_k >= b.end_k WHERE a.armed_k IS NOT NULL
), pl1 AS (
  SELECT p.*, CASE WHEN p.dir = 1 THEN b.low ELSE b.high END AS wick FROM pl0 p JOIN bars b ON b.symbol = p.symbol AND b.idx = p.sweep_idx
), pl AS (
  SELECT *, CASE WHEN dir = 1 THEN top ELSE bottom END AS edge, {_rounding('(gap_bottom + gap_top) / 2')} AS middle,
    CASE WHEN dir = 1 THEN bottom - 0.01::DOUBLE ELSE top + 0.01::DOUBLE END AS stop_wick,
    CASE WHEN dir = 1 THEN bottom - (top - bottom) ELSE top + (top - bottom) END AS stop_height,
    {_rounding("CASE WHEN dir = 1 THEN least(bottom, wick) - 0.1::DOUBLE * coalesce(atr, 0) ELSE greatest(top, wick) + 0.1::DOUBLE * coalesce(atr, 0) END")} AS stop_structure
  FROM pl1
)"""


@once_a_query
def _minutes(spark, d):
    return made_once(P.by_time(minutes(spark, d), 60).select("symbol", "k", "high", "low", "open_time"), "minutes")


@once_a_query
def _armed(spark, d):
    bars, found = facts._setups(spark, d)
    mins = _minutes(spark, d)
    rows = found.withColumn("id", F.concat_ws(":", "symbol", "break_idx", "dir"))
    return bars, mins, P.armed_minutes(rows, bars, mins, HORIZON)


@once_a_query
def _plans(spark, d):
    bars, mins, armed = _armed(spark, d)
    return bars, mins, made_once(P.planned(armed, bars, O), "plans")


@R.add(f"{BASE} SELECT id, created_idx, coalesce(armed_k, -1) AS armed_k FROM marm")
def pat_minute_arming(spark, d):
    return _armed(spark, d)[2].select("id", "created_idx", F.coalesce("armed_k", F.lit(-1)).alias("armed_k"))


@R.add(f"{BASE}, {PLANS} SELECT id, kz, edge, middle, round(stop_wick, 4) AS stop_wick, round(stop_height, 4) AS stop_height, stop_structure FROM pl")
def pat_entry_and_stop_modes(spark, d):
    rows = _plans(spark, d)[2]
    return rows.select("id", "kz", "edge", "middle", F.round("stop_wick", 4).alias("stop_wick"), F.round("stop_height", 4).alias("stop_height"), "stop_structure")


EXEC = (
    bars_sql("e0", "15 minutes")
    + ", x_bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS idx, (epoch(open_time) / 900)::BIGINT AS k FROM e0), "
    + re.sub(r"\b(piv|bars|swings|force|hb|lb|ev0|ev)\b", r"x_\1", f"{SWINGS}, {BREAKS}")
)
CONFIRM = f"""tn0 AS (
  SELECT e.symbol, e.break_idx, e.dir AS side, b.idx, b.k, CASE WHEN e.dir = 1 THEN b.low ELSE b.high END AS px,
    row_number() OVER (PARTITION BY e.symbol, e.break_idx ORDER BY CASE WHEN e.dir = 1 THEN b.low ELSE -b.high END, b.idx) AS r
  FROM x_ev e JOIN x_bars b ON b.symbol = e.symbol AND b.idx BETWEEN e.level_idx AND e.break_idx
), tn AS (
  SELECT t.symbol, t.break_idx, t.side, t.idx AS origin_idx, t.k AS origin_k, t.px AS origin, b.k AS break_k, b.close AS price
  FROM tn0 t JOIN x_bars b ON b.symbol = t.symbol AND b.idx = t.break_idx WHERE t.r = 1
), ask AS (
  SELECT *, armed_k // 15 AS lo, (armed_k + {CONFIRM_WINDOW}) // 15 - 1 AS hi FROM pl
), cf AS (
  SELECT a.id, min(t.break_k) AS confirm_k FROM ask a JOIN tn t ON t.symbol = a.symbol AND t.side = a.dir AND t.break_k BETWEEN a.lo AND a.hi AND t.origin_k >= a.lo
    AND t.origin BETWEEN CASE WHEN a.dir = 1 THEN a.bottom ELSE a.gap_bottom END AND CASE WHEN a.dir = 1 THEN a.gap_top ELSE a.top END GROUP BY 1
), iv AS (
  SELECT a.id, min(b.k) AS invalid_k FROM ask a JOIN x_bars b ON b.symbol = a.symbol AND b.k BETWEEN a.lo AND a.hi AND CASE WHEN a.dir = 1 THEN b.close < a.bottom ELSE b.close > a.top END GROUP BY 1
), oc AS (
  SELECT a.id, a.symbol, a.dir, a.hi, confirm_k, invalid_k, CASE WHEN invalid_k <= coalesce(confirm_k, invalid_k) THEN 'ZONE_INVALID' WHEN confirm_k IS NOT NULL THEN 'CONFIRM'
    WHEN (SELECT max(k) FROM x_bars b WHERE b.symbol = a.symbol) > a.hi THEN 'NO_CONFIRM' ELSE 'OPEN' END AS outcome
  FROM ask a LEFT JOIN cf USING (id) LEFT JOIN iv USING (id)
), cfm AS (
  SELECT o.id, o.symbol, o.dir, o.outcome, CASE outcome WHEN 'CONFIRM' THEN confirm_k WHEN 'ZONE_INVALID' THEN invalid_k WHEN 'NO_CONFIRM' THEN hi END AS decided_k,
    t.price, t.origin, t.origin_idx, t.break_idx AS confirm_idx
  FROM oc o LEFT JOIN tn t ON o.outcome = 'CONFIRM' AND t.symbol = o.symbol AND t.side = o.dir AND t.break_k = o.confirm_k
)"""


@once_a_query
def _confirmed(spark, d):
    bars, mins, plans = _plans(spark, d)
    fine = made_once(P.by_time(B.numbered(B.bars_of_trades(tape(spark, d), "15m")), 900), "fine")
    events = S.breaks(fine, made_once(S.swings(fine, OPTIONS.swing_len), "fine_swings"))
    return fine, made_once(P.confirmation(plans, fine, events, 15, CONFIRM_WINDOW), "confirmed")


@R.add(
    f"""{BASE}, {PLANS}, {EXEC}, {CONFIRM} SELECT id, outcome, coalesce(decided_k, -1) AS decided_k, coalesce(price, -1) AS price, coalesce(origin, -1) AS origin FROM cfm"""
)
def pat_confirmation(spark, d):
    rows = _confirmed(spark, d)[1]
    return rows.select("id", "outcome", *(F.coalesce(F.col(c), F.lit(-1).cast(t)).alias(c) for c, t in (("decided_k", "long"), ("price", "double"), ("origin", "double"))))


@R.add(
    f"""{BASE}, {PLANS}, {EXEC}, {CONFIRM}, sh AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM x_bars WINDOW w AS (PARTITION BY symbol ORDER BY idx)),
r AS (SELECT c.id, c.dir, c.origin_idx AS lo, b.* FROM cfm c JOIN sh b ON b.symbol = c.symbol AND b.idx BETWEEN c.origin_idx AND c.confirm_idx WHERE c.outcome = 'CONFIRM'),
g AS (SELECT *, idx >= lo + 2 AND CASE WHEN dir = 1 THEN low > h2 ELSE high < l2 END AS is_gap, CASE WHEN dir = 1 THEN close < open ELSE close > open END AS against FROM r)
SELECT id, coalesce(arg_max(CASE WHEN dir = 1 THEN h2 ELSE high END, idx) FILTER (WHERE is_gap), -1) AS gap_low, coalesce(arg_max(CASE WHEN dir = 1 THEN low ELSE l2 END, idx) FILTER (WHERE is_gap), -1) AS gap_high,
  coalesce(arg_max(low, idx) FILTER (WHERE against), -1) AS block_low, coalesce(arg_max(high, idx) FILTER (WHERE against), -1) AS block_high FROM g GROUP BY id"""
)
def pat_confirming_zones(spark, d):
    fine, rows = _confirmed(spark, d)
    got = P.confirming_zones(rows, fine)
    return got.select("id", *(F.coalesce(F.col(c), F.lit(-1.0)).alias(c) for c in got.columns[1:]))


EXTREMES = """fm AS (
  SELECT p.id, max(m.high) AS fh, min(m.low) AS fl FROM pl p JOIN mins m ON m.symbol = p.symbol AND m.k >= p.kz_end AND m.k < p.armed_k GROUP BY 1
), lg AS (
  SELECT p.id, max(b.high) AS lh, min(b.low) AS ll FROM pl p JOIN bars b ON b.symbol = p.symbol AND b.idx BETWEEN p.ob_idx + 1 AND p.kz GROUP BY 1
), px0 AS (
  SELECT p.*, fh, fl, CASE WHEN dir = 1 THEN greatest(lh, fh) ELSE least(ll, fl) END AS leg0,
    (SELECT arg_max(s.price, s.idx) FROM swings s WHERE s.symbol = p.symbol AND s.confirmed_idx <= p.kz AND s.kind = CASE WHEN p.dir = 1 THEN 'HIGH' ELSE 'LOW' END) AS sw0
  FROM pl p LEFT JOIN fm USING (id) LEFT JOIN lg USING (id)
), px AS (
  SELECT *, CASE WHEN dir * (leg0 - edge) > 0 THEN leg0 END AS leg, CASE WHEN dir * (sw0 - edge) > 0 THEN sw0 END AS swing FROM px0
)"""


def _extremes(spark, d):
    bars, mins, plans = _plans(spark, d)
    pivots = made_once(S.swings(bars, OPTIONS.swing_len), "swings")
    return bars, mins, pivots, made_once(P.previous_extremes(plans, bars, mins, pivots), "extremes")


@R.add(f"{BASE}, {PLANS}, {EXTREMES} SELECT id, coalesce(leg, -1) AS leg, coalesce(swing, -1) AS swing FROM px")
def pat_previous_extreme(spark, d):
    rows = _extremes(spark, d)[3]
    return rows.select("id", F.coalesce("leg", F.lit(-1.0)).alias("leg"), F.coalesce("swing", F.lit(-1.0)).alias("swing"))


LIQUIDITY = f"""{bars_sql('d0', '1 day')}, dz AS (SELECT *, (epoch(open_time) / 60)::BIGINT + 1440 AS end_k FROM d0
), us AS (
  SELECT p.id, s.price FROM px p JOIN swings s ON s.symbol = p.symbol AND s.kind = CASE WHEN p.dir = 1 THEN 'HIGH' ELSE 'LOW' END AND s.idx BETWEEN p.kz - {OPTIONS.lookback} AND p.kz AND s.confirmed_idx <= p.kz
  WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = s.symbol AND b.idx > s.idx AND b.idx <= p.kz AND CASE WHEN s.kind = 'HIGH' THEN b.high > s.price ELSE b.low < s.price END)
    AND coalesce(CASE WHEN p.dir = 1 THEN p.fh <= s.price ELSE p.fl >= s.price END, true)
), dy AS (
  SELECT p.id, p.dir, p.symbol, p.armed_k, z.high, z.low, z.end_k FROM px p ASOF JOIN dz z ON p.symbol = z.symbol AND p.armed_k >= z.end_k
), ds AS (
  SELECT y.id, max(m.high) AS sh, min(m.low) AS sl FROM dy y JOIN mins m ON m.symbol = y.symbol AND m.k >= y.end_k AND m.k < y.armed_k GROUP BY 1
), lv2 AS (
  SELECT id, leg AS level, 0 AS rank FROM px UNION ALL SELECT id, price, 1 FROM us UNION ALL
  SELECT id, CASE WHEN dir = 1 THEN CASE WHEN coalesce(sh <= high, true) THEN high END ELSE CASE WHEN coalesce(sl >= low, true) THEN low END END, 2 FROM dy LEFT JOIN ds USING (id)
), lp AS (
  SELECT v.*, p.dir, p.edge, coalesce(p.atr, 0) AS atr, {_rounding('v.level - p.dir * (0.05::DOUBLE * coalesce(p.atr, 0))').replace('dir = 1', 'p.dir = 1')} AS target FROM lv2 v JOIN px p USING (id) WHERE v.level IS NOT NULL
), bst AS (
  SELECT * FROM lp WHERE dir * (target - edge) > 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dir * level, rank) = 1
), liq AS (
  SELECT b.id, b.level, ['leg', 'swing', 'day'][b.rank + 1] AS source, (SELECT count(*) FROM us u WHERE u.id = b.id AND abs(u.price - b.level) <= 0.1::DOUBLE * b.atr) >= 2 AS equal, b.target FROM bst b
)"""


def _liquidity(spark, d):
    bars, mins, pivots, rows = _extremes(spark, d)
    days = B.bars_of_trades(tape(spark, d), "1d")
    return bars, rows, P.liquidity_targets(rows, bars, mins, days, pivots, O)


@R.add(f"{BASE}, {PLANS}, {EXTREMES}, {LIQUIDITY} SELECT * FROM liq")
def pat_liquidity_target(spark, d):
    return _liquidity(spark, d)[2]


DISPLACED = """dm AS (
  SELECT p.id, p.dir, p.edge, (p.wick + CASE WHEN p.dir = 1 THEN max(b.high) ELSE min(b.low) END) / 2 AS mid
  FROM pl p JOIN bars b ON b.symbol = p.symbol AND b.idx BETWEEN p.sweep_idx AND p.created_idx GROUP BY p.id, p.dir, p.edge, p.wick
)"""


@R.add(f"{BASE}, {PLANS}, {DISPLACED} SELECT id, round(mid, 4) AS middle_of_move, dir * (edge - mid) <= 0 AS discount FROM dm")
def pat_discount_of_move(spark, d):
    bars, _, plans = _plans(spark, d)
    got = P.displacement_middles(plans, bars)
    return got.select("id", F.round("middle_of_move", 4).alias("middle_of_move"), "discount")


EVALUATED = f"""lt AS (
  SELECT p.id, min(b.idx) FILTER (WHERE CASE WHEN p.dir = 1 THEN b.low <= p.top OR b.close < p.bottom ELSE b.high >= p.bottom OR b.close > p.top END) AS tested,
    min(b.idx) FILTER (WHERE CASE WHEN p.dir = 1 THEN b.close < p.bottom ELSE b.close > p.top END) AS mitigated
  FROM pl p JOIN bars b ON b.symbol = p.symbol AND b.idx > p.created_idx AND b.idx <= p.created_idx + {OPTIONS.lookback} GROUP BY 1
), q0 AS (
  SELECT p.*, tested, mitigated, l.target, m.mid, edge + 0.0::DOUBLE AS en, stop_structure AS st,
    coalesce((SELECT arg_max(e.dir, e.break_idx) FROM ev e WHERE e.symbol = p.symbol AND e.break_idx <= p.kz), 0) AS trend
  FROM pl p LEFT JOIN lt USING (id) LEFT JOIN liq l USING (id) LEFT JOIN (SELECT id, mid FROM dm) m USING (id)
), q1 AS (
  SELECT *, abs(en - st) AS dist, en * 0.0002::DOUBLE + st * 0.0005::DOUBLE + st * 0.0002::DOUBLE AS fees, target - target * 0.0002::DOUBLE * dir AS fill FROM q0
), q2 AS (
  SELECT *, fees / dist AS cost, ((fill - en) * dir - en * 0.0002::DOUBLE - fill * 0.0005::DOUBLE) / (dist + fees) AS net,
    floor(10.0::DOUBLE / (dist + fees) * 100000) / 100000 AS wanted, floor(1000.0::DOUBLE / (1.5::DOUBLE * dist + 0.005::DOUBLE * en) * 100000) / 100000 AS cap FROM q1
), q3 AS (SELECT *, least(wanted, cap) AS qty, least(wanted, cap) * en / 1000 AS leverage FROM q2),
judged AS (
  SELECT id, cost, net, qty, leverage, coalesce(CASE WHEN trend = 0 THEN ['NO_BIAS'] WHEN trend <> dir THEN ['BIAS_MISMATCH'] WHEN mitigated <= kz OR kz > created_idx + {OPTIONS.lookback} THEN ['ZONE_INVALID']
    WHEN tested <= kz THEN ['NOT_FRESH'] WHEN dir * (en - st) <= 0 THEN ['BAD_STOP'] END,
    list_filter([CASE WHEN cost > 0.3 THEN 'COST_HEAVY' END, CASE WHEN dir * (edge - mid) > 0 THEN CASE WHEN dir = 1 THEN 'NOT_DISCOUNT' ELSE 'NOT_PREMIUM' END END,
      CASE WHEN target IS NULL THEN 'NO_TARGET' WHEN net < 1 THEN 'LOW_NET_RR' END, CASE WHEN cap < wanted AND qty <= 0 THEN 'LIQ_LIMITED' END, CASE WHEN leverage > 10 THEN 'LEVERAGE' END], lambda x: x IS NOT NULL)) AS reasons
  FROM q3
)"""
JUDGED = f"{BASE}, {PLANS}, {EXTREMES}, {LIQUIDITY}, {DISPLACED}, {EVALUATED}"


def _evaluated(spark, d):
    bars, rows, targets = _liquidity(spark, d)
    _, _, events = structure(spark, d)
    way = S.trend(bars, events).withColumnRenamed("idx", "kz")
    lived = S.lifetimes(rows, bars, OPTIONS.lookback, False)
    all_ = lived.join(way, ["symbol", "kz"]).join(targets.select("id", "target"), "id", "left").join(P.displacement_middles(rows, bars), "id", "left")
    return P.evaluated(all_, O)


@R.add(f"{JUDGED} SELECT id, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS accepted, round(cost, 6) AS cost, coalesce(round(net, 6), -9) AS net, round(qty, 5) AS qty, round(leverage, 6) AS leverage FROM judged")
def pat_evaluate(spark, d):
    return _evaluated(spark, d).select(
        "id", F.array_join("reasons", ",").alias("reasons"), (F.size("reasons") == 0).alias("accepted"), F.round("cost", 6).alias("cost"),
        F.coalesce(F.round("net", 6), F.lit(-9.0)).alias("net"), F.round("qty", 5).alias("qty"), F.round("leverage", 6).alias("leverage"),
    )


@R.add(f"{JUDGED}, f AS (SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['ACCEPTED'] ELSE reasons END) AS reason FROM judged) SELECT reason, count(*) AS n FROM f GROUP BY 1")
def vw_rejections(spark, d):
    shown = F.when(F.size("reasons") == 0, F.array(F.lit("ACCEPTED"))).otherwise(F.col("reasons"))
    return _evaluated(spark, d).select(F.explode(shown).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


#: Minutes that are still held, before the symbol's last.
HELD = 12 * 1440


@R.add(
    f"""{BASE}, held AS (SELECT m.* FROM mins m JOIN (SELECT symbol, max(k) AS last_k FROM mins GROUP BY 1) USING (symbol) WHERE k > last_k - {HELD}),
ht AS (
  SELECT s.symbol || ':' || s.break_idx || ':' || s.dir AS id, s.symbol, s.dir, s.gap_bottom, s.gap_top,
    (SELECT min(b.idx) FROM bars b WHERE b.symbol = s.symbol AND b.idx > s.created_idx AND b.idx <= s.created_idx + {OPTIONS.lookback}
       AND CASE WHEN s.dir = 1 THEN b.low <= s.gap_top ELSE b.high >= s.gap_bottom END) AS hit FROM setups s
), hk AS (
  SELECT h.*, z.end_k - 60 AS open_k, (SELECT min(k) FROM held WHERE held.symbol = h.symbol) AS first_k,
    (SELECT min(m.k) FROM held m WHERE m.symbol = h.symbol AND m.k >= z.end_k - 60 AND m.k < z.end_k AND CASE WHEN h.dir = 1 THEN m.low <= h.gap_top ELSE m.high >= h.gap_bottom END) AS k
  FROM ht h LEFT JOIN zb z ON z.symbol = h.symbol AND z.idx = h.hit
)
SELECT id, CASE WHEN hit IS NULL THEN 'NONE' WHEN first_k > open_k THEN 'ARMED_BEFORE' WHEN k IS NULL THEN 'NONE' ELSE 'ARMED' END AS arming,
  CASE WHEN hit IS NULL OR first_k > open_k THEN -1 ELSE coalesce(k, -1) END AS armed_k FROM hk"""
)
def pat_arming_states(spark, d):
    """Minutes of the last days only are held; a zone that was touched before them is ARMED_BEFORE."""
    bars, found = facts._setups(spark, d)
    mins = _minutes(spark, d)
    held = mins.join(mins.groupBy("symbol").agg(F.max("k").alias("last_k")), "symbol").where(F.col("k") > F.col("last_k") - HELD).drop("last_k")
    rows = P.arming_states(found.withColumn("id", F.concat_ws(":", "symbol", "break_idx", "dir")), bars, held, OPTIONS.lookback)
    return rows.select("id", "arming", F.coalesce("armed_k", F.lit(-1)).alias("armed_k"))


MODES = [
    P.Mode("touch_edge"),
    P.Mode("touch_leg", stop="wick", target="previous", discount="target"),
    P.Mode("touch_middle", entry="middle", stop="height", target="fixed", previous="swing", discount="target", rr=2.0),
    P.Mode("touch_swing", entry="middle", target="previous", previous="swing", discount="target"),
    P.Mode("market", order="market"),
    P.Mode("market_fixed", order="market", stop="wick", target="fixed", discount="target", rr=3.0),
    P.Mode("limit_gap", order="limit", entry="exec_gap", target="previous", discount="target"),
    P.Mode("limit_block", order="limit", entry="exec_block", stop="wick"),
]


def _named(text: str, names: str, prefix: str) -> str:
    """SQL with the tables of names (a|b|...) under other names; columns stand in brackets."""
    return re.sub(rf"(?<!\()\b({names})\b", rf"{prefix}\1", text)


_VALUES = ", ".join(f"('{m.name}', '{m.order}', '{m.entry}', '{m.stop}', '{m.target}', '{m.previous}', '{m.discount}', {m.rr}::DOUBLE)" for m in MODES)
IN_MODES = f"""sh AS (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM x_bars WINDOW w AS (PARTITION BY symbol ORDER BY idx)
), cg AS (
  SELECT c.id, c.dir, b.*, b.idx >= c.origin_idx + 2 AND CASE WHEN c.dir = 1 THEN low > h2 ELSE high < l2 END AS is_gap, CASE WHEN c.dir = 1 THEN close < open ELSE close > open END AS against
  FROM cfm c JOIN sh b ON b.symbol = c.symbol AND b.idx BETWEEN c.origin_idx AND c.confirm_idx WHERE c.outcome = 'CONFIRM'
), cz AS (
  SELECT id, arg_max(CASE WHEN dir = 1 THEN h2 ELSE high END, idx) FILTER (WHERE is_gap) AS gap_low, arg_max(CASE WHEN dir = 1 THEN low ELSE l2 END, idx) FILTER (WHERE is_gap) AS gap_high,
    arg_max(low, idx) FILTER (WHERE against) AS block_low, arg_max(high, idx) FILTER (WHERE against) AS block_high FROM cg GROUP BY id
), c_marm AS (
  SELECT m.* REPLACE ((c.decided_k + 1) * 15 AS armed_k) FROM marm m JOIN cfm c USING (id) WHERE c.outcome = 'CONFIRM'
), {_named(PLANS, "pl0|pl1|pl|marm", "c_")}, md(mode, kind, entry_mode, stop_mode, target_mode, previous_mode, discount_mode, rr) AS (VALUES {_VALUES}),
mm AS (
  SELECT p.*, md.*, NULL::DOUBLE AS price, NULL::DOUBLE AS gap_low, NULL::DOUBLE AS gap_high, NULL::DOUBLE AS block_low, NULL::DOUBLE AS block_high FROM pl p, md WHERE kind = 'touch'
  UNION ALL BY NAME SELECT p.*, md.*, c.price, z.gap_low, z.gap_high, z.block_low, z.block_high FROM c_pl p JOIN cfm c USING (id) LEFT JOIN cz z USING (id), md WHERE kind <> 'touch'
), m_pl AS (
  SELECT * REPLACE (id || '/' || mode AS id, CASE WHEN kind = 'market' THEN price WHEN entry_mode = 'edge' THEN edge
      WHEN entry_mode = 'exec_gap' THEN coalesce({_rounding('(gap_low + gap_high) / 2')}, CASE WHEN dir = 1 THEN block_high ELSE block_low END, middle)
      WHEN entry_mode = 'exec_block' THEN coalesce(CASE WHEN dir = 1 THEN block_high ELSE block_low END, middle) ELSE middle END AS edge),
    edge AS block_edge, CASE stop_mode WHEN 'wick' THEN stop_wick WHEN 'height' THEN stop_height ELSE stop_structure END AS st FROM mm
)"""
_M = "pl|px0|px|fm|lg|us|dy|ds|lv2|lp|bst|liq|dm"
_LIVED = EVALUATED[: EVALUATED.index("), q0 AS (")]
MODE_EVALUATED = f"""{_named(f"{EXTREMES}, {LIQUIDITY}, {DISPLACED}, {_LIVED})", _M, "m_")}, mj0 AS (
  SELECT p.*, tested, mitigated, l.target AS liquid, m.mid, edge + 0.0::DOUBLE AS en, CASE previous_mode WHEN 'swing' THEN swing ELSE leg END AS plevel,
    CASE WHEN kind = 'market' THEN 0.0005::DOUBLE ELSE 0.0002::DOUBLE END AS paid,
    coalesce((SELECT arg_max(e.dir, e.break_idx) FROM ev e WHERE e.symbol = p.symbol AND e.break_idx <= p.kz), 0) AS trend
  FROM m_px p LEFT JOIN lt USING (id) LEFT JOIN m_liq l USING (id) LEFT JOIN (SELECT id, mid FROM m_dm) m USING (id)
), mj1 AS (
  SELECT *, abs(en - st) AS dist, {_rounding('plevel - dir * (0.05::DOUBLE * coalesce(atr, 0))')} AS front FROM mj0
), mj2 AS (
  SELECT *, CASE target_mode WHEN 'fixed' THEN {_rounding('en + dir * (rr * dist)')} WHEN 'previous' THEN CASE WHEN dir * (front - en) > 0 THEN front END ELSE liquid END AS target,
    CASE discount_mode WHEN 'move' THEN dir * (block_edge - mid) > 0 ELSE dir * (en - (wick + plevel) / 2) > 0 END AS dear,
    en * paid + st * 0.0005::DOUBLE + st * 0.0002::DOUBLE AS fees FROM mj1
), mj3 AS (
  SELECT *, CASE WHEN dist > 0 THEN fees / dist END AS cost, target - target * 0.0002::DOUBLE * dir AS fill,
    floor(10.0::DOUBLE / (dist + fees) * 100000) / 100000 AS wanted, floor(1000.0::DOUBLE / (1.5::DOUBLE * dist + 0.005::DOUBLE * en) * 100000) / 100000 AS cap FROM mj2
), mj4 AS (
  SELECT *, ((fill - en) * dir - en * paid - fill * 0.0005::DOUBLE) / (dist + fees) AS net, least(wanted, cap) AS qty, least(wanted, cap) * en / 1000 AS leverage FROM mj3
), m_judged AS (
  SELECT id, mode, armed_k AS at_k, en AS entry, st AS stop, target, net, coalesce(CASE WHEN trend = 0 THEN ['NO_BIAS'] WHEN trend <> dir THEN ['BIAS_MISMATCH'] WHEN mitigated <= kz OR kz > created_idx + {OPTIONS.lookback} THEN ['ZONE_INVALID']
    WHEN tested <= kz AND kind <> 'market' THEN ['NOT_FRESH'] WHEN dir * (en - st) <= 0 THEN ['BAD_STOP'] END,
    list_filter([CASE WHEN cost > 0.3 THEN 'COST_HEAVY' END, CASE WHEN dear THEN CASE WHEN dir = 1 THEN 'NOT_DISCOUNT' ELSE 'NOT_PREMIUM' END END,
      CASE WHEN target IS NULL THEN 'NO_TARGET' WHEN net < 1 THEN 'LOW_NET_RR' END, CASE WHEN cap < wanted AND qty <= 0 THEN 'LIQ_LIMITED' END, CASE WHEN leverage > 10 THEN 'LEVERAGE' END], lambda x: x IS NOT NULL)) AS reasons FROM mj4
  UNION ALL SELECT c.id || '/' || mode, mode, (decided_k + 1) * 15, NULL, NULL, NULL, NULL, [outcome] FROM cfm c, md WHERE kind <> 'touch' AND outcome IN ('NO_CONFIRM', 'ZONE_INVALID')
)"""
IN_ALL_MODES = f"{BASE}, {PLANS}, {EXEC}, {CONFIRM}, {IN_MODES}, {MODE_EVALUATED}"


@once_a_query
def _judged(spark, d):
    """Every setup's order in every mode: at its moment evaluated, or rejected for want of a confirmation."""
    bars, mins, armed = _armed(spark, d)
    plans = _plans(spark, d)[2]
    fine, decided = _confirmed(spark, d)
    _, pivots, events = structure(spark, d)
    won = decided.where("outcome = 'CONFIRM'").select("id", "price", ((F.col("decided_k") + 1) * 15).alias("_at"))
    later_ = P.planned(armed.join(won, "id").withColumn("armed_k", F.col("_at")).drop("_at"), bars, O)
    rows = made_once(P.in_modes(plans, later_, P.confirming_zones(decided, fine), MODES, O), "in_modes")
    seen = made_once(P.previous_extremes(rows, bars, mins, pivots), "mode_extremes")
    liquid = P.liquidity_targets(seen, bars, mins, B.bars_of_trades(tape(spark, d), "1d"), pivots, O)
    moved = P.displacement_middles(seen, bars)
    lived = S.lifetimes(plans.select("id", "symbol", "dir", "created_idx", "bottom", "top"), bars, OPTIONS.lookback, False)
    way = S.trend(bars, events).withColumnRenamed("idx", "kz")
    ready = P.targets_in_modes(seen, liquid, moved, O).join(way, ["symbol", "kz"])
    ready = ready.join(lived.select(F.col("id").alias("setup"), "tested_idx", "mitigated_idx"), "setup", "left")
    judged = P.evaluated_orders(ready, O).select("id", "mode", F.col("armed_k").alias("at_k"), "entry", "stop", "target", "net", "reasons")
    lost = decided.where("outcome in ('NO_CONFIRM', 'ZONE_INVALID')").select(
        F.col("id").alias("setup"), ((F.col("decided_k") + 1) * 15).alias("at_k"), F.array("outcome").alias("reasons"),
        F.explode(F.array(*(F.lit(m.name) for m in MODES if m.order != "touch"))).alias("mode"),
    )
    lost = lost.select(F.concat_ws("/", "setup", "mode").alias("id"), "mode", "at_k", "reasons")
    return made_once(judged.unionByName(lost, allowMissingColumns=True), "judged")


@R.add(
    f"""{IN_ALL_MODES} SELECT id, mode, at_k, coalesce(round(entry, 4), -1) AS entry, coalesce(round(stop, 4), -1) AS stop, coalesce(round(target, 4), -1) AS target,
  coalesce(round(net, 6), -9) AS net, array_to_string(reasons, ',') AS reasons FROM m_judged"""
)
def pat_evaluate_modes(spark, d):
    rows = _judged(spark, d)
    shown = [F.coalesce(F.round(c, 4), F.lit(-1.0)).alias(c) for c in ("entry", "stop", "target")]
    return rows.select("id", "mode", "at_k", *shown, F.coalesce(F.round("net", 6), F.lit(-9.0)).alias("net"), F.array_join("reasons", ",").alias("reasons"))
