"""What the registered queries share: tables made from the test tables, and the same in SQL."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import bars as B
from tapeloom.operators import indicators as I
from tapeloom.operators import structure as S
from tapeloom.operators.persist import made_once
from tapeloom.sources.tape import table, tape

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """df with decimals as doubles: sums are exact decimals, results are doubles."""
    return df.select(*(F.col(f.name).cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f.name) for f in df.schema))


_made: dict[tuple, object] = {}


def once_a_query(make: Callable) -> Callable:
    """make(spark, sf_dir), called once while a query is built, however many of its parts ask for it."""

    @functools.wraps(make)
    def kept(spark: SparkSession, sf_dir: str):
        key = make.__module__, make.__name__, id(spark), sf_dir
        if key not in _made:
            _made[key] = make(spark, sf_dir)
        return _made[key]

    return kept


class Registry:
    """Queries by name, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def put(f: Query) -> Query:
            def query(spark: SparkSession, sf_dir: str) -> DataFrame:
                _made.clear()
                return plain(f(spark, sf_dir))

            self.queries[f.__name__] = query
            if sql:  # DuckDB would run a shared table anew for each use
                self.sql[f.__name__] = re.sub(r"(\w+) AS \((?!\s*PARTITION)", r"\1 AS MATERIALIZED (", sql)
            return f

        return put


OPTIONS = S.StructureOptions(swing_len=3, ob_lookback=60, fvg_min_atr=0.3, ob_min_atr=0.3, eq_tol_atr=0.1, lookback=120)
ATR_LEN = 14


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of two of the three connections."""
    return tape(spark, sf_dir).where("conn <> 0")


def minutes(spark: SparkSession, sf_dir: str, of: str = "all") -> DataFrame:
    return B.bars_of_trades(tape(spark, sf_dir) if of == "all" else live(spark, sf_dir), "1m")


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered 1-hour bars."""
    return B.numbered(B.bars_of_trades(tape(spark, sf_dir), "1h"))


def hours_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.with_atr(hours(spark, sf_dir), ATR_LEN)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trades of a day: symbol, ts, price."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderkey").alias("key"),
    )


#: SQL of the tables above; a query's SQL begins with WITH and those that it needs.
TAPE = """tape AS (
  SELECT event_id AS trade_id, event_type AS symbol, ts, user_id % 3 AS conn, CAST(value AS DECIMAL(18,2)) AS qty, props,
         CAST(10000 + sum(CAST(value AS DECIMAL(18,2)) - 50) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS DOUBLE) AS px
  FROM events
)"""


def bars_sql(name: str, width: str, source: str = "tape", offset: str | None = None, where: str = "") -> str:
    bucket = f"time_bucket(INTERVAL '{width}', ts{f", INTERVAL '{offset}'" if offset else ''})"
    return f"""{name} AS (
  SELECT symbol, {bucket} AS open_time, first(px ORDER BY ts, trade_id) AS open, max(px) AS high, min(px) AS low,
         last(px ORDER BY ts, trade_id) AS close, sum(qty)::DOUBLE AS volume, count(*) AS n
  FROM {source} {where} GROUP BY ALL
)"""


HOURS = bars_sql("h0", "1 hour") + """, hours AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1 AS idx FROM h0
)"""
ATR = f"""trs AS (
  SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN high - low
                 ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
  FROM hours WINDOW w AS (PARTITION BY symbol ORDER BY idx)
), rec(symbol, idx, total, atr) AS (
  SELECT symbol, idx, tr, CAST(NULL AS DOUBLE) FROM trs WHERE idx = 0
  UNION ALL
  SELECT t.symbol, t.idx, r.total + t.tr,
         CASE WHEN t.idx < {ATR_LEN - 1} THEN NULL WHEN t.idx = {ATR_LEN - 1} THEN (r.total + t.tr) / {ATR_LEN}
              ELSE (r.atr * {ATR_LEN - 1} + t.tr) / {ATR_LEN} END
  FROM rec r JOIN trs t ON t.symbol = r.symbol AND t.idx = r.idx + 1
), bars AS (SELECT t.*, r.atr FROM trs t JOIN rec r USING (symbol, idx))"""
N = OPTIONS.swing_len
SWINGS = f"""piv AS (
  SELECT symbol, idx, high, low,
         count(*) OVER a = {N} AND count(*) OVER b = {N} AND high > max(high) OVER a AND high >= max(high) OVER b AS is_high,
         count(*) OVER a = {N} AND count(*) OVER b = {N} AND low < min(low) OVER a AND low <= min(low) OVER b AS is_low
  FROM bars
  WINDOW a AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN {N} PRECEDING AND 1 PRECEDING),
         b AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {N} FOLLOWING)
), swings AS (
  SELECT symbol, 'HIGH' AS kind, idx, high AS price, idx + {N} AS confirmed_idx FROM piv WHERE is_high
  UNION ALL
  SELECT symbol, 'LOW', idx, low, idx + {N} FROM piv WHERE is_low
)"""
BREAKS = """force AS (
  SELECT *, coalesce(lead(confirmed_idx) OVER (PARTITION BY symbol, kind ORDER BY confirmed_idx), 1000000000) AS until FROM swings
), hb AS (
  SELECT f.symbol, f.idx AS level_idx, f.price AS level, min(b.idx) AS break_idx
  FROM force f JOIN bars b ON b.symbol = f.symbol AND b.idx >= f.confirmed_idx AND b.idx < f.until AND b.close > f.price
  WHERE kind = 'HIGH' GROUP BY ALL
), lb AS (
  SELECT f.symbol, f.idx AS level_idx, f.price AS level, min(b.idx) AS break_idx
  FROM force f JOIN bars b ON b.symbol = f.symbol AND b.idx >= f.confirmed_idx AND b.idx < f.until AND b.close < f.price
  WHERE kind = 'LOW' AND NOT EXISTS (SELECT 1 FROM hb WHERE hb.symbol = b.symbol AND hb.break_idx = b.idx)
  GROUP BY ALL
), ev0 AS (
  SELECT symbol, break_idx, 1 AS dir, level, level_idx FROM hb UNION ALL SELECT symbol, break_idx, -1, level, level_idx FROM lb
), ev AS (
  SELECT *, CASE WHEN lag(dir) OVER (PARTITION BY symbol ORDER BY break_idx) = -dir THEN 'CHOCH' ELSE 'BOS' END AS kind FROM ev0
)"""
FVG = f"""fvg AS (
  SELECT symbol, idx AS created_idx, CASE WHEN low > h2 THEN 1 ELSE -1 END AS dir,
         CASE WHEN low > h2 THEN h2 ELSE high END AS bottom, CASE WHEN low > h2 THEN low ELSE l2 END AS top
  FROM (SELECT *, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx))
  WHERE (low > h2 AND (atr IS NULL OR low - h2 >= {OPTIONS.fvg_min_atr} * atr))
     OR (high < l2 AND (atr IS NULL OR l2 - high >= {OPTIONS.fvg_min_atr} * atr))
)"""
OB = f"""cand AS (
  SELECT e.symbol, e.break_idx, e.dir, max(b.idx) AS ob_idx
  FROM ev e JOIN bars b ON b.symbol = e.symbol AND b.idx BETWEEN greatest(e.level_idx + 1, e.break_idx - {OPTIONS.ob_lookback}) AND e.break_idx - 1
   AND CASE WHEN e.dir = 1 THEN b.close < b.open ELSE b.close > b.open END
  GROUP BY ALL
), near AS (
  SELECT symbol, idx, high, low, lead(high, 2) OVER w AS high2, lead(low, 2) OVER w AS low2 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY idx)
), ob AS (
  SELECT c.symbol, c.break_idx, c.dir, c.ob_idx, x.low AS bottom, x.high AS top,
         CASE WHEN c.dir = 1 THEN x.high ELSE x.high2 END AS gap_bottom, CASE WHEN c.dir = 1 THEN x.low2 ELSE x.low END AS gap_top,
         greatest(c.break_idx, c.ob_idx + 2) AS created_idx
  FROM cand c JOIN near x ON x.symbol = c.symbol AND x.idx = c.ob_idx
  JOIN bars k ON k.symbol = c.symbol AND k.idx = c.break_idx
  WHERE (k.atr IS NULL OR x.high - x.low >= {OPTIONS.ob_min_atr} * k.atr)
    AND CASE WHEN c.dir = 1 THEN x.low2 > x.high ELSE x.high2 < x.low END
)"""
STRUCTURE = f"WITH RECURSIVE {TAPE}, {HOURS}, {ATR}, {SWINGS}, {BREAKS}"


@once_a_query
def structure(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hourly bars with ATR, swings and breaks, each made once."""
    bars = made_once(hours_atr(spark, sf_dir), "bars")
    pivots = made_once(S.swings(bars, OPTIONS.swing_len), "swings")
    return bars, pivots, made_once(S.breaks(bars, pivots), "breaks")
