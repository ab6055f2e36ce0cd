"""Queries of persistence, feed comparison and research statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions.grid import seconds
from tapeloom.operators import reconcile as C
from tapeloom.operators import stats
from tapeloom.plans.base import TAPE, Registry, bars_sql, minutes
from tapeloom.sources.tape import table, tape

R = Registry()
_BOTH = f"WITH {TAPE}, {bars_sql('live', '1 minute', where='WHERE conn <> 0')}, {bars_sql('hist', '1 minute')}"


@R.add(f"{_BOTH} SELECT h.symbol, h.open_time, h.close FROM hist h WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.symbol = h.symbol AND l.open_time = h.open_time)")
def snk_idempotent_insert(spark, d):
    return C.insert_new(minutes(spark, d, "live"), minutes(spark, d), ["symbol", "open_time"]).select("symbol", "open_time", "close")


@R.add(
    f"""{_BOTH} SELECT coalesce(l.symbol, h.symbol) AS symbol, coalesce(l.open_time, h.open_time) AS open_time,
  CASE WHEN l.symbol IS NULL THEN 'INSERTED' WHEN l.close = h.close AND l.n = h.n THEN 'UNCHANGED' ELSE 'REVISED' END AS action,
  CASE WHEN l.symbol IS NULL THEN 0 WHEN l.close = h.close AND l.n = h.n THEN 3 ELSE 4 END AS revision
FROM live l FULL JOIN hist h ON l.symbol = h.symbol AND l.open_time = h.open_time"""
)
def snk_audited_reconcile(spark, d):
    stored = minutes(spark, d, "live").withColumn("revision", F.lit(3))
    return C.reconcile(stored, minutes(spark, d), ["symbol", "open_time"], ["close", "n"]).select("symbol", "open_time", "action", "revision")


@R.add("SELECT o_custkey AS k, o_orderkey, round(o_totalprice, 2) AS total FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) r FROM orders) WHERE r = 1")
def snk_overwrite_upsert(spark, d):
    o = table(spark, d, "orders")
    newest = C.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return newest.select(F.col("o_custkey").alias("k"), "o_orderkey", F.round("o_totalprice", 2).alias("total"))


@R.add(
    """SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'GAP' ELSE 'TRADE' END AS kind,
  '{"symbol":"' || event_type || '","user":' || user_id || '}' AS payload FROM events"""
)
def snk_journal(spark, d):
    e = table(spark, d, "events")
    payload = F.to_json(F.struct(F.col("event_type").alias("symbol"), F.col("user_id").alias("user")))
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "GAP").otherwise("TRADE").alias("kind"), payload.alias("payload"))


@R.add(
    f"""{_BOTH} SELECT symbol, count(*) FILTER (WHERE l IS NULL) AS only_right, count(*) FILTER (WHERE l IS NOT NULL AND lc <> hc) AS close_differs,
  count(*) FILTER (WHERE l IS NOT NULL AND ln <> hn) AS n_differs, count(*) AS n
FROM (SELECT h.symbol, l.symbol AS l, l.close AS lc, h.close AS hc, l.n AS ln, h.n AS hn FROM hist h LEFT JOIN live l ON l.symbol = h.symbol AND l.open_time = h.open_time) GROUP BY symbol"""
)
def jn_full_outer_compare(spark, d):
    c = C.compare(minutes(spark, d, "live"), minutes(spark, d), ["symbol", "open_time"], ["close", "n"])
    return c.groupBy("symbol").agg(
        F.count_if("only_right").alias("only_right"), F.count_if("close_differs").alias("close_differs"), F.count_if("n_differs").alias("n_differs"), F.count("*").alias("n")
    )


@R.add(f"{_BOTH} SELECT l.symbol, count(*) AS n, count(*) FILTER (WHERE l.close <> h.close) AS mismatches FROM live l JOIN hist h USING (symbol, open_time) GROUP BY 1")
def jn_inner_mismatches(spark, d):
    h = minutes(spark, d).select("symbol", "open_time", F.col("close").alias("other"))
    return minutes(spark, d, "live").join(h, ["symbol", "open_time"]).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("close") != F.col("other")).alias("mismatches"))


@R.add("SELECT n_name, r_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def jn_foreign_keys(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    named = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return named.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"))


@R.add(
    """SELECT c_custkey, coalesce(o.o_orderkey, -1) AS o_orderkey FROM customer c LEFT JOIN LATERAL
  (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) o ON true"""
)
def jn_lateral_latest(spark, d):
    newest = C.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return table(spark, d, "customer").select("c_custkey").join(newest, "c_custkey", "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


@R.add("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def jn_semi(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_semi")


@R.add("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def jn_anti(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(big, "o_orderkey", "left_anti")


@R.add(
    f"""WITH {TAPE}, e AS (SELECT trade_id AS id, symbol, conn, epoch_us(ts) AS us FROM tape)
SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.symbol = b.symbol AND a.id < b.id AND a.conn <> b.conn AND abs(a.us - b.us) <= 30000000"""
)
def jn_pairwise_correlated(spark, d):
    e = tape(spark, d).select(F.col("trade_id").alias("id"), "symbol", "conn", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("us"))
    width = 30_000_000
    slot = F.floor(F.col("us") / width)
    a = e.withColumn("slot", slot).alias("a")
    b = e.withColumn("slot", F.explode(F.array(slot - 1, slot, slot + 1))).alias("b")
    near = (F.col("a.id") < F.col("b.id")) & (F.col("a.conn") != F.col("b.conn")) & (F.abs(F.col("a.us") - F.col("b.us")) <= width)
    return a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a.slot") == F.col("b.slot"))).where(near).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


@R.add(
    f"""{_BOTH} SELECT m.symbol, count(*) AS n, count(*) FILTER (WHERE m.open = p.close) AS joined_up FROM hist m JOIN hist p ON p.symbol = m.symbol AND p.open_time = m.open_time - INTERVAL 1 MINUTE GROUP BY 1"""
)
def jn_previous_minute(spark, d):
    m = minutes(spark, d)
    p = m.select("symbol", F.timestamp_add("MINUTE", F.lit(1), F.col("open_time")).alias("open_time"), F.col("close").alias("before"))
    return m.join(p, ["symbol", "open_time"]).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("open") == F.col("before")).alias("joined_up"))


def _feeds(spark, d):
    e = table(spark, d, "events").select(
        F.floor(F.col("value") / 10).alias("fp"), F.col("event_id").alias("id"), seconds("ts").cast("double").alias("t"), "event_type", "user_id"
    )
    return e.where("user_id % 2 = 0").drop("user_id"), e.where("user_id % 2 = 1").drop("user_id")


@R.add()
def jn_nearest_once(spark, d):
    """No SQL: each row is used once, in order of time. tests hold it against a plain loop."""
    a, b = _feeds(spark, d)
    return C.nearest_matches(a, b, ["event_type", "fp"], 60.0)


@R.add()
def jn_order_keeping_alignment(spark, d):
    """No SQL: a dynamic programme a group. tests hold it against a plain search."""
    a, b = _feeds(spark, d)
    return C.aligned(a, b, ["event_type", "fp"], 60.0, 600.0)


@R.add(
    """WITH r AS (SELECT l_returnflag AS g, l_orderkey * 10 + l_linenumber AS id, l_quantity AS v FROM lineitem),
s AS (SELECT g, ('0x' || substr(md5(id::VARCHAR || ':bin'), 1, 8))::BIGINT % 1000 AS bin, sum(v) AS v, count(*) AS c FROM r GROUP BY ALL),
d AS (SELECT g, v, c, b, ('0x' || substr(md5(bin::VARCHAR || ':' || b::VARCHAR), 1, 8))::BIGINT % 100000 AS u FROM s, range(1, 2001) t(b)),
w AS (SELECT *, (u >= 36788)::INT + (u >= 73576)::INT + (u >= 91970)::INT + (u >= 98101)::INT + (u >= 99634)::INT + (u >= 99941)::INT + (u >= 99992)::INT AS w FROM d),
m AS (SELECT g, b, sum(w * v) / sum(w * c) AS m FROM w GROUP BY ALL)
SELECT g, round(mean, 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m JOIN (SELECT g, avg(v) AS mean FROM r GROUP BY 1) USING (g) GROUP BY g, mean"""
)
def agg_bootstrap_interval(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("g"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("v")
    )
    b = stats.bootstrap_mean(rows, "g", "id", "v", 2000)
    return b.select("g", *(F.round(c, 6).alias(c) for c in ("mean", "low", "high")))


@R.add(
    f"""{_BOTH}, s AS (SELECT symbol, open_time, sign(close - open) AS a, sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY open_time)) AS b FROM hist)
SELECT symbol, count(*) AS n, round(avg((a = b)::INT), 6) AS share FROM s WHERE b IS NOT NULL GROUP BY 1"""
)
def agg_state_agreement(spark, d):
    w = Window.partitionBy("symbol").orderBy("open_time")
    s = minutes(spark, d).select("symbol", F.signum(F.col("close") - F.col("open")).alias("a"), F.signum(F.col("close") - F.lag("close").over(w)).alias("b"))
    return stats.agreement(s.where("b is not null"), "a", "b").withColumn("share", F.round("share", 6))


@R.add()
def sim_random_controls(spark, d):
    """No SQL: controls are drawn by hash slices; tests check number, keys, and that all is drawn once."""
    e = table(spark, d, "events")
    events = e.where("event_type = 'purchase'").select(F.col("event_id").alias("event_id"), F.hour("ts").alias("hour"))
    pool = e.where("event_type <> 'purchase'").select(F.col("event_id").alias("control_id"), F.hour("ts").alias("hour"))
    return stats.controls(events, pool, ["hour"], 5)
