"""Slots, break-even costs and coverage against plain versions."""

import random

import pytest

from tapeloom.operators import feed
from tapeloom.operators import portfolio as P


def greedy(trades, slots):
    busy, taken = [], set()
    for name, start, end in sorted(trades, key=lambda t: (t[1], t[0])):
        busy = [x for x in busy if x > start]
        if len(busy) < slots:
            busy.append(end)
            taken.add(name)
    return taken


@pytest.mark.parametrize("keys", [[], ["book"]])
def test_slots_equal_plain_taking(spark, keys):
    rnd = random.Random(11)
    rows = [(f"t{k:03d}", rnd.choice("ab"), s, s + rnd.choice((0, 1, 3, 20, 90))) for k in range(300) for s in [rnd.randint(-50, 3000)]]
    df = spark.createDataFrame(rows, "id string, book string, start long, end long")
    got = {r.id for r in P.admitted(df, keys, "start", "end", 2, 40).collect()}
    books = [[(r[0], r[2], r[3]) for r in rows if not keys or r[1] == b] for b in ("ab" if keys else "a")]
    assert got == set().union(*(greedy(b, 2) for b in books))
    assert P.admitted(df.where("false"), keys, "start", "end", 2, 40).count() == 0


def test_break_even_is_a_root(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.gauss(m, 2), 0.4, 1.0, 0.4) for k, m in (("win", 1.5), ("lose", -1.5)) for _ in range(200)] + [("free", 5.0, 0.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, gross double, cost double, unit double, risk_cost double")
    got = {r.k: r.factor for r in P.break_even(df, "k").collect()}
    assert got["lose"] is None and got["free"] == pytest.approx(64)
    total = [sum((g - f * c) / (u + f * v) for k, g, c, u, v in rows if k == "win") for f in (got["win"], got["win"] + 1e-6)]
    assert 0 < got["win"] < 64 and total[0] > 0 >= total[1]


def test_coverage_and_release(spark):
    s = 1_000_000
    rows = [
        ("A", 10 * s, 1, "PONG", 9 * s), ("A", 20 * s, 2, "PONG", 19 * s), ("A", 21 * s, 3, "LOST", None),
        ("B", 15 * s, 4, "PONG", 14 * s), ("B", 40 * s, 5, "PONG", 39 * s),
        ("A", 60 * s, 6, "PONG", 59 * s), ("A", 8 * s, 7, "TRADE", None), ("A", 12 * s, 8, "TRADE", None),
        ("A", 20 * s, 9, "TRADE", None), ("B", 50 * s, 10, "TRADE", None), ("A", 20 * s, 11, "TRADE", None), ("B", 30 * s, 11, "TRADE", None),
    ]
    found = feed.with_sessions(spark.createDataFrame(rows, "conn string, at_us long, id long, kind string, sent_us long"))
    proven = feed.proofs(found, s // 2)
    spans = sorted((r.start, r.end) for r in feed.coverage(proven).collect())
    assert spans == [(int(10.5 * s), int(38.5 * s)), (int(60.5 * s), int(60.5 * s))]
    trades = found.where("kind = 'TRADE'").withColumnRenamed("id", "trade_id").select("trade_id", "conn", "session", "at_us")
    states = {r.trade_id: r.state for r in feed.released(trades, proven).collect()}
    assert states == {7: "IN_GAP", 8: "PROVEN", 9: "ORPHAN", 10: "PENDING", 11: "PROVEN"}
