"""The trailing exit against a plain walk over each trade's bars."""

import random

from tapeloom.operators.simulate import trailing


def walked(trade, bars, hold, atrs):
    _, symbol, side, start, stop = trade
    rows = [b for b in bars if b[0] == symbol and start <= b[1] <= start + hold]
    level = side * stop
    for _, idx, high, low, close, _ in rows:
        if (low if side == 1 else -high) <= level:
            return idx, "TRAIL", side * level
        if idx == start + hold:
            return idx, "TIME", close
        level = max(level, (high if side == 1 else -low) - atrs * rows[0][5])
    return None, "OPEN", None


def test_trailing_equals_a_plain_walk(spark):
    rnd = random.Random(5)
    bars = []
    for symbol in ("a", "b"):
        price = 100.0
        for idx in range(150):
            close = price + rnd.randint(-20, 20) / 8
            bars.append((symbol, idx, max(price, close) + 0.5, min(price, close) - 0.5, close, 2.0))
            price = close
    trades = []
    for k in range(60):
        symbol, side, start = rnd.choice("ab"), rnd.choice((1, -1)), rnd.randint(0, 149)
        close = next(b[4] for b in bars if b[0] == symbol and b[1] == start)
        trades.append((f"t{k}", symbol, side, start, close - side * rnd.choice((1.0, 4.0, 9.0))))
    b = spark.createDataFrame(bars, "symbol string, idx long, high double, low double, close double, atr double")
    t = spark.createDataFrame(trades, "id string, symbol string, dir int, filled_idx long, stop double")
    got = {r.id: (r.exit_idx, r.rule, r.price) for r in trailing(t, b, 20, 3.0).collect()}
    assert got == {x[0]: walked(x, bars, 20, 3.0) for x in trades}
    assert {v[1] for v in got.values()} == {"TRAIL", "TIME", "OPEN"}
