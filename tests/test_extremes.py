"""Range extremes by runs of doubling blocks, against a plain scan."""

import random

import pytest

from tapeloom.operators import views


@pytest.mark.parametrize("block", [4, 64])
def test_range_extremes_of_spans_of_any_length(spark, block):
    rng = random.Random(block)
    bars = [(s, i, rng.random() + 1, rng.random()) for s, n in (("a", 700), ("b", 9), ("c", 1)) for i in range(n)]
    spans = [(f"{k}", s, lo, lo + rng.choice([0, 1, 3, 8, 50, 333, 700])) for k in range(120) for s, lo in [(rng.choice("abc"), rng.randrange(0, 700))]]
    spans += [("backwards", "a", 5, 3), ("outside", "b", 50, 60)]
    frame = spark.createDataFrame(spans, "id string, symbol string, lo long, hi long")
    got = views.range_extremes(frame, spark.createDataFrame(bars, "symbol string, idx long, high double, low double"), block)
    expected = {}
    for name, s, lo, hi in spans:
        own = [(h, low) for t, i, h, low in bars if t == s and lo <= i <= hi]
        if own:
            expected[name] = max(h for h, _ in own), min(low for _, low in own)
    assert {r.id: (r.high, r.low) for r in got.collect()} == expected
    one = views.range_extremes(frame.where("false"), spark.createDataFrame(bars, "symbol string, idx long, high double, low double"), block)
    assert one.count() == 0
