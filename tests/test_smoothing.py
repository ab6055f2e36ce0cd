"""Means that run over many chunks of one series, against one loop over all of it."""

import math
import random

import pytest

from tapeloom.operators import indicators


def plain(values, length, keep, add, divide):
    out, state = [], None
    for i, v in enumerate(values):
        if i >= length:
            state = (state * keep + v * add) / divide
        elif i == length - 1:
            state = sum(values[:length]) / length
        out.append(state)
    return out


@pytest.mark.parametrize("length,chunk", [(14, 5), (14, 1024), (3, 7), (40, 16), (500, 8)])
def test_chunks_give_what_one_loop_gives(spark, length, chunk):
    rng = random.Random(length)
    series = {"a": [rng.random() * 100 for _ in range(300)], "b": [rng.random() for _ in range(13)], "c": [1.0]}
    rows = spark.createDataFrame([(s, i, v, "x") for s, values in series.items() for i, v in enumerate(values)], "symbol string, idx long, v double, other string")
    got = indicators.smoothed(rows.repartition(5), "v", "mean", length, length - 1, 1.0, length, chunk)
    assert got.columns == ["symbol", "idx", "v", "other", "mean"]
    found = {(r.symbol, r.idx): r.mean for r in got.collect()}
    for s, values in series.items():
        for i, expected in enumerate(plain(values, length, length - 1, 1.0, length)):
            mean = found.pop((s, i))
            assert (mean is None or math.isnan(mean)) if expected is None else math.isclose(mean, expected, rel_tol=1e-12)
    assert not found


def test_windows_and_last_values_over_many_chunks(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [(s, i, rng.random(), rng.randint(1, 9) if rng.random() < 0.1 else None) for s, n in (("a", 95), ("b", 3), ("c", 16)) for i in range(n)]
    bars = spark.createDataFrame(rows, "symbol string, idx long, high double, mark long")
    whole = Window.partitionBy("symbol").orderBy("idx")
    top = lambda w: {"top": F.max("high").over(w.rowsBetween(-3, 2)), "n": F.count("*").over(w.rowsBetween(-3, -1)), "back": F.lag("high", 3).over(w)}
    expected = sorted(map(tuple, bars.withColumns(top(whole)).collect()), key=repr)
    assert sorted(map(tuple, indicators.windowed(bars, top, before=3, after=2, chunk=8).collect()), key=repr) == expected
    last = F.last("mark", True).over(whole.rowsBetween(Window.unboundedPreceding, 0))
    expected = sorted(map(tuple, bars.withColumn("last", last).collect()), key=repr)
    assert sorted(map(tuple, indicators.running_last(bars, {"last": F.col("mark")}, chunk=8).collect()), key=repr) == expected
