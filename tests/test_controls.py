"""Nearest controls against all distances, with ties, repeated values, hot keys and rows that take no part."""

import math
import random

import pytest

from tapeloom.operators import controls


def plain(events, pool, n):
    fine = lambda r: all(v is not None and math.isfinite(v) for v in r[2:])
    out = set()
    for e in filter(fine, events):
        near = sorted(((e[2] - p[2]) * (e[2] - p[2]) + (e[3] - p[3]) * (e[3] - p[3]), p[0]) for p in filter(fine, pool) if p[1] == e[1])
        out |= {(e[0], k + 1, i, d) for k, (d, i) in enumerate(near[:n])}
    return out


@pytest.mark.parametrize("per_cell", [2, 8, 64])
def test_nearest_controls_equal_all_distances(spark, per_cell):
    r = random.Random(per_cell)
    draw = {
        "hot": lambda: (r.gauss(0, 1), r.expovariate(1)),
        "grid": lambda: (float(r.randrange(4)), float(r.randrange(3))),
        "one": lambda: (1.5, 2.5),
        "few": lambda: (r.random(), 1.0),
    }
    rows = lambda first, sizes: [(first + i, k, *draw[k]()) for i, k in enumerate(k for k, c in sizes.items() for _ in range(c))]
    pool = rows(0, {"hot": 900, "grid": 300, "one": 200, "few": 3}) + [(5000, "hot", None, 1.0), (5001, "hot", math.nan, 1.0), (5002, "hot", math.inf, 0.0)]
    events = rows(10000, {"hot": 60, "grid": 30, "one": 20, "few": 2}) + [(20000, "hot", 50.0, -50.0), (20001, "hot", None, 0.0), (20002, "hot", 0.0, math.nan)]
    schema = "{} long, symbol string, x double, y double"
    got = controls.nearest_controls(
        spark.createDataFrame(events, schema.format("event_id")), spark.createDataFrame(pool, schema.format("control_id")), "symbol", 5, per_cell
    )
    assert {tuple(x) for x in got.collect()} == plain(events, pool, 5)
    assert got.count() == len(plain(events, pool, 5))


def test_no_pool_and_no_events(spark):
    empty = lambda name: spark.createDataFrame([], f"{name} long, symbol string, x double, y double")
    one = spark.createDataFrame([(1, "a", 1.0, 1.0)], "event_id long, symbol string, x double, y double")
    assert controls.nearest_controls(one, empty("control_id"), "symbol", 5).count() == 0
    assert controls.nearest_controls(empty("event_id"), one.withColumnRenamed("event_id", "control_id"), "symbol", 5).count() == 0
