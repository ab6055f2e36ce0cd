"""A healed store does not change any more, and a run that was cut off is completed by the next."""

import os

import pytest

from tapeloom.operators import heal as H
from tapeloom.plans import healing

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tables(spark, path):
    rows = {name: spark.read.parquet(f"{path}/{name}").collect() for name in ("trades", "minutes", "revisions", "repairs")}
    return {name: sorted((tuple(sorted(r.asDict().items())) for r in found), key=repr) for name, found in rows.items()}


def test_a_second_run_and_a_run_cut_off_end_alike(spark, monkeypatch):
    path, dropped, history = healing.stored(spark, SF_DIR)
    H.heal(spark, path, dropped, history)
    once = tables(spark, path)
    H.heal(spark, path, dropped, history)
    assert tables(spark, path) == once
    assert {dict(r)["action"] for r in once["revisions"]} >= {"INSERTED", "REVISED"}

    other, dropped, history = healing.stored(spark, SF_DIR)
    apply, calls = H._apply, []

    def fails(*args):
        calls.append(args)
        raise RuntimeError("cut off")

    monkeypatch.setattr(H, "_apply", fails)  # after the audit of the minutes, before these are written
    with pytest.raises(RuntimeError):
        H.heal(spark, other, dropped, history)
    assert len(calls) == 1
    monkeypatch.setattr(H, "_apply", apply)
    H.heal(spark, other, dropped, history)
    assert tables(spark, other) == once


def test_a_minute_of_second_records_only_is_withdrawn(spark):
    import datetime

    at = lambda m, s, us=0: datetime.datetime(2024, 1, 1 + m // 1440, m // 60 % 24, m % 60, s, us)
    schema = "symbol string, ts timestamp_ntz, trade_id long, px double, qty double, source string"
    rows = [("s", at(1, 59, 900_000), 1, 5.0, 1.0, "WS"), ("s", at(2, 0, 200_000), 2, 5.0, 1.0, "REST"), ("s", at(3, 0), 3, 6.0, 1.0, "REST")]
    trades = spark.createDataFrame(rows, schema)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/withdrawn-{os.getpid()}"
    H.create(trades, H.bars_of_trades(trades, "1m"), path)
    H.dedupe(spark, path, 1.0, 3.0)
    H.revise(spark, path, "TEST")
    assert {(r.trade_id, r.sources) for r in H.trades_of(spark, path).collect()} == {(1, None), (2, "DUPLICATE_OF:1"), (3, None)}
    assert {r.open_time.minute for r in H.minutes_of(spark, path).collect()} == {1, 3}
    assert [(r.action, r.revision, r.new) for r in spark.read.parquet(f"{path}/revisions").collect()] == [("WITHDRAWN", 1, None)]


def test_rows_of_one_day_stay_dealt_over_tasks(spark):
    import datetime

    start = datetime.datetime(2024, 1, 1)
    rows = [("s", start + datetime.timedelta(seconds=10 * i + k / 10), 2 * i + k, 5.0 + i, 1.0, ("WS", "REST")[k]) for i in range(400) for k in (0, 1)]
    trades = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, trade_id long, px double, qty double, source string").repartition(4)
    path = f"{spark.conf.get('spark.checkpoint.dir')}/dealt-{os.getpid()}"
    H.create(trades, H.bars_of_trades(trades, "1m"), path)
    held = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as where rows are too many for one task
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        H.dedupe(spark, path, 1.0, 3.0)
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    done = H.trades_of(spark, path)
    assert {(r.trade_id, r.sources) for r in done.collect()} == {(2 * i + k, f"DUPLICATE_OF:{2 * i}" if k else None) for i in range(400) for k in (0, 1)}
    assert len(done.inputFiles()) > 1
