"""Prices of 0 and runs of equal prices."""

import datetime

import compare

from tapeloom.plans import registry


def tables(spark, path, values):
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, i, at + datetime.timedelta(seconds=i), "click", v) for i, v in enumerate(values)]
    events = spark.createDataFrame([(*r, "{}") for r in rows], "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{path}/events.parquet")
    return compare.views(str(path))


def test_steps_to_a_price_of_nothing_equal_sql(spark, tmp_path):
    con = tables(spark, tmp_path, [-9950.0, 60.0, 40.0, 50.0, 70.0, 45.0])  # 0, 10, 0, 0, 20, 15
    mine, other = compare.both(spark, con, registry.QUERIES["vw_price_steps"], registry.ORACLE_SQL["vw_price_steps"], str(tmp_path))
    assert mine == other
    con = tables(spark, tmp_path / "nothing", [-9940.0, -60.0] + [60.0] * 400)  # 10, -100, -90 .. 0 ..
    mine, other = compare.both(spark, con, registry.QUERIES["vw_price_steps"], registry.ORACLE_SQL["vw_price_steps"], str(tmp_path / "nothing"))
    assert mine == other


def test_runs_of_prices_do_not_depend_on_the_order_of_equal_ones(spark, tmp_path):
    tables(spark, tmp_path, [-9850.0, 50.0, 51.0, 50.0, 49.0, 50.3])  # 100, 100, 101, 101, 100, 100.3
    got = registry.QUERIES["win_equal_levels"](spark, str(tmp_path)).collect()
    assert sorted((r.bottom, r.top, r.n) for r in got) == [(100.0, 100.3, 4), (101.0, 101.0, 2)]
