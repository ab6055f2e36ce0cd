"""The feed's data source: each line once, in ranges too, across a restart; filters choose files; errors raise."""

import json

import pytest

from tapeloom.operators import views
from tapeloom.sources import messages as M
from tapeloom.streaming import minutes


def put(folder, name, lines, end="\n"):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(("\n".join(lines) + end).encode())


def trade(i):
    return json.dumps({"e": "trade", "s": "A", "t": i, "p": str(i + 0.5)})


def test_ranges_give_each_line_once(spark, tmp_path):
    lines = [trade(i) + "x" * (i * 37 % 90) for i in range(200)]
    put(tmp_path, "0001", lines)
    put(tmp_path, "0002", ["", "ä" * 30, "last without end"], end="")
    put(tmp_path, "_hidden", ["no"])
    for size in (1, 7, 64, 1000, 1 << 20):
        if size == 1:  # one task a byte would be slow; ranges of a byte are cut and read here
            own = M._Segments({"path": str(tmp_path), "rangeBytes": "1"})
            got = [t for p in own.cut(own.listed()) for b in own.lines(p) for t in b.column("raw").to_pylist()]
        elif size == 7:
            own = M._Segments({"path": f"file://{tmp_path}", "rangeBytes": "7"})
            got = [t for p in own.cut(own.listed()) for b in own.lines(p) for t in b.column("raw").to_pylist()]
        else:
            got = [r.raw for r in M.messages(spark, str(tmp_path), rangeBytes=max(size, 1000)).orderBy("segment", "at").collect()]
        assert got == [*lines, "ä" * 30, "last without end"]


def test_places_are_first_bytes(spark, tmp_path):
    put(tmp_path, "s", ["ä", "", "bc", "d"])
    assert [(r.at, r.raw) for r in M.messages(spark, str(tmp_path)).orderBy("at").collect()] == [(0, "ä"), (4, "bc"), (7, "d")]


def test_empty_folder_and_empty_file(spark, tmp_path):
    assert M.messages(spark, str(tmp_path)).count() == 0
    put(tmp_path, "0001", [], end="")
    assert M.messages(spark, str(tmp_path)).count() == 0


def test_filters_choose_the_files(spark, tmp_path):
    for k in range(5):
        put(tmp_path, f"{k:04d}", [trade(k)])
    reader = M.FilteredReader({"path": str(tmp_path)})
    kept = list(reader.pushFilters([M.GreaterThanOrEqual(("segment",), "0002"), M.LessThan(("segment",), "0004"), M.EqualTo(("raw",), "x")]))
    assert kept == [M.EqualTo(("raw",), "x")]
    assert [p.segment for p in reader.partitions()] == ["0002", "0003"]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = M.messages(spark, str(tmp_path)).where("segment >= '0002' and segment < '0004' and raw like '%trade%'")
        assert sorted(r.segment for r in got.collect()) == ["0002", "0003"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def run(spark, tmp_path):
    found = M.without_errors(M.messages(spark, str(tmp_path / "in"), stream=True))
    minutes.run_to_end(views.parse_trades(found, ["A"]), str(tmp_path / "out"), str(tmp_path / "state"))
    return sorted(r.trade_id for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_restart_reads_each_message_once(spark, tmp_path):
    put(tmp_path / "in", "0001", [trade(1), "{broken", trade(2)])
    assert run(spark, tmp_path) == [1, 2]
    assert run(spark, tmp_path) == [1, 2]
    put(tmp_path / "in", "0002", [trade(3), '{"e": "ping"}', "[1]"])
    put(tmp_path / "in", "0003/part", [trade(4)])
    assert run(spark, tmp_path) == [1, 2, 3, 4]


def test_an_error_message_raises(spark, tmp_path):
    put(tmp_path / "in", "0001", [trade(1)])
    assert run(spark, tmp_path) == [1]
    put(tmp_path / "in", "0002", ['{"error": "no such market"}'])
    with pytest.raises(Exception, match="no such market"):
        run(spark, tmp_path)
