"""Line chunks are compared by their bytes: lines that share a name or a hash are told apart."""

from tapeloom.llm import linededup


def passage(name, n=4):
    return "\n".join(" ".join(f"{name}{k}word{i}" for i in range(15)) for k in range(n))


def test_names_are_the_same_in_spark_and_python(spark):
    lines = ["a line of text", "é ü 漢字 as bytes" * 9, "x" * 31, "y" * 32, "z" * 1000, " " * 12]
    for bits in (64, 5):
        found = {r.line: r.name for r in linededup._named(spark.createDataFrame([("\n".join([*lines, "short", ""]),)], "text string"), bits).collect()}
        assert found == {line: linededup.name_of(line.encode(), bits) for line in lines}


def test_lines_that_share_a_name_are_compared_by_their_bytes(spark):
    rows = [(i, f"own line number {i}\n{passage(f'p{i % 7}x')}\n\nlast line of {i}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n" * 50), (103, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert linededup.shared_names(docs).count() == 0
    assert {r.name for r in linededup.shared_names(docs, 1).collect()} == {0, 1}
    assert 0 < linededup.shared_names(docs, 8).count() < 256
    whole = sorted(map(tuple, linededup.dedup_lines(docs).collect()))
    assert sum(r[3] for r in whole) >= 33 * 4
    for i, text in rows[:40]:
        assert (passage(f"p{i % 7}x") in dict((r[0], r[1]) for r in whole)[i]) == (i < 7)
    for bits in (1, 8):
        assert sorted(map(tuple, linededup.dedup_lines(docs, name_bits=bits).collect())) == whole


def test_a_unit_is_written_by_all_its_lines():
    line = "a line of more than nine bytes"
    name = linededup.name_of(line.encode())
    text = "\n".join(["one", line, "", "two " * 60])
    units = dict(((a, b), w) for a, b, w in linededup.units_of(text)[1])
    assert units[3, 4] == b"\xff" + linededup.name_of(("two " * 60).encode()).to_bytes(8, "big", signed=True)
    named = b"\xff" + name.to_bytes(8, "big", signed=True)
    assert any(named in w for w in units.values()) and not any(line.encode() in w for w in units.values())
    full = dict(((a, b), w) for a, b, w in linededup.units_of(text, {name})[1])
    assert any(line.encode() + b"\n" in w for w in full.values()) and not any(named in w for w in full.values())
