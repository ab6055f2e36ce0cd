"""Removal of line chunks that repeat across the corpus.

A text's lines are cut into chunks where a rolling hash over the last two lines' hashes says so,
so a chunk starts and ends alike wherever its lines occur.  A line of ``long_line`` words or more is
a chunk by itself.  Besides, each line with words begins and ends a window: the fewest such lines
from it on, or up to it, that have ``long_line`` words; blank lines between them do not count.  All
windows of a repeated passage of that many words are equal wherever it occurs, and together they
cover it, whatever its lines and neighbours are.  Chunks of several lines, long lines, and windows
that occur more than once are removed but for the first occurrence (least doc_id, then least place).
They are looked for by 64 bits, and then compared byte by byte: of different texts that share the
64 bits, each has its own first occurrence.

As windows overlap, their bytes would be many times the text.  So a unit is written line by line: a
short line as it is, one of NAMED bytes or more by a 64-bit name.  Spark compares the bytes of all
lines of a name, and a line whose name another line has too is written in full instead.  Units that
are written alike thus have the same bytes, with no trust in any hash.  A line adds two windows, each
of at most long_line lines of NAMED bytes, so a text's units grow with its lines, however many of
these are blank or short; they are given out in pieces.

Cases: a null text stays null; an empty one stays empty; chunks of blank lines are never removed;
rows of equal doc_id and text are one document, and keep the same text; a null doc_id sorts first;
an empty table gives no rows; all columns of docs are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.shared import byte_slices, durable, give_back

#: One boundary in DIVISOR lines; lines a chunk has at least and at most; words of a long line.
DIVISOR, LEAST, MOST, LONG_LINE = 2, 2, 16, 50
#: Bytes from which a line is written by its name, and bits of a name.
NAMED, NAME_BITS = 9, 64
SLICE_BYTES = 1 << 20
#: Units that are given out at once, and their bytes.
UNITS_TOGETHER, UNIT_BYTES = 20_000, 8 << 20
#: Repeated hashes that may be broadcast; beyond it that join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Tasks that share the occurrences of one unit.
SALTS = 8


def chunks_of(text: str, divisor: int = DIVISOR, least: int = LEAST, most: int = MOST, long_line: int = LONG_LINE) -> list[tuple[int, int, bool]]:
    """(first line, line after the last, may be removed) of each chunk of a text."""
    lines = text.split("\n")
    out = []
    start, before = 0, 0
    for i, line in enumerate(lines):
        own = xxhash.xxh3_64_intdigest(line)
        if len(line) >= 2 * long_line - 1 and len(line.split()) >= long_line:
            if start < i:
                out.append((start, i, i - start > 1))
            out.append((i, i + 1, True))
            start = i + 1
        else:
            rolled = (before * 0x9E3779B97F4A7C15 + own) & 0xFFFFFFFFFFFFFFFF
            size = i + 1 - start
            if size >= most or (size >= least and (rolled >> 32) % divisor == 0):
                out.append((start, i + 1, size > 1))
                start = i + 1
        before = own
    if start < len(lines):
        out.append((start, len(lines), len(lines) - start > 1))
    return out


def units_of(text: str, spelled: Iterable[int] = (), name_bits: int = NAME_BITS, **options: int) -> tuple[list[str], list[tuple[int, int, bytes]]]:
    """The lines of a text, and (first line, line after the last, how it is written) of all chunks and
    windows that may be removed.  A window is made of lines that have words; blank ones between do not
    count.  Lines whose names are in spelled are written in full."""
    lines = text.split("\n")
    return lines, list(_units(lines, text, spelled, name_bits, options))


def _units(lines: list[str], text: str, spelled: Iterable[int], name_bits: int, options: dict) -> Iterator[tuple[int, int, bytes]]:
    """The units of units_of() in order, written one after the other."""
    long_line = options.get("long_line", LONG_LINE)
    counts = [len(line.split()) for line in lines]
    worded = [i for i, n in enumerate(counts) if n]
    words = [0, *accumulate(counts[i] for i in worded)]
    before = [0, *accumulate(n > 0 for n in counts)]  # lines with words before each line
    # a chunk has its blank lines; if it has none, it is the same unit as a window of its lines
    spans = {(a, b, before[b] - before[a] < b - a) for a, b, may in chunks_of(text, **options) if may and before[b] > before[a]}
    start = end = 0
    for k in range(len(worded)):
        while end < len(worded) and words[end] - words[k] < long_line:
            end += 1
        if words[end] - words[k] >= long_line:
            spans.add((worded[k], worded[end - 1] + 1, False))
        while words[k + 1] - words[start + 1] >= long_line:
            start += 1
        if words[k + 1] - words[start] >= long_line:
            spans.add((worded[start], worded[k] + 1, False))
    written = [_written(line, spelled, name_bits) for line in lines]
    own = [written[i] for i in worded]
    for a, b, blank in sorted(spans):
        yield a, b, b"".join(written[a:b] if blank else own[before[a] : before[b]])


def name_of(line: bytes, bits: int = NAME_BITS) -> int:
    """The name of a line, the same as _named() gives it."""
    return int.from_bytes(xxhash.xxh64_digest(line, seed=42), "big", signed=True) & _mask(bits)


def _mask(bits: int) -> int:
    return -1 if bits == 64 else (1 << bits) - 1


def _written(line: str, spelled: Iterable[int], bits: int) -> bytes:
    """A line in a unit: its bytes up to a line feed, or a byte that no text has and the line's name."""
    data = line.encode()
    if len(data) < NAMED or (name := name_of(data, bits)) in spelled:
        return data + b"\n"
    return b"\xff" + name.to_bytes(8, "big", signed=True)


def _named(keyed: DataFrame, bits: int) -> DataFrame:
    """keyed's columns but the text, name, line: the lines that units write by their names."""
    lines = keyed.select(*(c for c in keyed.columns if c != "text"), F.explode(F.split("text", "\n")).alias("line")).where(F.octet_length("line") >= NAMED)
    return lines.withColumn("name", F.xxhash64("line").bitwiseAND(F.lit(_mask(bits))))


def shared_names(texts: DataFrame, bits: int = NAME_BITS) -> DataFrame:
    """name: the names that lines of different bytes share.  All lines of a name are compared."""
    different = _named(texts.select("text"), bits).select("name", "line").distinct()
    return different.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")


def _with_spelled(keyed: DataFrame, bits: int) -> DataFrame:
    """keyed with the names that its text's lines share with other lines (null: none)."""
    shared = durable(shared_names(keyed, bits), "shared")
    if shared.isEmpty():
        return keyed.withColumn("spelled", F.lit(None).cast("array<long>"))
    own = _named(keyed, bits).join(_small(shared), "name").groupBy("did", "row_key").agg(F.collect_set("name").alias("spelled"))
    return keyed.join(own, ["did", "row_key"], "left")


def _unit_rows(keyed: DataFrame, options: dict, bits: int) -> DataFrame:
    """did, row_key, a, b (lines of a unit), hash, rest (how the unit is written, which stands for its bytes)."""
    names = ["did", "row_key", "a", "b", "hash", "rest"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: list, units: list) -> pa.RecordBatch:
            hashes = np.array([xxhash.xxh3_64_intdigest(u[2]) for u in units], np.uint64).view(np.int64)
            columns = [[i for i, _ in ids], [k for _, k in ids], [u[0] for u in units], [u[1] for u in units], hashes, [u[2] for u in units]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        for part in byte_slices(batches, "text", SLICE_BYTES):
            ids, units, size = [], [], 0
            for did, key, text, spelled in zip(*(part.column(c).to_pylist() for c in ("did", "row_key", "text", "spelled")), strict=True):
                for unit in _units((text or "").split("\n"), text or "", frozenset(spelled or ()), bits, options):
                    ids.append((did, key))
                    units.append(unit)
                    size += len(unit[2])
                    if len(units) >= UNITS_TOGETHER or size >= UNIT_BYTES:
                        yield out(ids, units)
                        ids, units, size = [], [], 0
            if units:
                yield out(ids, units)

    return keyed.mapInArrow(rows, "did long, row_key long, a int, b int, hash long, rest binary")


def _small(hashes: DataFrame) -> DataFrame:
    return F.broadcast(hashes) if hashes.count() <= BROADCAST_ROWS else hashes


def _gone(units: DataFrame) -> DataFrame:
    """did, row_key, gone: the line spans of a document whose units occur earlier."""
    often = durable(units.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "often")
    again = durable(units.join(_small(often), "hash"), "again")
    place = F.struct("did", "row_key", "a", "b")
    equal = again.groupBy("hash", "rest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    equal = durable(equal.select("hash", "rest", "first"), "equal")
    # a unit that very many documents have is spread over SALTS tasks
    salted = equal.withColumn("salt", F.explode(F.array(*(F.lit(i) for i in range(SALTS)))))
    spread = again.withColumn("salt", F.pmod(F.xxhash64("did", "row_key"), F.lit(SALTS)).cast("int"))
    own = (F.col("did") == F.col("first.did")) & (F.col("row_key") == F.col("first.row_key"))
    begin = F.when(own, F.greatest("a", "first.b")).otherwise(F.col("a"))  # a window may overlap its first occurrence
    return (
        spread.join(salted, ["hash", "rest", "salt"])
        .where(place != F.col("first"))
        .select("did", "row_key", begin.alias("a"), "b")
        .where("a < b")
        .groupBy("did", "row_key")
        .agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    )


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR, least: int = LEAST, most: int = MOST, long_line: int = LONG_LINE, name_bits: int = NAME_BITS) -> DataFrame:
    """docs with text replaced, and two more columns: chunks_removed (runs of neighbouring lines)
    and lines_removed.  The result is the same for any name_bits; few make lines share names."""
    options = {"divisor": divisor, "least": least, "most": most, "long_line": long_line}
    wrapped = docs.select(
        F.struct("*").alias("doc"),
        F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("did"),
        F.xxhash64(docs["doc_id"].cast("long"), docs["text"]).alias("row_key"),
        docs["text"].cast("string").alias("text"),
    )
    units = durable(_unit_rows(_with_spelled(wrapped.select("did", "row_key", "text"), name_bits), options, name_bits), "units")
    removed = _gone(units)

    @F.pandas_udf("text string, chunks int, lines int")
    def without(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, gone, strict=True):
            if text is None or spans is None or not len(spans):
                out.append((text, 0, 0))
                continue
            lines = text.split("\n")
            leaves = {i for span in spans for i in range(span["a"], span["b"])}
            kept = [line for i, line in enumerate(lines) if i not in leaves]
            out.append(("\n".join(kept), sum(i - 1 not in leaves for i in leaves), len(leaves)))
        give_back()
        return pd.DataFrame(out, columns=["text", "chunks", "lines"])

    cleaned = wrapped.drop("text").join(removed, ["did", "row_key"], "left").withColumn("new", without("doc.text", "gone"))
    columns = [F.col("new.text").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return cleaned.select(*columns, F.col("new.chunks").alias("chunks_removed"), F.col("new.lines").alias("lines_removed"))
