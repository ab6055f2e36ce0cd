"""Removal of word windows that already occur in a document of smaller doc_id.

A window is ``width`` consecutive words of one document.  Texts are dealt into blocks of bounded
size, which stay fixed in a table bucketed by block.  Then come three passes over the blocks:

1. Every block emits its part of a count-min sketch: the cells that its distinct windows fall in,
   a row for each shard of the sketch.  A shard's rows are merged, which gives upper bounds of the
   number of blocks that hold a window; each block gets back one bit a cell: met elsewhere or not.
2. Windows whose cell was met elsewhere go, with the least doc_id of their block, to the shard of
   their hash, where equal ones (96 bits) are grouped exactly; each block gets back one bit a
   window: a smaller doc_id has it or not.  A window that no other block's cell shares occurs in
   no other block, so none is lost.
3. Blocks remove the words that such windows cover, and those of windows that a smaller doc_id of
   the same block has.

The sketch has CELLS cells for each window, whatever the size of the corpus; it is never gathered:
a task merges one shard, of some two million windows, at a time.  A window counts once a block, so
one that is in a third of all documents is a row's entry for each block, not for each document.

Cases: null and empty texts have no words; a text of fewer than width words has no window; rows of
equal doc_id never remove from each other; a row without doc_id neither removes nor loses words;
an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tapeloom.llm.hashing import BYTE_CODES, mix, run_hashes
from tapeloom.llm.shared import bounded_batches, byte_slices, discard, durable, durable_path, give_back, whole_groups
from tapeloom.llm.shingles import _SPACES, buffers

WIDTH = 13
#: Bytes of text of a block, about; a longer text is a block by itself.
BLOCK_BYTES = 6 << 20
#: Cells of the sketch for each window; the bits of a cell's place in its shard.
CELLS, SHARD_BITS = 8, 24
_MIN_WORD_BYTES = 6  # bytes a word takes with its space, about; only the sketch's size depends on it
_CHECK_CODES = np.random.default_rng(20240102).integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = [[np.uint64(pow(base, k + 1, 2**64)) for k in range(256)] for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, where words start and end in them, and the words' offsets by text."""
    data, offsets = buffers(texts)
    blank = _SPACES[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = ~blank
    starts[1:] &= blank[:-1] | first[1:-1]
    ends = ~blank
    ends[:-1] &= blank[1:] | first[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return data, starts, ends, np.searchsorted(starts, offsets)


class Windows:
    """The windows of a block's texts: their hashes, 32 more bits, and the documents they are in."""

    def __init__(self, texts: pa.ChunkedArray, dids: pa.ChunkedArray, width: int):
        texts = texts.cast(pa.large_string()).combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
        known = pc.is_valid(dids).to_numpy(zero_copy_only=False) if len(dids) else np.zeros(0, bool)
        dids = pc.fill_null(dids, 0).to_numpy() if len(dids) else np.zeros(0, np.int64)
        data, starts, ends, self.offsets = _words(texts)
        n = max(0, len(starts) - width + 1)
        inside = np.zeros(len(starts) + 1, np.int32)
        lengths = np.diff(self.offsets)
        may = np.flatnonzero((lengths >= width) & known)
        np.add.at(inside, self.offsets[may], 1)
        np.add.at(inside, self.offsets[may + 1] - width + 1, -1)
        #: Words (of the block, from 0) where windows begin.
        self.at = np.flatnonzero(np.cumsum(inside)[:n])
        hashes = []
        for codes, terms in zip((BYTE_CODES, _CHECK_CODES), _TERMS, strict=True):
            words = run_hashes(data, starts, ends, codes)
            sums = np.zeros(n, np.uint64)
            for k in range(width):
                sums += words[k : n + k] * terms[k % 256]
            hashes.append(mix(sums[self.at]))
        self.hash, self.check = hashes[0], (hashes[1] >> np.uint64(32)).astype(np.uint32)
        self.did = np.repeat(dids, lengths)[self.at]
        self.words = len(starts)
        order = np.argsort(self.hash, kind="stable")
        h, c = self.hash[order], self.check[order]
        if ((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any():
            order = np.lexsort((self.check, self.hash))
            h, c = self.hash[order], self.check[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        begins = np.flatnonzero(new)
        #: The distinct windows, sorted, each with its least document.
        self.distinct, self.distinct_check = h[begins], c[begins]
        self.least = np.minimum.reduceat(self.did[order], begins) if len(begins) else self.did[:0]
        #: The distinct window of each window.
        self.code = np.empty(len(h), np.int64)
        self.code[order] = np.cumsum(new) - 1

    def cells(self, shards: int) -> np.ndarray:
        """The sketch's cell (shard << SHARD_BITS | place) of each distinct window, ascending."""
        return ((self.distinct >> np.uint64(24)) * np.uint64(shards) >> np.uint64(40 - SHARD_BITS)).astype(np.int64)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.concatenate((np.flatnonzero(np.diff(values, prepend=values[0] - 1)), [len(values)])) if len(values) else np.zeros(1, np.int64)


def _binaries(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """values[cuts[i]:cuts[i + 1]] as one binary each."""
    raw = np.ascontiguousarray(values)
    offsets = (cuts * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


_SKIP = 0xFFFF


def _steps(places: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Ascending places[cuts[i]:cuts[i + 1]] as one binary each: 16-bit steps; _SKIP only moves on."""
    gaps = np.diff(places, prepend=0)
    gaps[cuts[:-1]] = places[cuts[:-1]]
    skips, rest = np.divmod(gaps, _SKIP)
    ends = np.cumsum(skips + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, _SKIP, np.uint16)
    out[ends - 1] = rest
    return _binaries(out, np.concatenate(([0], ends))[cuts])


def _places(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of _steps: all places, and how many each binary holds."""
    steps, sizes = _flat(column, np.uint16)
    total = np.cumsum(steps, dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    total -= np.repeat(np.concatenate(([0], total))[begins], sizes)
    real = steps != _SKIP
    return total[real], np.add.reduceat(real, begins, dtype=np.int64) if len(begins) else sizes


def _flat(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values that the binaries of a column hold, and how many each holds."""
    sizes = pc.binary_length(column).to_numpy() // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind), sizes


def _bit_rows(bits: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """bits, of which a row has sizes[i], as one binary a row, each padded to whole bytes."""
    room = -(-sizes // 8)
    ends = np.cumsum(room)
    padded = np.zeros(8 * int(room.sum()), np.uint8)
    padded[np.arange(len(bits)) + np.repeat(8 * (ends - room) - (np.cumsum(sizes) - sizes), sizes)] = bits
    return _binaries(np.packbits(padded), np.concatenate(([0], ends)))


def _bits_of(rows: pa.Table, column: str, sizes: np.ndarray) -> np.ndarray:
    """The inverse of _bit_rows."""
    bits = np.unpackbits(np.frombuffer(b"".join(rows.column(column).to_pylist()), np.uint8))
    room = -(-sizes // 8)
    return bits[np.arange(int(sizes.sum())) + np.repeat(8 * (np.cumsum(room) - room) - (np.cumsum(sizes) - sizes), sizes)].astype(bool)


def _blocks(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int, str]:
    """docs as struct column doc beside did, text and block, in a table bucketed by block; the bytes
    of all texts; the table's name."""
    spark = docs.sparkSession
    wrapped = docs.select(F.struct("*").alias("doc"), docs["doc_id"].cast("long").alias("did"), docs["text"].cast("string").alias("text"))
    total = wrapped.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = uuid.uuid4().int >> 65, 0
        for part in byte_slices(batches, "text", 1 << 20):
            if filled >= block_bytes:
                block, filled = uuid.uuid4().int >> 65, 0
            filled += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            yield part.append_column("block", pa.array([block] * part.num_rows, pa.int64()))

    schema = StructType([*wrapped.schema.fields, StructField("block", LongType())])
    name = f"tapeloom_blocks_{uuid.uuid4().hex}"
    buckets = min(50_000, 1 + total // block_bytes)
    path = durable_path(spark, "blocks")
    wrapped.mapInArrow(cut, schema).write.option("compression", "zstd").option("path", path).bucketBy(buckets, "block").saveAsTable(name)
    table = spark.table(name)
    table._durable_path = path
    return table, total, name


def _sketch(texts: DataFrame, width: int, shards: int) -> DataFrame:
    """(shard, block, cells): the cells of a block's windows in each shard."""

    def own(table: pa.Table) -> pa.Table:
        windows = Windows(table.column("text"), table.column("did"), width)
        cells = windows.cells(shards)
        cells = cells[_runs(cells)[:-1]]
        cuts = _runs(cells >> SHARD_BITS)
        out = pa.table(
            {
                "shard": pa.array(cells[cuts[:-1]] >> SHARD_BITS, pa.int64()),
                "block": pa.array(np.full(len(cuts) - 1, table.column("block")[0].as_py(), np.int64)),
                "cells": _steps(cells & ((1 << SHARD_BITS) - 1), cuts),
            }
        )
        give_back()
        return out

    return texts.select("block", "did", "text").groupBy("block").applyInArrow(own, "shard long, block long, cells binary")


def _merged(rows: DataFrame, parts: int) -> DataFrame:
    """(block, kind, shard, bits): for each cell of a block, whether another block has it."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, "shard"):
            cells, sizes = _places(table.column("cells"))
            cells += np.repeat(table.column("shard").to_numpy(), sizes) << SHARD_BITS
            order = np.argsort(cells, kind="stable")
            cuts = _runs(cells[order])
            met = np.empty(len(cells), np.uint8)
            met[order] = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
            yield _reply(table, met, sizes, 1)

    sorted_rows = rows.repartition(parts, "shard").sortWithinPartitions("shard")
    return sorted_rows.mapInArrow(merge, "block long, kind int, shard long, bits binary")


def _reply(table: pa.Table, bits: np.ndarray, sizes: np.ndarray, kind: int) -> pa.RecordBatch:
    columns = {
        "block": table.column("block").combine_chunks(),
        "kind": pa.array(np.full(table.num_rows, kind, np.int32)),
        "shard": table.column("shard").combine_chunks(),
        "bits": _bit_rows(bits, sizes),
    }
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else x.chunk(0) for x in columns.values()], list(columns))


def _met(windows: Windows, replies: pa.Table, shards: int) -> np.ndarray:
    """Which distinct windows of a block have a cell that another block has too."""
    cells = windows.cells(shards)
    if not len(cells):
        return np.zeros(0, bool)
    runs = _runs(cells)
    own = cells[runs[:-1]]
    sizes = np.diff(_runs(own >> SHARD_BITS))
    rows = replies.filter(pc.equal(replies.column("kind"), 1)).sort_by("shard")
    return np.repeat(_bits_of(rows, "bits", sizes), np.diff(runs))


def _suspects(texts: DataFrame, replies: DataFrame, width: int, shards: int) -> DataFrame:
    """(shard, block, hashes, checks, dids): windows of a block that another block may have."""

    def own(table: pa.Table, answers: pa.Table) -> pa.Table:
        windows = Windows(table.column("text"), table.column("did"), width)
        met = _met(windows, answers, shards)
        hashes, checks, dids = (x[met] for x in (windows.distinct, windows.distinct_check, windows.least))
        of = (windows.cells(shards) >> SHARD_BITS)[met]
        cuts = _runs(of)
        out = pa.table(
            {
                "shard": pa.array(of[cuts[:-1]], pa.int64()),
                "block": pa.array(np.full(len(cuts) - 1, table.column("block")[0].as_py() if table.num_rows else 0, np.int64)),
                "hashes": _binaries(hashes, cuts),
                "checks": _binaries(checks, cuts),
                "dids": _binaries(dids, cuts),
            }
        )
        give_back()
        return out

    both = texts.select("block", "did", "text").groupBy("block").cogroup(replies.groupBy("block"))
    return both.applyInArrow(own, "shard long, block long, hashes binary, checks binary, dids binary")


def _grouped(rows: DataFrame, parts: int) -> DataFrame:
    """(block, kind, shard, bits): for each suspect of a block, whether a smaller doc_id has it."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, "shard"):
            hashes, sizes = _flat(table.column("hashes"), np.uint64)
            checks, dids = _flat(table.column("checks"), np.uint32)[0], _flat(table.column("dids"), np.int64)[0]
            order = np.lexsort((dids, checks, hashes))
            h, c, d = hashes[order], checks[order], dids[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
            smaller = np.empty(len(h), np.uint8)
            smaller[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1]
            yield _reply(table, smaller, sizes, 2)

    sorted_rows = rows.repartition(parts, "shard").sortWithinPartitions("shard")
    return sorted_rows.mapInArrow(group, "block long, kind int, shard long, bits binary")


def _removed(windows: Windows, replies: pa.Table, width: int, shards: int) -> np.ndarray:
    """Which words of a block go."""
    met = _met(windows, replies, shards)
    gone = np.zeros(len(met), bool)
    sizes = np.diff(_runs((windows.cells(shards) >> SHARD_BITS)[met]))
    rows = replies.filter(pc.equal(replies.column("kind"), 2)).sort_by("shard")
    gone[met] = _bits_of(rows, "bits", sizes) if len(sizes) else False
    leaves = windows.at[gone[windows.code] | (windows.did > windows.least[windows.code])]
    edges = np.zeros(windows.words + 1, np.int64)
    np.add.at(edges, leaves, 1)
    np.add.at(edges, leaves + width, -1)
    return np.cumsum(edges)[:-1] > 0


def dedup_substrings(docs: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with two more columns: n_words, n_removed; text has its kept words, joined by one space,
    and kept_sha256 their digest.  Where nothing was removed, text is as it was."""
    if not 0 < width <= 256:
        raise ValueError("width must be from 1 to 256")
    spark = docs.sparkSession
    bounded_batches(spark)
    texts, total, name = _blocks(docs, block_bytes)
    windows = max(1, total // _MIN_WORD_BYTES)
    shards = 1 + (CELLS * windows >> SHARD_BITS)
    parts = int(max(spark.conf.get("spark.sql.shuffle.partitions"), total // (64 << 20), key=int))
    met = durable(_merged(_sketch(texts, width, shards), parts), "met")
    repeated = durable(_grouped(_suspects(texts, met, width, shards), parts), "repeated")
    fields = docs.schema.fields
    schema = StructType([*(StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)), StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())])

    def clean(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Windows(table.column("text"), table.column("did"), width)
        stays = ~_removed(own, answers, width, shards)
        kept, counts, digests = [], [], []
        for text, a, b in zip(table.column("text").to_pylist(), own.offsets[:-1].tolist(), own.offsets[1:].tolist(), strict=True):
            parts_ = [] if text is None else text.encode().split()
            left = int(np.count_nonzero(stays[a:b]))
            joined = b" ".join(parts_ if left == b - a else compress(parts_, stays[a:b].tolist()))
            kept.append(text if left == b - a else joined.decode())
            counts.append((b - a, b - a - left))
            digests.append(hashlib.sha256(joined).hexdigest())
        doc = table.column("doc").combine_chunks()
        doc = doc if isinstance(doc, pa.Array) else pa.concat_arrays(doc.chunks)
        out = {f"c{i}": doc.field(i) for i in range(len(fields))}
        out |= {"kept": pa.array(kept, pa.string()), "n_words": pa.array([n for n, _ in counts], pa.int64()), "n_removed": pa.array([n for _, n in counts], pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        give_back()
        return pa.table(out)

    answers = met.unionByName(repeated)
    cleaned = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(clean, schema)
    own = [F.col("kept" if f.name == "text" else f"c{i}").alias(f.name) for i, f in enumerate(fields)]
    done = durable(cleaned.select(*own, F.col("n_words").alias("n_words"), F.col("n_removed"), F.col("kept_sha256")), "kept")
    spark.sql(f"DROP TABLE {name}")
    discard(texts, met, repeated)
    return done
