"""Hierarchical best-fit packing of documents into sequences of bounded length.

Documents become pieces of at most ``capacity`` tokens.  They are dealt evenly by a hash, over as
many partitions as their number and tokens ask for, so neither the order of the input nor its files
matter.  Every partition packs its own pieces by best fit, largest first, and emits the bins that
are nearly full.  All other bins go on as single items to fewer partitions, as many as their number
asks for, are packed again, and so on up a tree, until one partition holds them or a round leaves
nearly as many as it was given; these are emitted as they are.

Cases: a null text counts as empty and holds only the end id; without an end id an empty document
gives no piece; an empty table gives no rows; repeated rows are packed as often as they occur;
other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.shared import byte_slices, durable, give_back
from tapeloom.llm.tokenize import SLICE_BYTES, encoder

CAPACITY, FAN_IN, SLACK = 1024, 8, 0.01
#: Tokens and pieces of a partition of the first round, about.
PART_TOKENS, PART_PIECES = 4_000_000, 50_000
#: A round that leaves more than this share of its bins is the last.
IDLE = 0.9
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>"


def pieces_of(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of every document; only a document's first piece may be shorter than capacity when
    the document is longer than that. with_ids adds the ids themselves."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([] if end_id is None else [end_id], np.uint32)
        for part in byte_slices(batches, "text", SLICE_BYTES):
            ids, offsets = enc.encode(part.column("text"))
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for i, name in enumerate(part.column("doc_id").to_pylist()):
                own = np.concatenate((ids[offsets[i] : offsets[i + 1]], end)).astype("<u4")
                cuts = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)] if len(own) else [0]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row = (name, k, a, b - a, zlib.crc32(own[a:b].tobytes()), own[a:b] if with_ids else None)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
            if not with_ids:
                del out["ids"]
            yield pa.RecordBatch.from_pydict(out, schema=arrow_pieces if not with_ids else arrow_with_ids)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, PIECE_SCHEMA + (", ids array<long>" if with_ids else ""))


arrow_pieces = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
        ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ]
)
arrow_with_ids = arrow_pieces.append(pa.field("ids", pa.list_(pa.int64())))


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item by best fit, largest item first (ties: the earlier item)."""
    bins = np.empty(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    roomy = n = 0  # bit r of roomy: some bin has room r
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = roomy >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = open_bins[room].pop()
            if not open_bins[room]:
                roomy &= ~(1 << room)
        else:
            room, bin_, n = capacity, n, n + 1
        bins[item] = bin_
        if left := room - size:
            open_bins[left].append(bin_)
            roomy |= 1 << left
    return bins


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int | None = 2,
    capacity: int = CAPACITY,
    fan_in: int = FAN_IN,
    slack: float = SLACK,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    pieces = durable(pieces_of(docs, tokenizer, end_id, capacity), "pieces")
    return pack_pieces(pieces, capacity, fan_in, slack)


def pack_pieces(pieces: DataFrame, capacity: int, fan_in: int = FAN_IN, slack: float = SLACK) -> DataFrame:
    """As pack(), for pieces that lie in a durable table."""
    nearly = capacity - int(capacity * slack)
    schema = f"done boolean, size long, members array<{MEMBER}>, offsets array<long>"

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = [x for x in frames if len(x)]
        if not items:
            return
        items = pd.concat(items, ignore_index=True)
        items["bin"] = best_fit(items["size"].to_numpy(), capacity)
        made = items.groupby("bin", sort=False).agg(size=("size", "sum"), members=("members", list))
        made["members"] = [[m for part in parts for m in part] for parts in made["members"]]
        made["done"] = made["size"] >= nearly
        made["offsets"] = [[0, *accumulate(m["length"] for m in bin_[:-1])] for bin_ in made["members"]]
        for i in range(0, len(made), 4096):
            yield made.iloc[i : i + 4096][["done", "size", "members", "offsets"]]
        del items, made
        give_back()

    member = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    full = pieces.where(F.col("length") == capacity).select(
        F.array(member).alias("members"), F.array(F.lit(0).cast("long")).alias("offsets")
    )
    short = pieces.where(F.col("length") < capacity)
    total = short.agg(F.sum("length").alias("tokens"), F.count("*").alias("n")).first()
    parts = max(1, -(-(total["tokens"] or 0) // PART_TOKENS), -(-total["n"] // PART_PIECES))
    # equal pieces are counted and numbered, so they are dealt evenly too
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = short.groupBy(*names).agg(F.count("*").alias("n")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    dealt = numbered.select(*names, F.xxhash64(*names, "copy").alias("deal")).repartition(parts, "deal")
    items = dealt.sortWithinPartitions(F.desc("length"), "deal").select(
        F.lit(False).alias("done"), F.col("length").alias("size"), F.array(member).alias("members")
    )
    finished = full
    number, given = 0, total["n"]
    while True:
        bins = durable(items.mapInPandas(fill, schema), f"bins{number}")
        waiting = bins.where("not done").count()
        if parts == 1 or waiting > IDLE * given:
            finished = finished.unionByName(bins.select("members", "offsets"))
            break
        finished = finished.unionByName(bins.where("done").select("members", "offsets"))
        number, given = number + 1, waiting
        parts = max(1, min(parts - 1, max(-(-parts // fan_in), -(-waiting // PART_PIECES))))
        items = bins.where("not done").select("done", "size", "members").repartition(parts)
    return (
        finished.withColumn("sequence_id", F.monotonically_increasing_id())
        .select("sequence_id", F.explode(F.arrays_zip("members", "offsets")).alias("p"))
        .select("p.members.*", "sequence_id", F.col("p.offsets").alias("offset"))
    )


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, end_id: int | None = 2, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; one has at most capacity ids."""
    ids = pieces_of(docs, tokenizer, end_id, capacity, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids")
    parts = packed.join(ids.dropDuplicates(["doc_id", "piece", "ids_crc32"]), ["doc_id", "piece", "ids_crc32"])
    return (
        parts.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
    )
