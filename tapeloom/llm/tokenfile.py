"""Token files: ids of a corpus in fixed-width bit packing.

Every id takes the fewest bits that hold the vocabulary.  A file is a Parquet folder whose rows
are blocks of whole documents; a row has its documents' ids, where each ends in the block, and
the packed bits.  Blocks are found by their document range (Parquet statistics), and any run of
ids inside a block is unpacked from its own bytes, so reading one document touches one block.

Cases: a null text counts as empty and holds only the end id; a repeated doc_id keeps one entry
a row, in the order of its text; a null doc_id sorts first; an empty table makes an empty file;
one text longer than a block makes a block of its own; further columns of docs are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm.shared import byte_slices
from tapeloom.llm.tokenize import SLICE_BYTES, encoder

BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = (
    "shard int, block int, start_in_shard long, first_doc long, last_doc long, bits int, n_ids int, "
    "doc_ids array<long>, doc_ends array<int>, packed binary"
)
DOC_SCHEMA = "doc_id long, shard int, start_in_shard long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits in bits each, lowest bit first; eight ids fill bits bytes."""
    rows = -(-len(ids) // 8)
    eights = np.zeros(rows * 8, np.uint64)
    eights[: len(ids)] = ids
    eights = eights.reshape(rows, 8)
    out = np.zeros((rows, bits), np.uint8)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = eights[:, k] << np.uint64(shift)
        for t in range(-(-(shift + bits) // 8)):
            out[:, byte + t] |= (value >> np.uint64(8 * t)).astype(np.uint8)
    return out.tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(packed: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of a packed block, from the bytes that hold them."""
    first = start // 8
    rows = -(-stop // 8) - first
    part = packed[first * bits : (first + rows) * bits]
    eights = np.zeros(rows * bits, np.uint8)
    eights[: len(part)] = np.frombuffer(part, np.uint8)
    eights = eights.reshape(rows, bits).astype(np.uint64)
    out = np.empty((rows, 8), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(8):
        byte, shift = divmod(k * bits, 8)
        value = np.zeros(rows, np.uint64)
        for t in range(-(-(shift + bits) // 8)):
            value |= eights[:, byte + t] << np.uint64(8 * t)
        out[:, k] = (value >> np.uint64(shift)) & mask
    return out.reshape(-1)[start - first * 8 : stop - first * 8]


def write_token_file(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = 1,
    block_ids: int = BLOCK_IDS,
    shards: int | None = None,
) -> None:
    """Encode every text of docs (doc_id, text) in ascending doc_id order into a token file.

    docs is dealt to shards by ranges of doc_id, so shard after shard the file is in order.
    tokenizer is a file that all executors can open.
    """
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        bits = bits_for(max(enc.tokenizer.get_vocab_size(), (end_id or 0) + 1))
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number, start, held, names, size
            ends = np.cumsum([len(x) for x in held])
            known = [n for n in names if n is not None]
            row = {
                "shard": shard, "block": number, "start_in_shard": start, "bits": bits, "n_ids": size,
                "first_doc": min(known, default=None), "last_doc": max(known, default=None),
                "doc_ids": names, "doc_ends": ends.tolist(), "packed": pack_bits(np.concatenate(held), bits),
            }
            number, start, held, names, size = number + 1, start + size, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=arrow_blocks)

        end = np.array([] if end_id is None else [end_id], np.uint32)
        for part in byte_slices(batches, "text", SLICE_BYTES):
            ids, offsets = enc.encode(part.column("text"))
            for i, name in enumerate(part.column("doc_id").to_pylist()):
                own = np.concatenate((ids[offsets[i] : offsets[i + 1]], end))
                if size and size + len(own) > block_ids:
                    yield block()
                held.append(own)
                names.append(name)
                size += len(own)
        if names:
            yield block()

    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(shards, "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(blocks, BLOCK_SCHEMA)
        .write.option("compression", "zstd")
        .parquet(path)
    )


arrow_blocks = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("start_in_shard", pa.int64()),
        ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("bits", pa.int32()), ("n_ids", pa.int32()),
        ("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int32())), ("packed", pa.binary()),
    ]
)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def _each_document(block: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """doc_id, place in the block and ids of each document of a block."""
    ids = unpack_bits(block["packed"], block["bits"], 0, block["n_ids"])
    begin = 0
    for name, end in zip(block["doc_ids"], block["doc_ends"], strict=True):
        yield name, begin, ids[begin:end]
        begin = end


def read_documents(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of all documents or of some, whose blocks alone are read."""
    blocks = read_blocks(spark, path)
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        hit = F.lit(False)
        for name in sorted(wanted):
            hit |= (F.col("first_doc") <= name) & (F.col("last_doc") >= name)
        blocks = blocks.where(hit)

    def documents(batches):
        for batch in batches:
            rows = []
            for block in batch.to_pylist():
                begin = 0
                for name, end in zip(block["doc_ids"], block["doc_ends"], strict=True):
                    if wanted is None or name in wanted:
                        ids = unpack_bits(block["packed"], block["bits"], begin, end)
                        rows.append({"doc_id": name, "ids": ids.tolist()})
                    begin = end
            yield pa.RecordBatch.from_pylist(
                rows, schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
            )

    return blocks.mapInArrow(documents, "doc_id long, ids array<long>")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Read a token file back: doc_id, start (ids before it), n_tokens, ids_crc32.

    Only the number of ids of each shard is gathered to place the shards after each other; that
    table has one row a shard.
    """
    blocks = read_blocks(spark, path)

    def digests(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1).to_pylist()[0]
                rows = [
                    {
                        "doc_id": name, "shard": block["shard"], "start_in_shard": block["start_in_shard"] + begin,
                        "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes()),
                    }
                    for name, begin, ids in _each_document(block)
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow_docs)

    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        blocks.groupBy("shard")
        .agg(F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    return (
        blocks.mapInArrow(digests, DOC_SCHEMA)
        .join(F.broadcast(before), "shard")
        .select("doc_id", (F.col("before") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")
    )


arrow_docs = pa.schema(
    [
        ("doc_id", pa.int64()), ("shard", pa.int32()), ("start_in_shard", pa.int64()),
        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()),
    ]
)
