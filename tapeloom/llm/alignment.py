"""Alignment of the tokens of two tokenizers over the same text.

A text is read as a string of labels, one a byte: no token ends there, one of A, one of B, or one
of each.  A regular expression scans that string for spans up to a byte where both end; the labels
of a span count the tokens of its group.  Every pair of an A and a B token of a group is a link.
A pair of ids counts in the corpus as many documents as have it linked at least once.

Counting happens by blocks of documents: a block sends each of its distinct pairs once, with the
number of its documents that have it; sums by pair and maxima by A id come back to each block that
asked, which looks up the pairs of its documents.  No table of pairs is broadcast, and a pair that
every document has costs a row for each block.

Cases: a null or empty text, and one whose tokens do not spell a space and the text, has no tokens
and zeros, with '' for groups_sha256; strings of special tokens are plain text; rows of equal
doc_id and text are documents of their own and all count; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.pieces import piece_encoder
from tapeloom.llm.shared import bounded_batches, byte_slices, discard, durable, give_back
from tapeloom.llm.tokenize import encoder

SLICE_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20
#: Pairs of one group that are listed at once.
PAIRS_TOGETHER = 1 << 20
#: The labels: no end, an end of A, of B, of both.
LABELS = np.frombuffer(b".abc", np.uint8)
_SPAN = re.compile(rb"[.ab]*c")
_SEPARATORS = np.array(["", ",", "|", ";"], object)


def _text(value: str) -> pa.Scalar:
    return pa.scalar(value, pa.large_string())


class Alignment:
    """Tokens, groups and links of a slice of texts."""

    def __init__(self, texts: pa.Array, a_path: str, b_path: str):
        a_encoder, b_encoder = encoder(a_path, plain_specials=True), piece_encoder(b_path)
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        full = pc.if_else(pc.equal(texts, ""), _text(""), pc.binary_join_element_wise(_text(""), texts, _text(" ")))
        a, a_cuts = a_encoder.encode(full)
        b, b_cuts = b_encoder.encode(texts)
        own = [_Joined(x, cuts, e.bytes) for x, cuts, e in ((a, a_cuts, a_encoder), (b, b_cuts, b_encoder))]
        raw = np.frombuffer(full.buffers()[2] or b"", np.uint8)
        at = np.frombuffer(full.buffers()[1], np.int64)[full.offset : full.offset + len(full) + 1]
        whole = np.ones(len(texts), bool)
        for tokens in own:
            whole &= tokens.spell(raw, at)
        self.a, self.b = a[whole[own[0].rows]].astype(np.int64), b[whole[own[1].rows]].astype(np.int64)
        a_rows, b_rows = own[0].rows[whole[own[0].rows]], own[1].rows[whole[own[1].rows]]
        sizes = np.where(whole, np.diff(at), 0)
        base = np.cumsum(sizes) - sizes
        a_ends = np.cumsum(own[0].sizes[whole[own[0].rows]])
        b_ends = np.cumsum(own[1].sizes[whole[own[1].rows]])
        labels = np.zeros(int(sizes.sum()), np.uint8)
        labels[a_ends - 1] |= 1
        labels[b_ends - 1] |= 2
        labels = LABELS[labels]
        ends = np.fromiter((m.end() for m in _SPAN.finditer(labels.tobytes())), np.int64)
        #: Of each group: the tokens it begins with and how many it has, and its text.
        self.a_counts = np.diff(np.cumsum((labels == 97) | (labels == 99))[ends - 1], prepend=0)
        self.b_counts = np.diff(np.cumsum((labels == 98) | (labels == 99))[ends - 1], prepend=0)
        self.a_begins = np.cumsum(self.a_counts) - self.a_counts
        self.b_begins = np.cumsum(self.b_counts) - self.b_counts
        self.row = np.searchsorted(base + sizes, ends, "left")
        n = len(texts)
        self.n_a, self.n_b = np.bincount(a_rows, minlength=n), np.bincount(b_rows, minlength=n)
        self.n_groups = np.bincount(self.row, minlength=n)
        links = np.zeros(n, np.int64)
        np.add.at(links, self.row, self.a_counts * self.b_counts)
        self.n_links = links

    def digests(self) -> list[str]:
        """groups_sha256 of each text."""
        total = len(self.a) + len(self.b)
        words = np.empty(2 * total, object)
        # a group's A tokens come before its B tokens; the separator stands before each token
        a_group = np.repeat(np.arange(len(self.row)), self.a_counts)
        b_group = np.repeat(np.arange(len(self.row)), self.b_counts)
        a_place = np.arange(len(self.a)) + self.b_begins[a_group]
        b_place = np.arange(len(self.b)) + (self.a_begins + self.a_counts)[b_group]
        before = np.ones(total, np.int8)
        before[a_place[self.a_begins]] = 3
        before[b_place[self.b_begins]] = 2
        ends = np.cumsum(self.n_a + self.n_b)
        begins = ends - self.n_a - self.n_b
        before[begins[begins < ends]] = 0
        words[0::2] = _SEPARATORS[before]
        words[2 * a_place + 1] = _texts(self.a)
        words[2 * b_place + 1] = _texts(self.b)
        words = words.tolist()
        return [hashlib.sha256("".join(words[2 * i : 2 * j]).encode()).hexdigest() if i < j else "" for i, j in zip(begins.tolist(), ends.tolist(), strict=True)]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, pair, times): the distinct pairs a << 32 | b of each text and how often it links them."""
        n = self.a_counts * self.b_counts
        large = n > PAIRS_TOGETHER
        parts = [self._listed(some) for some in np.array_split(np.flatnonzero(~large), 1 + int(n[~large].sum()) // PAIRS_TOGETHER)]
        parts += [part for g in np.flatnonzero(large).tolist() for part in self._large(g)]
        rows, codes, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        return _summed(rows, codes, times)

    def _listed(self, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.a_counts[groups] * self.b_counts[groups]
        of = np.repeat(groups, n)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        width = self.b_counts[of]
        a, b = self.a[self.a_begins[of] + k // width], self.b[self.b_begins[of] + k % width]
        return _summed(self.row[of], a << 32 | b, np.ones(len(of), np.int64))

    def _large(self, group: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A group of very many links, by its distinct ids."""
        a, a_times = np.unique(self.a[self.a_begins[group] :][: self.a_counts[group]], return_counts=True)
        b, b_times = np.unique(self.b[self.b_begins[group] :][: self.b_counts[group]], return_counts=True)
        step = max(1, PAIRS_TOGETHER // len(b))
        for i in range(0, len(a), step):
            codes = (a[i : i + step, None] << 32 | b[None, :]).ravel()
            yield np.full(len(codes), self.row[group]), codes, (a_times[i : i + step, None] * b_times[None, :]).ravel()


def _summed(rows: np.ndarray, codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """times summed by (row, code), sorted by both."""
    order = np.lexsort((codes, rows))
    rows, codes, times = rows[order], codes[order], times[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    begins = np.flatnonzero(new)
    return rows[begins], codes[begins], np.add.reduceat(times, begins) if len(begins) else times


class _Joined:
    """The bytes that the tokens of each text spell."""

    def __init__(self, ids: np.ndarray, cuts: np.ndarray, spelled: list[bytes]):
        sizes, begins, pool = _pool(spelled)
        self.sizes, self.cuts = sizes[ids], np.concatenate(([0], np.cumsum(sizes[ids])))[cuts]
        self.rows = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        done = np.cumsum(self.sizes)
        self.data = pool[np.repeat(begins[ids] - (done - self.sizes), self.sizes) + np.arange(int(self.sizes.sum()))]

    def spell(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts raw[at[i]:at[i + 1]] the tokens spell, each token by at least one byte."""
        alike = np.diff(at) == np.diff(self.cuts)
        alike[self.rows[self.sizes == 0]] = False
        sizes = np.where(alike, np.diff(at), 0)
        shift = np.cumsum(sizes) - sizes
        inner = np.arange(int(sizes.sum())) - np.repeat(shift, sizes)
        other = raw[inner + np.repeat(at[:-1], sizes)] != self.data[inner + np.repeat(self.cuts[:-1], sizes)]
        alike[np.repeat(np.arange(len(sizes)), sizes)[other]] = False
        return alike


_pools: dict[int, tuple] = {}


def _pool(spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and begins of each id's bytes, and all of them."""
    if id(spelled) not in _pools:
        sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        if len(_pools) > 4:
            _pools.clear()
        _pools[id(spelled)] = sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(spelled), np.uint8), spelled
    return _pools[id(spelled)][:3]


_numbers = np.array([], object)


def _texts(ids: np.ndarray) -> np.ndarray:
    """ids as decimal text."""
    global _numbers
    if len(ids) and int(ids.max()) >= len(_numbers):
        _numbers = np.array([str(i) for i in range(int(ids.max()) + 1)], object)
    return _numbers[ids]


_DOCUMENT = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def align(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 of every document, and its distinct
    pairs (binary, 64-bit, a << 32 | b, ascending) with times, how often each is linked (64-bit)."""
    names = [field.split()[0] for field in _DOCUMENT.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = uuid.uuid4().int >> 65, 0
        for part in byte_slices(batches, "text", SLICE_BYTES):
            if filled >= block_bytes:
                block, filled = uuid.uuid4().int >> 65, 0
            filled += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            own = Alignment(part.column("text"), a_path, b_path)
            row, codes, times = own.pairs()
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            binaries = [[x[i:j].tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)] for x in (codes, times)]
            counts = [pa.array(x.astype(np.int64)) for x in (own.n_a, own.n_b, own.n_groups, own.n_links)]
            columns = [pa.array([block] * part.num_rows, pa.int64()), part.column("doc_id"), *counts, pa.array(own.digests(), pa.string()), *(pa.array(x, pa.binary()) for x in binaries)]
            yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(rows, _DOCUMENT)


def _block_pairs(aligned: DataFrame) -> DataFrame:
    """(block, a, b, n): the documents of a block that have a pair, summed as far as a task sees."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(block: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(codes), 50_000):
                some, n = codes[i : i + 50_000], counts[i : i + 50_000]
                columns = [np.full(len(some), block), (some >> 32).astype(np.int32), (some & 0xFFFFFFFF).astype(np.int32), n.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "a", "b", "n"])

        block, held = None, []
        for batch in batches:
            for of, pairs in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                if held and of != block:
                    yield from cut(block, held)
                    held = []
                block = of
                held.append(np.frombuffer(pairs, np.int64))
        if held:
            yield from cut(block, held)
        give_back()

    return aligned.select("block", "pairs").mapInArrow(own, "block long, a int, b int, n long")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): the documents that link two ids, and whether no other b has more with a."""
    counts = _block_pairs(aligned).groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = durable(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def linked(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    bounded_batches(docs.sparkSession)
    aligned = durable(align(docs, a_path, b_path, block_bytes), "aligned")
    counts = durable(pair_counts(aligned), "pair-best")
    asked = _block_pairs(aligned).select("block", "a", "b").distinct()
    packed = asked.join(counts, ["a", "b"]).select(
        "block", F.struct(F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair"), "n", "best").alias("x")
    )
    replies = packed.groupBy("block").agg(F.collect_list("x").alias("found"))  # a block's own distinct pairs

    def look_up(table: pa.Table, answers: pa.Table) -> pa.Table:
        found = answers.column("found").combine_chunks()
        found = (found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)).flatten()
        keys, n, best = (found.field(i).to_numpy(zero_copy_only=False) for i in range(3))
        order = np.argsort(keys)
        keys, n, best = keys[order], n[order], best[order]
        n_best, count_sum = [], []
        for pairs, times in zip(table.column("pairs").to_pylist(), table.column("times").to_pylist(), strict=True):
            at, times = np.searchsorted(keys, np.frombuffer(pairs, np.int64)), np.frombuffer(times, np.int64)
            n_best.append(int(times[best[at]].sum()))
            count_sum.append(int((times * n[at]).sum()))
        out = table.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        give_back()
        return out.append_column("groups_sha256", table.column("groups_sha256"))

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    done = durable(aligned.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(look_up, schema), "linked")
    discard(aligned, counts)
    return done


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, grp, a_ids, b_ids): the token groups themselves, numbered from 0 in each document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", SLICE_BYTES):
            own = Alignment(part.column("text"), a_path, b_path)
            names = part.column("doc_id").to_numpy(zero_copy_only=False)
            first = np.cumsum(own.n_groups) - own.n_groups
            frame = pd.DataFrame({"doc_id": pd.Series(names).astype("Int64").take(own.row).array, "grp": np.arange(len(own.row)) - first[own.row]})
            lists = [pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(c))).astype(np.int32), x.astype(np.int32)) for c, x in ((own.a_counts, own.a), (own.b_counts, own.b))]
            yield pa.RecordBatch.from_arrays([pa.array(frame["doc_id"], pa.int64()), pa.array(frame["grp"], pa.int64()), *lists], ["doc_id", "grp", "a_ids", "b_ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(rows, "doc_id long, grp long, a_ids array<int>, b_ids array<int>")
