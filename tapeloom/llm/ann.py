"""Approximate nearest neighbours by cosine: an NN-descent graph and greedy search on it.

Nodes are distinct vectors; copies hang on their node, so a vector that fills a third of the rows is
one node.  The graph starts from neighbours in a few orders of the nodes by the signs of random
projections, cut into chunks, so that no bucket can grow.  In each round every node gathers its
neighbours, forward and the best reverse, which propose themselves to each other (neighbours of
neighbours), until few edges change.  A query walks the graph from its own node, if it is a row, and
from the closest of ``PIVOTS`` spread nodes: each round expands the open nodes of its beam, until
none is open.  The graph uses single precision; what the beams hold in the end is measured on the
original vectors in double precision.

Each node is one row that holds its list of neighbours, so a round is five exchanges: lists to where
reverse neighbours meet, two for the vectors of the guests, one for the meeting, one for the new
lists.

Cases: a vector that is null, zero, or that holds null or non-finite numbers takes no part, nor does
a null vec_id; vectors of different lengths are never compared; ties go to the smaller vec_id; with
fewer candidates than asked for, all found are returned; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.shared import discard, durable, give_back, whole_groups

#: Neighbours of a node in the graph, reverse neighbours that join a meeting, rounds at most, and
#: the share of changed edges that ends them.
NEIGHBOURS, REVERSE, ROUNDS, SETTLED = 32, 24, 4, 0.02
#: Nodes that are compared in a chunk of a starting order, orders, and signs that make an order.
CHUNK, ORDERS, SIGNS = 2048, 8, 32
#: The search: size of a beam, nodes expanded in a round, rounds at most, and pivots.
BEAM, EXPAND, SEARCH_ROUNDS, PIVOTS = 96, 96, 16, 64
#: Keys or edges that a task holds before it hands them on, and queries whose beams it hands on at once.
HELD, BEAMS_AT_ONCE = 100_000, 256


def _matrix(column: pa.ChunkedArray | pa.Array, kind: type) -> np.ndarray:
    """The rows of a column of equally long vectors."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _by_length(column: pa.Array, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the vectors of each length."""
    lengths = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, _matrix(column.take(pa.array(at)), kind)


def _clean(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows, as doubles, of the vectors of a batch that take part."""
    column = batch.column("embedding")
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        rows = flat.reshape(-1, size)
        ok = np.isfinite(rows).all(1) & (rows != 0).any(1)
        yield at[ok], rows[ok]


def _key(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _units(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)  # no square overflows
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def _read(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    )


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, vec): the vectors that take part, as doubles, and a fingerprint of each."""

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _clean(batch):
                raw = [r.tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(at)), pa.array([_key(r) for r in raw], pa.binary()), pa.array(raw, pa.binary())],
                    ["vec_id", "key", "vec"],
                )

    return _read(vectors).mapInArrow(rows_of, "vec_id long, key binary, vec binary")


def distinct_vectors(vectors: DataFrame, copies: int) -> DataFrame:
    """(node, key, ids, vec, unit): each distinct vector, named by its least vec_id; ids are the
    least ``copies`` of its rows. Copies are put together within a task first."""

    def held_rows(held: dict[bytes, tuple[list[int], bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.binary()),
                pa.array([ids for ids, _ in held.values()], pa.list_(pa.int64())),
                pa.array([raw for _, raw in held.values()], pa.binary()),
            ],
            ["key", "ids", "vec"],
        )

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[list[int], bytes]] = {}
        for batch in batches:
            names = batch.column("vec_id").to_numpy()
            for at, rows in _clean(batch):
                for name, row in zip(names[at].tolist(), rows, strict=True):
                    raw = row.tobytes()
                    ids = held.setdefault(_key(raw), ([], raw))[0]
                    ids.append(name)
                    if len(ids) > 4 * copies:
                        ids[:] = sorted(set(ids))[:copies]
            if len(held) > HELD // 10:
                yield held_rows(held)
                held = {}
        yield held_rows(held)

    def with_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _by_length(batch.column("vec"), np.float64):
                own = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*own.columns, pa.array([u.tobytes() for u in _units(rows)], pa.binary())], ["node", "key", "ids", "vec", "unit"]
                )

    few = _read(vectors).mapInArrow(put_together, "key binary, ids array<long>, vec binary")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, copies)
    once = few.groupBy("key").agg(ids.alias("ids"), F.first("vec").alias("vec"))
    return once.select(F.col("ids")[0].alias("node"), "key", "ids", "vec").mapInArrow(
        with_units, "node long, key binary, ids array<long>, vec binary, unit binary"
    )


def _joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """The join by on, of which neither side is broadcast: Spark guesses the size of rows that Python
    makes from the files beneath, and those of beams hold a hundredth of what is made of them."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def _few(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k largest finite entries of each row."""
    if sims.shape[1] > k:
        columns = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    else:
        columns = np.broadcast_to(np.arange(sims.shape[1]), sims.shape)
    rows = np.repeat(np.arange(len(sims)), columns.shape[1])
    columns = columns.reshape(-1)
    good = np.isfinite(sims[rows, columns])
    return rows[good], columns[good]


def _ranked(group: np.ndarray, sims: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest sims of each group, by group, then largest first."""
    order = np.lexsort((ties, -sims, group))
    ordered = group[order]
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, int)
    rank = np.arange(len(ordered)) - np.repeat(first, np.diff(np.r_[first, len(ordered)]))
    return order[rank < k]


EDGES = "at long, other long, sim float"


def _edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[], [], []]
    kinds = (pa.int64(), pa.int64(), pa.float32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["at", "other", "sim"])


def _started(nodes: DataFrame, neighbours: int) -> DataFrame:
    """Edges to the closest nodes of the same chunk, in ORDERS orders of all nodes."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, units in _by_length(batch.column("unit"), np.float32):
                own = batch.take(pa.array(at))
                signs = np.random.default_rng(3).normal(size=(ORDERS, SIGNS, units.shape[1])).astype(np.float32)
                for t in range(ORDERS):
                    code = ((units @ signs[t].T) > 0) @ (1 << np.arange(SIGNS, dtype=np.int64))
                    run = np.full(len(at), t * 2**32 + units.shape[1], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(code), *own.columns], ["run", "code", "node", "unit"])

    def closest(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        chunk = pa.Table.from_batches(parts)
        own, units = chunk.column("node").to_numpy(), _matrix(chunk.column("unit"), np.float32)
        sims = units @ units.T
        np.fill_diagonal(sims, -np.inf)
        rows, columns = _top(sims, neighbours)
        return _edges([(own[rows], own[columns], sims[rows, columns])])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task holds one chunk at a time."""
        held: list[pa.RecordBatch] = []
        count, run = 0, None
        for batch in batches:
            runs = batch.column("run").to_numpy()
            a = 0
            while a < len(runs):
                if held and (count == CHUNK or runs[a] != run):
                    yield closest(held)
                    held, count = [], 0
                run = runs[a]
                n = min(int(np.searchsorted(runs, run, side="right")) - a, CHUNK - count)
                held.append(batch.slice(a, n))
                a, count = a + n, count + n
        if held:
            yield closest(held)
        held = []
        give_back()

    ordered = nodes.select("node", "unit").mapInArrow(placed, "run long, code long, node long, unit binary")
    ordered = ordered.repartitionByRange("run", "code", "node").sortWithinPartitions("run", "code", "node")
    return ordered.select("run", "node", "unit").mapInArrow(compare, EDGES)


LISTS = "node long, unit binary, others binary, sims binary, fresh binary, changed long"


def _relisted(lists: DataFrame, edges: DataFrame, neighbours: int) -> DataFrame:
    """lists with the best of their neighbours and of edges; fresh marks those that are new."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, "at"):
            homes = np.array(cuts[:-1])  # each group begins with its list
            units, others, sims = (table.column(c).take(pa.array(homes)).to_pylist() for c in ("unit", "others", "sims"))
            known = [np.frombuffer(x or b"", np.int64) for x in others]
            old = np.repeat(np.arange(len(homes)), [len(x) for x in known])
            rows = np.setdiff1d(np.arange(len(table)), homes, assume_unique=True)
            group = np.r_[old, np.searchsorted(homes, rows, side="right") - 1]
            at = table.column("other").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            node = np.concatenate([*known, at])
            sim = np.r_[np.concatenate([np.frombuffer(x or b"", np.float32) for x in sims]), table.column("sim").to_numpy(zero_copy_only=False)[rows].astype(np.float32)]
            fresh = np.arange(len(group)) >= len(old)
            order = np.lexsort((fresh, node, group))  # of equal edges the known one comes first
            once = order[np.r_[True, (np.diff(group[order]) != 0) | (np.diff(node[order]) != 0)]] if len(order) else order
            best = once[_ranked(group[once], sim[once], node[once], neighbours)]
            bounds = np.searchsorted(group[best], np.arange(len(homes) + 1))
            node, sim, fresh = node[best], sim[best], fresh[best].astype(np.uint8)
            pieces = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("at").take(pa.array(homes)).combine_chunks(),
                    pa.array(units, pa.binary()),
                    *(pa.array([x[a:b].tobytes() for a, b in pieces], pa.binary()) for x in (node, sim, fresh)),
                    pa.array([int(fresh[a:b].sum()) for a, b in pieces], pa.int64()),
                ],
                ["node", "unit", "others", "sims", "fresh", "changed"],
            )

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    home = lists.select(
        F.col("node").alias("at"), F.lit(0).alias("kind"), none("long", "other"), none("float", "sim"), "unit", "others", "sims"
    )
    offers = edges.select("at", F.lit(1).alias("kind"), "other", "sim", *(none("binary", c) for c in ("unit", "others", "sims")))
    return home.unionByName(offers).repartition("at").sortWithinPartitions("at", "kind").mapInArrow(merge, LISTS)


def _guests(lists: DataFrame) -> DataFrame:
    """(at, node, fresh): who meets at a node: its neighbours and the best of those it is one of."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def backward(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            src, dst, sim, fresh = (np.concatenate(x) for x in zip(*held, strict=True))
            best = _ranked(dst, sim, src, REVERSE)
            return rows(dst[best], src[best], sim[best], fresh[best])

        def rows(at: np.ndarray, node: np.ndarray, sim: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(node), pa.array(sim), pa.array(fresh.astype(np.int32))], ["at", "node", "sim", "fresh"]
            )

        held, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            others, sims, fresh = (batch.column(c).to_pylist() for c in ("others", "sims", "fresh"))
            dst = np.frombuffer(b"".join(others), np.int64)
            src = np.repeat(batch.column("node").to_numpy(), [len(x) // 8 for x in others])
            sim, new = np.frombuffer(b"".join(sims), np.float32), np.frombuffer(b"".join(fresh), np.uint8)
            yield rows(src, dst, np.full(len(src), np.inf, np.float32), new)  # forward: always among the best
            held.append((src, dst, sim, new))
            count += len(src)
            if count > 10 * HELD:
                yield backward(held)
                held, count = [], 0
        if held:
            yield backward(held)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _ in whole_groups(batches, "at"):
            at, node, sim, fresh = (table.column(c).to_numpy() for c in ("at", "node", "sim", "fresh"))
            ahead = np.isinf(sim)
            back = np.flatnonzero(~ahead)
            kept = np.r_[np.flatnonzero(ahead), back[_ranked(at[back], sim[back], node[back], REVERSE)]]
            order = kept[np.lexsort((-fresh[kept], node[kept], at[kept]))]
            once = order[np.r_[True, (np.diff(at[order]) != 0) | (np.diff(node[order]) != 0)]]
            yield pa.RecordBatch.from_arrays([pa.array(at[once]), pa.array(node[once]), pa.array(fresh[once])], ["at", "node", "fresh"])

    rows = lists.select("node", "others", "sims", "fresh").mapInArrow(told, "at long, node long, sim float, fresh int")
    return rows.repartition("at").sortWithinPartitions("at").mapInArrow(chosen, "at long, node long, fresh int")


def _proposed(lists: DataFrame, neighbours: int) -> DataFrame:
    """Edges between the guests of each node, as far as they are better than what a guest has."""

    def with_bar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bars = [np.frombuffer(x, np.float32).min() if len(x) >= 4 * neighbours else -2.0 for x in batch.column("sims").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("unit"), pa.array(bars, pa.float32())], ["node", "unit", "bar"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, "at"):
            ids, fresh, bar = (table.column(c).to_numpy() for c in ("node", "fresh", "bar"))
            column, parts = table.column("unit"), []
            for a, b in zip(cuts, cuts[1:], strict=False):
                new = fresh[a:b] > 0
                if b - a > 1 and new.any():
                    units = _matrix(column.slice(a, b - a), np.float32)
                    sims = units @ units.T
                    sims[~(new[:, None] | new[None, :]) | (sims <= bar[a:b, None])] = -np.inf
                    np.fill_diagonal(sims, -np.inf)
                    rows, columns = _top(sims, neighbours // 2)
                    parts.append((ids[a + rows], ids[a + columns], sims[rows, columns]))
            if parts:  # the best of the whole table of each, once
                at, other, sim = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.lexsort((other, at))
                once = order[np.r_[True, (np.diff(at[order]) != 0) | (np.diff(other[order]) != 0)]] if len(order) else order
                best = once[_ranked(at[once], sim[once], other[once], neighbours)]
                yield _edges([(at[best], other[best], sim[best])])

    known = lists.select("node", "unit", "sims").mapInArrow(with_bar, "node long, unit binary, bar float")
    meeting = _joined(_guests(lists), known, "node").select("at", "node", "fresh", "unit", "bar")
    return meeting.repartition("at").sortWithinPartitions("at").mapInArrow(meet, EDGES)


def build_graph(nodes: DataFrame, neighbours: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """node, unit, others, sims (and marks of the last round): about the nearest neighbours of each
    node (node, unit), nearest first."""
    none = F.lit(None).cast("binary")
    empty = nodes.select("node", "unit", none.alias("others"), none.alias("sims"))
    lists = durable(_relisted(empty, _started(nodes, neighbours), neighbours), "lists0")
    for number in range(1, rounds + 1):
        after = durable(_relisted(lists, _proposed(lists, neighbours), neighbours), f"lists{number}")
        discard(lists)
        lists = after
        total = lists.agg(F.sum("changed").alias("changed"), F.count("*").alias("n")).first()
        if (total["changed"] or 0) <= SETTLED * total["n"] * neighbours:
            break
    return lists


@dataclass
class Index:
    """nodes (node, key, ids: its least vec_ids, vec, unit) and graph (node, others, sims)."""

    nodes: DataFrame
    graph: DataFrame


def build_index(vectors: DataFrame, copies: int, neighbours: int = NEIGHBOURS) -> Index:
    """Index vectors (vec_id, embedding); copies: least vec_ids of a node that are kept."""
    nodes = durable(distinct_vectors(vectors, copies), "vectors")
    return Index(nodes, build_graph(nodes, neighbours))


BEAMS = "query_id long, vec binary, nodes binary, sims binary, done binary, open long"


def _rebeamed(rows: DataFrame, beam: int) -> DataFrame:
    """The best nodes of each query from rows (query_id, kind, vec, node, sim, nodes, sims, done):
    its beam so far (kind 0) and newly measured nodes (kind 1)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in whole_groups(batches, "query_id"):
            kinds, nodes, sims = (table.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "node", "sim"))
            out: list[list] = [[] for _ in range(6)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                head = {c: table.column(c)[a].as_py() for c in ("query_id", "vec", "nodes", "sims", "done")}
                new = a + np.flatnonzero(kinds[a:b] == 1)
                node = np.r_[np.frombuffer(head["nodes"], np.int64), nodes[new].astype(np.int64)]
                sim = np.r_[np.frombuffer(head["sims"], np.float32), sims[new].astype(np.float32)]
                done = np.r_[np.frombuffer(head["done"], np.uint8), np.zeros(len(new), np.uint8)]
                order = np.lexsort((1 - done, node))
                once = order[np.r_[True, np.diff(node[order]) != 0]] if len(order) else order
                best = once[np.lexsort((node[once], -sim[once]))][:beam]
                row = (head["query_id"], head["vec"], node[best].tobytes(), sim[best].tobytes(), done[best].tobytes(), int((done[best] == 0).sum()))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds_of = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, kinds_of, strict=True)], ["query_id", "vec", "nodes", "sims", "done", "open"]
            )

    return rows.repartition("query_id").sortWithinPartitions("query_id", "kind").mapInArrow(merge, BEAMS)


def _started_beams(index: Index, queries: DataFrame, beam: int) -> DataFrame:
    """Beams of the neighbours of each query's own node, if it has one, and of the closest pivots."""
    spread = index.nodes.select("node", "unit").orderBy(F.xxhash64("node")).limit(PIVOTS).collect()
    pivots: dict[int, list] = {}
    for p in spread:
        pivots.setdefault(len(p["unit"]), []).append((p["node"], np.frombuffer(p["unit"], np.float32)))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _by_length(batch.column("vec"), np.float64):
                own = batch.take(pa.array(at))
                near = pivots.get(4 * rows.shape[1], [])
                sims = _units(rows) @ np.array([u for _, u in near]).T if near else np.zeros((len(at), 0), np.float32)
                first = np.argsort(-sims, axis=1)[:, :4]
                names = np.array([n for n, _ in near], np.int64)
                columns: list[list[bytes]] = [[], [], []]
                for i, (node, others, known) in enumerate(zip(*(own.column(c).to_pylist() for c in ("node", "others", "sims")), strict=True)):
                    # the own node is expanded already: its neighbours are here
                    head = np.array([] if node is None else [node], np.int64)
                    nodes = np.r_[head, np.frombuffer(others or b"", np.int64), names[first[i]] if near else head[:0]]
                    likes = np.r_[np.ones(len(head)), np.frombuffer(known or b"", np.float32), sims[i, first[i]]].astype(np.float32)
                    done = (np.arange(len(nodes)) < len(head)).astype(np.uint8)
                    _, once = np.unique(nodes, return_index=True)
                    best = once[np.argsort(-likes[once], kind="stable")][:beam]
                    for column, value in zip(columns, (nodes, likes, done), strict=True):
                        column.append(value[best].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [own.column("query_id"), own.column("vec"), *(pa.array(c, pa.binary()) for c in columns), pa.array([len(d) for d in columns[2]], pa.int64())],
                    ["query_id", "vec", "nodes", "sims", "done", "open"],
                )

    own = _joined(queries, index.nodes.select("node", "key"), "key", "left")
    own = _joined(own, index.graph.select("node", "others", "sims"), "node", "left")
    return own.select("query_id", "vec", "node", "others", "sims").mapInArrow(begin, BEAMS)


def search(index: Index, queries: DataFrame, beam: int = BEAM, expand: int = EXPAND, rounds: int = SEARCH_ROUNDS) -> DataFrame:
    """(query_id, node, vec_id, score) of the copies of the nodes of each query's beam, scores as
    exact cosines. queries has query_id, key, vec.

    One round expands the open nodes of all beams with two joins.
    """

    def front(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, unit, node) of the nodes that are expanded now."""
        for batch in _few(batches, BEAMS_AT_ONCE):
            for at, rows in _by_length(batch.column("vec"), np.float64):
                own, units = batch.take(pa.array(at)), [u.tobytes() for u in _units(rows)]
                picks = [
                    np.frombuffer(n, np.int64)[np.frombuffer(d, np.uint8) == 0][:expand]
                    for n, d in zip(own.column("nodes").to_pylist(), own.column("done").to_pylist(), strict=True)
                ]
                times = np.repeat(np.arange(len(at)), [len(p) for p in picks])
                yield pa.RecordBatch.from_arrays(
                    [own.column("query_id").take(pa.array(times)), pa.array([units[i] for i in times.tolist()], pa.binary()), pa.array(np.concatenate(picks))],
                    ["query_id", "unit", "node"],
                )

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The beams with those nodes done."""
        for batch in batches:
            done = []
            for x in batch.column("done").to_pylist():
                flags = np.frombuffer(x, np.uint8).copy()
                flags[np.flatnonzero(flags == 0)[:expand]] = 1
                done.append(flags.tobytes())
            columns = {n: batch.column(n) for n in batch.schema.names} | {"done": pa.array(done, pa.binary())}
            yield pa.RecordBatch.from_pydict(columns)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(query_id, unit, node): the neighbours of expanded nodes, those of a batch once."""
        for batch in batches:
            others = batch.column("others").to_pylist()
            times = np.repeat(np.arange(batch.num_rows), [len(x) // 8 for x in others])
            nodes = np.frombuffer(b"".join(others), np.int64)
            query = batch.column("query_id").to_numpy()[times]
            order = np.lexsort((nodes, query))
            once = order[np.r_[True, (np.diff(query[order]) != 0) | (np.diff(nodes[order]) != 0)]] if len(order) else order
            yield pa.RecordBatch.from_arrays(
                [pa.array(query[once]), batch.column("unit").take(pa.array(times[once])), pa.array(nodes[once])], ["query_id", "unit", "node"]
            )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _by_length(batch.column("unit"), np.float32):
                own = batch.take(pa.array(at))
                sims = np.einsum("ij,ij->i", rows, _matrix(own.column("asked"), np.float32))
                yield pa.RecordBatch.from_arrays([own.column("query_id"), own.column("node"), pa.array(sims)], ["query_id", "node", "sim"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches, BEAMS_AT_ONCE):
            nodes = batch.column("nodes").to_pylist()
            times = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) // 8 for x in nodes]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(times), batch.column("vec").take(times), pa.array(np.frombuffer(b"".join(nodes), np.int64))],
                ["query_id", "asked", "node"],
            )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in _by_length(batch.column("vec"), np.float64):
                own = batch.take(pa.array(at))
                scores = _cosines(rows, _matrix(own.column("asked"), np.float64))
                yield pa.RecordBatch.from_arrays(
                    [own.column("query_id"), own.column("node"), own.column("ids"), pa.array(scores)], ["query_id", "node", "ids", "score"]
                )

    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    beams = durable(_started_beams(index, queries, beam), "beams0")
    for number in range(1, rounds + 1):
        if beams.where("open > 0").isEmpty():
            break
        expanded = beams.where("open > 0").mapInArrow(front, "query_id long, unit binary, node long")
        pairs = _joined(expanded, index.graph.select("node", "others"), "node").select("query_id", "unit", "others")
        pairs = pairs.mapInArrow(reached, "query_id long, unit binary, node long").withColumnRenamed("unit", "asked")
        paired = _joined(pairs, index.nodes.select("node", "unit"), "node").select("query_id", "node", "asked", "unit")
        near = paired.mapInArrow(measured, "query_id long, node long, sim float")
        known = beams.mapInArrow(marked, BEAMS)
        rows = known.select("query_id", F.lit(0).alias("kind"), "vec", none("long", "node"), none("float", "sim"), "nodes", "sims", "done")
        more = near.select("query_id", F.lit(1).alias("kind"), none("binary", "vec"), "node", "sim", *(none("binary", c) for c in ("nodes", "sims", "done")))
        after = durable(_rebeamed(rows.unionByName(more), beam), f"beams{number}")
        discard(beams)
        beams = after
    pairs = beams.select("query_id", "vec", "nodes").mapInArrow(found, "query_id long, asked binary, node long")
    paired = _joined(pairs, index.nodes.select("node", "ids", "vec"), "node").select("query_id", "node", "ids", "asked", "vec")
    exact = paired.mapInArrow(scored, "query_id long, node long, ids array<long>, score double")
    return exact.select("query_id", "node", F.explode("ids").alias("vec_id"), "score")


def _cosines(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Cosines along the last axis, in double precision."""
    return (one * two).sum(-1) / (np.sqrt((one * one).sum(-1)) * np.sqrt((two * two).sum(-1)))


def nearest(vectors: DataFrame, is_query: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row with the condition.

    vectors has vec_id and embedding; is_query is SQL over vec_id.
    """
    index = build_index(vectors, copies=k + 1)
    queries = usable(vectors.where(is_query)).select(F.col("vec_id").alias("query_id"), "key", "vec")
    listed = search(index, queries.dropDuplicates(["query_id", "key"])).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = listed.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
