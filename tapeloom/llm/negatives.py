"""Hard negatives by inner product, through a table of distances to pivots.

With M the largest squared length, a row x becomes (x, sqrt(M - |x|^2)) and an anchor q becomes
(q, 0); then |q - x|^2 = |q|^2 + M - 2 q.x, so the inner product falls as the distance grows.  Each
row stores its distances to a few pivots, which are rows too.  For an anchor, the triangle
inequality over its own distances to the pivots brackets every row's distance, and so its score;
only rows whose bracket meets what is sought are scored exactly.

Rows lie in packed blocks, dealt by a hash into spans of several blocks; anchors lie in packed
chunks.  Every chunk meets every span once for the positives and once for the negatives; a task
keeps the best rows of a chunk over a span, and only these go on.  Labels play no part in how rows
are dealt, so a label of a third of all rows burdens no task.

Scores are integers: components are floor(scale * x).  They are computed in double precision where
that is exact, else in 64-bit integers; vectors whose inner products may exceed these raise an error.

Cases: rows with a null id, label or vector, or a null or non-finite component, take no part;
vectors of different length are compared as if the shorter had zeros behind; of rows of equal
id, the one of least label and vector counts; ties go to the smaller id; an anchor without
positives, or a positive without negatives, gives no rows; empty tables give no rows; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.shared import bounded_batches, discard, durable, give_back

SCALE, PIVOTS = 256, 16
#: Rows of a block, blocks of a span, anchors of a chunk.
BLOCK_ROWS, SPAN_BLOCKS, CHUNK_ANCHORS = 2048, 16, 256
#: A bracket is this much wider than computed, relative to squared lengths: rounding errors of doubles.
ROUNDING = 1e-6
_EXACT, _LONG = 2.0**53, 2.0**63


def _packed(rows: DataFrame, size: int | None, pivots: np.ndarray, top: float, anchors: bool = False) -> DataFrame:
    """Packed blocks of up to size rows of each grp (None: one block), each row with its distances to the pivots."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(of: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).sort_by([("label", "ascending"), ("id", "ascending")])
            x = _matrix(table.column("vector").to_pylist())
            values = [of, table.num_rows, x.shape[1], table.column("id").to_numpy().tobytes(), table.column("label").to_numpy().astype(np.int64).tobytes(), x.tobytes(), _distances(x, pivots, top, anchors).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _PACKED.values(), strict=True)], list(_PACKED))

        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for of in pc.unique(batch.column("grp")).to_pylist():
                part = batch.filter(pc.equal(batch.column("grp"), of))
                held.setdefault(of, []).append(part)
                while size and sum(p.num_rows for p in held.get(of, [])) >= size:
                    rows_ = pa.Table.from_batches(held[of]).combine_chunks().to_batches()[0]
                    yield out(of, [rows_.slice(0, size)])
                    held[of] = [rows_.slice(size)] if rows_.num_rows > size else []
        for of, parts in held.items():
            if parts:
                yield out(of, parts)
        give_back()

    return rows.mapInArrow(pack, "grp long, n int, width int, ids binary, labels binary, vectors binary, distances binary")


_PACKED = {"grp": pa.int64(), "n": pa.int32(), "width": pa.int32(), "ids": pa.binary(), "labels": pa.binary(), "vectors": pa.binary(), "distances": pa.binary()}


def _matrix(vectors: list[list[float]]) -> np.ndarray:
    width = max(map(len, vectors), default=0)
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def _distances(x: np.ndarray, pivots: np.ndarray, top: float, anchors: bool = False) -> np.ndarray:
    """Distances of the augmented rows of x (of anchors, if so) to the augmented pivots."""
    width = max(x.shape[1], pivots.shape[1])
    x, p = _widened(x, width), _widened(pivots, width)
    norms, own = (x * x).sum(1), (p * p).sum(1)
    lift = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(top - norms, 0))
    gap = lift[:, None] - np.sqrt(np.maximum(top - own, 0))[None, :]
    return np.sqrt(np.maximum(norms[:, None] + own[None, :] - 2 * x @ p.T + gap * gap, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integral rows; they fit a long, so longs that wrap on the way do no harm."""
    width = max(q.shape[1], x.shape[1])
    q, x = _widened(q, width), _widened(x, width)
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, width) < _EXACT:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class _Rows:
    """A packed block or chunk: ids, labels (ascending), vectors, distances to the pivots."""

    def __init__(self, row: dict, prefix: str = ""):
        n = row[f"{prefix}n"]
        self.ids, self.labels = (np.frombuffer(row[f"{prefix}{c}"], np.int64) for c in ("ids", "labels"))
        self.vectors = np.frombuffer(row[f"{prefix}vectors"], np.float64).reshape(n, row[f"{prefix}width"])
        self.distances = np.frombuffer(row[f"{prefix}distances"], np.float64).reshape(n, -1)
        self.norms = (self.vectors * self.vectors).sum(1)

    def only(self, rows: slice) -> _Rows:
        part = object.__new__(_Rows)
        for name, values in self.__dict__.items():
            setattr(part, name, values[rows])
        return part


def _bracket(anchors: _Rows, rows: _Rows, top: float) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of all anchors with all rows."""
    near = np.zeros((len(anchors.ids), len(rows.ids)))
    far = np.full(near.shape, np.inf)
    for a, x in zip(anchors.distances.T, rows.distances.T, strict=True):
        np.maximum(near, np.abs(a[:, None] - x[None, :]), out=near)
        np.minimum(far, a[:, None] + x[None, :], out=far)
    base = anchors.norms[:, None] + top
    slack = ROUNDING * base + 1
    return (base - far * far) / 2 - slack, (base - near * near) / 2 + slack


def _joined(spans: DataFrame, chunks: DataFrame, n_spans: int) -> DataFrame:
    """Every chunk beside every block; a chunk's blocks of a span follow each other."""
    own = [F.col(c).alias(f"a_{c}") for c in _PACKED if c != "grp"]
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_spans - 1).cast("long"))).alias("grp")
    asked = chunks.select(*own, *(c for c in chunks.columns if c == "bands"), F.col("grp").alias("chunk"), every)
    return asked.join(spans.hint("shuffle_hash"), "grp")


def _merge(found: dict, key: tuple, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    """Put rows among the k best of a key."""
    if key in found:
        ids, scores = np.concatenate((found[key][0], ids)), np.concatenate((found[key][1], scores))
    at = np.lexsort((ids, -scores))[:k]
    found[key] = ids[at], scores[at]


def _searched(pairs: DataFrame, search: Callable[[_Rows, _Rows, dict, dict], None], keys: tuple[str, ...]) -> DataFrame:
    """The rows that search() finds for each chunk in each span."""
    names = [*keys, "id", "score"]

    def out(found: dict) -> pa.RecordBatch:
        rows = [(*key, int(i), int(s)) for key, (ids, scores) in found.items() for i, s in zip(ids, scores, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, found = None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if (row["chunk"], row["grp"]) != now:
                    if found:
                        yield out(found)
                    now, chunk, found = (row["chunk"], row["grp"]), _Rows(row, "a_"), {}
                search(chunk, _Rows(row), found, row)
        if found:
            yield out(found)
        give_back()

    return pairs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _positives(pairs: DataFrame, top: float, k: int) -> DataFrame:
    """(anchor_id, id, score): the best k rows of the anchor's label in each span."""

    def search(chunk: _Rows, block: _Rows, found: dict, row: dict) -> None:
        for label in np.unique(chunk.labels).tolist():
            rows = block.only(slice(*np.searchsorted(block.labels, [label, label + 1])))
            anchors = chunk.only(slice(*np.searchsorted(chunk.labels, [label, label + 1])))
            if not len(rows.ids):
                continue
            kth = [found[key][1][-1] if (key := (x,)) in found and len(found[key][0]) == k else -np.inf for x in anchors.ids.tolist()]
            maybe = _bracket(anchors, rows, top)[1] >= np.array(kth)[:, None]
            some = np.flatnonzero(maybe.any(0))
            scores = _scores(anchors.vectors, rows.vectors[some])
            ids = rows.ids[some]
            for i, anchor in enumerate(anchors.ids.tolist()):
                ok = np.flatnonzero(maybe[i, some] & (ids != anchor) & (scores[i] >= kth[i]))
                if len(ok):
                    _merge(found, (anchor,), ids[ok], scores[i][ok], k)

    return _searched(pairs, search, ("anchor_id",))


def _negatives(pairs: DataFrame, top: float, k: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score): the best k rows of other labels in each
    span whose score lies in the band of a positive."""

    def search(chunk: _Rows, block: _Rows, found: dict, row: dict) -> None:
        place = {anchor: i for i, anchor in enumerate(chunk.ids.tolist())}
        low, high = np.full(len(place), np.inf), np.full(len(place), -np.inf)
        wanted: dict[int, list] = {}
        for band in row["bands"]:
            i = place[band["anchor_id"]]
            wanted.setdefault(i, []).append(band)
            low[i], high[i] = min(low[i], band["low"]), max(high[i], band["high"])
        least, most = _bracket(chunk, block, top)
        maybe = (most >= low[:, None]) & (least <= high[:, None]) & (block.labels[None, :] != chunk.labels[:, None])
        some = np.flatnonzero(maybe.any(0))
        scores = _scores(chunk.vectors, block.vectors[some])
        ids = block.ids[some]
        for i, bands in wanted.items():
            at = np.flatnonzero(maybe[i, some] & (scores[i] >= min(b["low"] for b in bands)) & (scores[i] <= max(b["high"] for b in bands)))
            at = at[np.lexsort((ids[at], -scores[i][at]))]
            falling = -scores[i][at]
            for band in bands:
                begin, end = np.searchsorted(falling, -band["high"], "left"), np.searchsorted(falling, -band["low"], "right")
                best = at[begin : min(end, begin + k)]
                if len(best):
                    _merge(found, (int(chunk.ids[i]), band["positive_id"], band["positive_score"]), ids[best], scores[i][best], k)

    return _searched(pairs, search, ("anchor_id", "positive_id", "positive_score"))


def prepared(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, label, vector): the rows that take part, their components floor(scale * x)."""
    whole = "id is not null and label is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    own = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<double>").alias("vector"))
    floors = F.expr(f"transform(vector, x -> if(abs({scale}D * x) < {_EXACT}D, cast(floor({scale}D * x) as double), {scale}D * x))")
    one = own.where(whole).groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x"))
    return one.select("id", F.col("x.label").alias("label"), F.col("x.vector").alias("vector")).select("id", "label", floors.alias("vector"))


def hard_negatives(
    rows: DataFrame,
    is_anchor: str,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
    span_blocks: int = SPAN_BLOCKS,
    chunk_anchors: int = CHUNK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows has id, label, vector; is_anchor is a condition on id, in SQL.  A negative of a positive has
    another label and low * positive_score <= 100 * its score <= high * positive_score.
    """
    bounded_batches(rows.sparkSession)
    table = durable(prepared(rows, scale), "vectors")
    norm = F.expr("aggregate(vector, 0D, (n, x) -> n + x * x)")
    seen = table.agg(F.count("*").alias("n"), F.coalesce(F.max(norm), F.lit(0.0)).alias("top"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    top = seen["top"]
    if not top < _LONG / 2:
        raise ValueError("inner products of these vectors do not fit a long")
    some = table.orderBy(F.xxhash64("id", "label", "vector"), "id").limit(pivots).collect()
    chosen = _widened(_matrix([r["vector"] for r in some]), seen["width"])
    deal = F.xxhash64("id", "label", "vector")
    n_spans = max(1, math.ceil(seen["n"] / (block_rows * span_blocks)))
    spread = table.withColumn("grp", F.pmod(deal, F.lit(n_spans)))
    spans = durable(_packed(spread.repartition(n_spans, "grp"), block_rows, chosen, top), "spans")
    anchors = table.where(is_anchor)
    n_chunks = max(1, math.ceil(anchors.count() / chunk_anchors))
    dealt = anchors.withColumn("grp", F.pmod(deal, F.lit(n_chunks)))
    chunks = durable(_packed(dealt.repartition(max(1, min(n_chunks, n_spans)), "grp"), None, chosen, top, anchors=True), "chunks")
    place = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    best = _positives(_joined(spans, chunks, n_spans), top, positives).withColumn("place", F.row_number().over(place))
    # in whole numbers; a negative positive_score leaves low > high
    bound = "cast(score as decimal(24,0)) * {0} / 100"
    bands = (
        best.where(F.col("place") <= positives)
        .select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(f"cast(ceil({bound.format(low)}) as long)").alias("low"), F.expr(f"cast(floor({bound.format(high)}) as long)").alias("high"))
        .where("low <= high")
    )
    of_chunk = bands.join(dealt.select(F.col("id").alias("anchor_id"), "grp"), "anchor_id").groupBy("grp").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score", "low", "high")).alias("bands"))
    asking = durable(chunks.join(of_chunk, "grp"), "asking")
    found = _negatives(_joined(spans, asking, n_spans), top, negatives)
    order = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "id")
    done = durable(
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")),
        "negatives",
    )
    discard(table, spans, chunks, asking)
    return done
