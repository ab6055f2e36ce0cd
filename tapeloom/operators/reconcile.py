"""Persistence semantics on tables: idempotent inserts, audited revisions, matching of two feeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to append: those whose keys target has not, one a key."""
    return rows.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys)


def latest(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row a key: the last by order."""
    own = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(*keys).agg(F.max_by(own, F.struct(*order)).alias("_r")).select("_r.*")


def reconcile(stored: DataFrame, fresh: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys, action, revision, old and new values as JSON, for every key of either side.

    INSERTED: only in fresh; UNCHANGED: equal; REVISED: revision + 1, both versions kept; KEPT:
    only in stored. stored has a revision.
    """
    s = stored.select(*keys, "revision", F.struct(*values).alias("old"))
    f = fresh.select(*keys, F.struct(*values).alias("new"))
    both = s.join(f, keys, "full_outer")
    action = (
        F.when(F.col("old").isNull(), "INSERTED").when(F.col("new").isNull(), "KEPT")
        .when(F.col("old").eqNullSafe(F.col("new")), "UNCHANGED").otherwise("REVISED")
    )
    revision = F.when(action == "INSERTED", 0).when(action == "REVISED", F.col("revision") + 1).otherwise(F.col("revision"))
    return both.select(*keys, action.alias("action"), revision.alias("revision"), F.to_json("old").alias("old"), F.to_json("new").alias("new"))


def compare(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key: only_left, only_right, and whether each value differs."""
    one = left.select(*keys, F.lit(True).alias("_l"), *(F.col(v).alias(f"l_{v}") for v in values))
    two = right.select(*keys, F.lit(True).alias("_r"), *(F.col(v).alias(f"r_{v}") for v in values))
    both = one.join(two, keys, "full_outer")
    matched = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.select(
        *keys, F.col("_r").isNull().alias("only_left"), F.col("_l").isNull().alias("only_right"),
        *((matched & ~F.col(f"l_{v}").eqNullSafe(F.col(f"r_{v}"))).alias(f"{v}_differs") for v in values),
    )


#: Seconds of a key's series that one task looks at when parts are cut.
CHUNK = 4 * 86400


def parts_of(left: DataFrame, right: DataFrame, keys: list[str], early: float, late: float) -> DataFrame:
    """Rows of both feeds (side 0 and 1) in parts (_part) of a key that no admissible pair crosses: one
    whose right row comes at most early seconds before or late seconds after its left row.

    The last row before and the next row after are running values in either direction, inside chunks
    of time; one row a chunk is looked at over a key.
    """
    both = left.select(*keys, "id", "t", F.lit(0).alias("side")).unionByName(right.select(*keys, "id", "t", F.lit(1).alias("side")))
    both = both.withColumn("_chunk", F.floor(F.col("t") / CHUNK))
    of = lambda side: F.when(F.col("side") == side, F.col("t"))
    sides = (0, 1)
    ends = both.groupBy(*keys, "_chunk").agg(*(f(of(k)).alias(f"_{n}{k}") for k in sides for n, f in (("min", F.min), ("max", F.max))))
    chunks = Window.partitionBy(*keys)
    earlier = chunks.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = chunks.orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_chunk").alias("_at"),
        *(F.max(f"_max{k}").over(earlier).alias(f"_before{k}") for k in sides), *(F.min(f"_min{k}").over(later).alias(f"_after{k}") for k in sides),
    )
    own = Window.partitionBy(*keys, "_chunk")
    past = own.orderBy("t", "side", "id").rowsBetween(Window.unboundedPreceding, -1)
    future = own.orderBy(F.desc("t"), F.desc("side"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    near = both.select("*", *(F.max(of(k)).over(past).alias(f"_last{k}") for k in sides)).select("*", *(F.min(of(k)).over(future).alias(f"_next{k}") for k in sides))
    same = F.col("_chunk").eqNullSafe(F.col("_at"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    near = near.join(ends, same)
    following = lambda side: F.coalesce(f"_next{side}", f"_after{side}")
    previous = lambda side: F.coalesce(f"_last{side}", f"_before{side}")
    crossed = F.coalesce(following(1) - previous(0) <= late, F.lit(False)) | F.coalesce(following(0) - previous(1) <= early, F.lit(False))
    cut = near.select(*both.columns, (~crossed).cast("int").alias("_cut"))
    # parts are numbered inside a chunk; what goes over its start has the last number of a chunk before
    number = F.struct(F.col("_chunk").alias("c"), F.sum("_cut").over(own.orderBy("t", "side", "id").rowsBetween(Window.unboundedPreceding, 0)).alias("n"))
    inside = cut.withColumn("_number", number)
    tops = cut.groupBy(*keys, "_chunk").agg(F.sum("_cut").alias("n")).withColumn("_top", F.when(F.col("n") > 0, F.struct(F.col("_chunk").alias("c"), "n")))
    carried = tops.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_chunk").alias("_at"), F.last("_top", True).over(earlier).alias("_carried"))
    part = F.when(F.col("_number.n") > 0, F.col("_number")).otherwise(F.col("_carried"))
    return inside.join(carried, same).withColumn("_part", part).select(*keys, "id", "t", "side", "_part")


def _by_part(parts: DataFrame, keys: list[str], match: Callable, early: float, late: float) -> DataFrame:
    """(left_id, right_id) of match(t of left, t of right, ids of right), which gives pairs of places
    in a part of parts_of(); both are in order of (t, id).

    Parts come one after the other, many in a batch; those that have rows of one side only are left out.
    Parts of two rows, a pair if that is admissible, are looked at all together.
    """
    own = Window.partitionBy(*keys, "_part").orderBy("side", "t", "id")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select("side", "id", "t", (F.row_number().over(own) == 1).alias("first"), (F.min("side").over(every) != F.max("side").over(every)).alias("_two"))

    def pairs(frames: list[pd.DataFrame]) -> pd.DataFrame:
        side, ids, t, first = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("side", "id", "t", "first"))
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(ids))
        middles = ends - np.add.reduceat(side, starts)
        two = ends - starts == 2
        a = starts[two]
        a = a[(t[a + 1] >= t[a] - early) & (t[a + 1] <= t[a] + late)]
        out: tuple[list, list] = (ids[a].tolist(), ids[a + 1].tolist())
        for a, m, z in zip(starts[~two].tolist(), middles[~two].tolist(), ends[~two].tolist(), strict=True):
            for i, j in match(t[a:m], t[m:z], ids[m:z]):
                out[0].append(ids[a + i])
                out[1].append(ids[m + j])
        return pd.DataFrame({n: np.array(c, "int64") for n, c in zip(("left_id", "right_id"), out, strict=True)})

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            starts = np.flatnonzero(frame["first"].to_numpy())
            if len(starts):  # all before the last start is whole
                held.append(frame.iloc[: starts[-1]])
                if sum(map(len, held)):
                    yield pairs(held)
                held = []
                frame = frame.iloc[starts[-1] :]
            held.append(frame)
        if sum(map(len, held)):
            yield pairs(held)

    return parts.where("_two").select("side", "id", "t", "first").mapInPandas(work, "left_id long, right_id long")


def _bands(ta: np.ndarray, tb: np.ndarray, early: float, late: float) -> tuple[list[int], list[int]]:
    """Where the admissible rows of tb begin and end for each of ta; both are in order."""
    return np.searchsorted(tb, ta - early, "left").tolist(), np.searchsorted(tb, ta + late, "right").tolist()


def _free(of: list[int], k: int) -> int:
    """The first place from k on that is its own; places on the way are led past each other."""
    while of[k] != k:
        of[k] = of[of[k]]
        k = of[k]
    return k


def nearest_matches(left: DataFrame, right: DataFrame, keys: list[str], within: float) -> DataFrame:
    """(left_id, right_id): each left row in order of time takes the nearest right row of its key
    that is at most within seconds apart and not taken yet (ties: the smaller id). Both have id and
    t (seconds).

    Groups are cut where no pair within the bound crosses. The next free row in either direction is
    found over rows that were taken before, so the work doesn't grow with how dense the rows are.
    """

    def match(ta: np.ndarray, tb: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        n = len(tb)
        # backwards, of equal times the smaller id comes first too
        back = np.lexsort((-ids, tb))
        place = np.empty(n, int)
        place[back] = np.arange(n)
        back, place, time, name = back.tolist(), place.tolist(), tb.tolist(), ids.tolist()
        ahead = list(range(n + 1))
        behind = list(range(n + 1))  # by one more than the place in back; 0: none
        lows, highs = _bands(ta, tb, within, within)
        at = np.searchsorted(tb, ta, "left").tolist()
        for i, t in enumerate(ta.tolist()):
            up, down = _free(ahead, at[i]), _free(behind, at[i])
            found = [(abs(time[j] - t), name[j], j) for j in ((up,) if up < highs[i] else ()) + ((back[down - 1],) if down > lows[i] else ())]
            if found:
                j = min(found)[2]
                ahead[j] = j + 1
                behind[place[j] + 1] = place[j]
                yield i, j

    return _by_part(parts_of(left, right, keys, within, within), keys, match, within, within)


def aligned(left: DataFrame, right: DataFrame, keys: list[str], early: float, late: float) -> DataFrame:
    """(left_id, right_id): the longest order-keeping alignment of two feeds by key, with the least
    total time difference, where right may come early seconds before or late seconds after left.

    An alignment is a chain of admissible pairs that rises on both sides. Left rows are added one by
    one; best chains are held for the right rows of the band only, and of each admissible pair two
    bits are kept, from which the chain is read back.
    """
    return aligned_parts(parts_of(left, right, keys, early, late), keys, early, late)


def aligned_parts(parts: DataFrame, keys: list[str], early: float, late: float) -> DataFrame:
    """aligned() of whole parts of parts_of()."""

    def match(ta: np.ndarray, tb: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
        lows, highs = _bands(ta, tb, early, late)
        base = 0
        n, gain = np.zeros(1, np.int64), np.zeros(1)  # of the best chain within the first base, base + 1, .. right rows
        bits: list[bytes] = []
        for i, (low, high) in enumerate(zip(lows, highs, strict=True)):
            if low >= high:
                bits.append(b"")
                continue
            fall = min(low, base + len(n) - 1) - base
            n, gain = (np.append(x[fall:], np.full(high + 1 - low - len(x) + fall, x[-1])) for x in (n, gain))
            base = low
            more, cost = n[:-1] + 1, gain[:-1] - np.abs(tb[low:high] - ta[i])
            order = np.lexsort((cost, more))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.append(0, np.cumsum((np.diff(more[order]) != 0) | (np.diff(cost[order]) != 0)))
            most = np.maximum.accumulate(rank)
            own = np.append(True, rank[1:] > most[:-1])
            best = np.maximum.accumulate(np.where(own, np.arange(len(rank)), 0))
            more, cost = more[best], cost[best]
            take = (more > n[1:]) | ((more == n[1:]) & (cost >= gain[1:]))
            n, gain = np.append(n[0], np.where(take, more, n[1:])), np.append(gain[0], np.where(take, cost, gain[1:]))
            bits.append(np.packbits(np.append(take, own)).tobytes())
        out, k = [], len(tb)
        for i in range(len(ta) - 1, -1, -1):
            low, high = lows[i], highs[i]
            k = min(k, high)
            if k <= low:
                continue
            flags = np.unpackbits(np.frombuffer(bits[i], np.uint8), count=2 * (high - low))
            if flags[k - 1 - low]:
                k = low + int(np.flatnonzero(flags[high - low :][: k - low])[-1])
                out.append((i, k))
        return out

    return _by_part(parts, keys, match, early, late)
