"""Open orders that advance with a stream of bars: state holds each order's phase, never its past bars.

A batch reads its own rows only; an order that has ended leaves the state.  Bars that come again
(their index was seen) change nothing, so a stream resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.streaming.held import ROCKS

OUT = "id string, symbol string, kind string, idx long, state string, known_idx long"
ROW = "symbol string, kind string, idx long, high double, low double, id string, dir int, entry double, stop double, target double"
_ORDER = "id string, dir int, created_idx long, entry double, stop double, target double, filled_idx long"


class Orders(StatefulProcessor):
    """State by symbol: the orders that have not ended, and the last bar."""

    def __init__(self, hold: int, expiry: int, fresh: int):
        self.hold, self.expiry, self.fresh = hold, expiry, fresh

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.orders = handle.getListState("orders", _ORDER)
        self.last = handle.getValueState("last", "idx long")

    def _life(self, order: tuple, idx: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[int, int | None, str | None]:
        """(filled_idx or -1, end, state) after the bars given; end and state are None while it runs."""
        _, side, created, entry, stop, target, filled = order
        from_ = int(np.searchsorted(idx, created if filled < 0 else filled + 1))
        idx, high, low = idx[from_:], high[from_:], low[from_:]
        at_stop = low <= stop if side == 1 else high >= stop
        at_target = high >= target if side == 1 else low <= target
        begin = 0
        if filled < 0:
            at_entry = low <= entry if side == 1 else high >= entry
            over = idx >= created + self.expiry
            first = np.flatnonzero(at_entry | at_target | over)
            if not len(first):
                return -1, None, None
            k = int(first[0])
            if not at_entry[k]:
                return -1, int(idx[k]), "MISSED" if at_target[k] else "EXPIRED"
            filled, begin = int(idx[k]), k + 1
            if at_stop[k]:
                return filled, filled, "SL"
        late = idx[begin:] >= filled + self.hold
        first = np.flatnonzero(at_stop[begin:] | at_target[begin:] | late)
        if not len(first):
            return filled, None, None
        k = begin + int(first[0])
        return filled, int(idx[k]), "SL" if at_stop[k] else "TP" if at_target[k] else "TIMEOUT"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        seen = self.last.get()[0] if self.last.exists() else -1
        orders = [tuple(o) for o in self.orders.get()] if self.orders.exists() else []
        known = {o[0] for o in orders}
        bars = frame[(frame.kind == "BAR") & (frame.idx > seen)].drop_duplicates("idx").sort_values("idx")
        idx, high, low = (bars[c].to_numpy() for c in ("idx", "high", "low"))
        last = int(idx[-1]) if len(idx) else seen
        out, left = [], []
        for o in frame[frame.kind == "ORDER"].drop_duplicates("id").itertuples():
            if o.id in known:
                continue
            if int(o.idx) <= seen:  # its first bars are gone
                out.append((o.id, key[0], "LATE", int(o.idx), "LATE", last))
                continue
            orders.append((o.id, int(o.dir), int(o.idx), o.entry, o.stop, o.target, -1))
            out.append((o.id, key[0], "CREATED" if last - int(o.idx) <= self.fresh else "STALE", int(o.idx), "PENDING", last))
        for order in orders:
            filled, end, state = self._life(order, idx, high, low)
            if filled >= 0 and order[6] < 0:
                out.append((order[0], key[0], "FILLED", filled, "OPEN", last))
            if end is None:
                left.append((*order[:6], filled))
            else:
                out.append((order[0], key[0], "ENDED", end, state, last))
        if left:
            self.orders.put(left)
        else:
            self.orders.clear()
        self.last.update((last,))
        yield pd.DataFrame(out, columns=[field.split()[0] for field in OUT.split(", ")]).astype({"idx": "int64", "known_idx": "int64"})

    def close(self) -> None:
        pass


def advanced_orders(rows: DataFrame, hold: int, expiry: int, fresh: int = 1 << 40) -> DataFrame:
    """Events of orders (id, symbol, kind, idx, state, known_idx) over a stream of bars and orders.

    rows: ROW. kind BAR (idx, high, low) or ORDER (idx is the bar from which it stands). kinds of
    events: CREATED, or STALE for an order that began over ``fresh`` bars before the last known one;
    LATE, an order whose first bar was seen before (it is not followed); FILLED; ENDED with the state
    that race() gives. known_idx: the last bar known when the event was given out. An order that
    comes again while it runs changes nothing.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy("symbol").transformWithStateInPandas(Orders(hold, expiry, fresh), OUT, "Append", "None")


def order_states(events: DataFrame) -> DataFrame:
    """id, filled_idx, exit_idx, state of each order after the events so far; repeated ones count once."""
    return events.groupBy("id").agg(
        F.max(F.when(F.col("kind") == "FILLED", F.col("idx"))).alias("filled_idx"),
        F.max(F.when(F.col("kind") == "ENDED", F.col("idx"))).alias("exit_idx"),
        F.coalesce(F.max(F.when(F.col("kind") == "ENDED", F.col("state"))), F.max(F.when(F.col("kind") == "FILLED", F.lit("OPEN"))), F.lit("PENDING")).alias("state"),
    )
