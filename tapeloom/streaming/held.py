"""Minutes that wait while a repair may still complete them, with timers in keyed state.

The clock is the time of receipt.  A minute is final when the clock has passed its end by the grace
and no open gap that began before its end remains.  A gap opens when a connection is lost, ends
when it is back, and stays open until its repair comes or its deadline (so long after its end) has
passed; a repair that comes later is reported, never applied.  What a trade's own receipt finds
final is late; so results do not depend on how the rows are dealt into batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MINUTE_US = 60_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "symbol string, kind string, open_us long, open double, high double, low double, close double, n long"
_FAR = 1 << 62
#: Trades that are looked at together, at most.
TOGETHER = 20_000


class HeldMinutes(StatefulProcessor):
    """State by symbol: trades of minutes that are not final, gaps, and the last receipt."""

    def __init__(self, grace_us: int, deadline_us: int):
        self.grace, self.deadline = grace_us, deadline_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.trades = handle.getListState("trades", "us long, id long, px double")
        self.gaps = handle.getListState("gaps", "gap long, start_us long, end_us long, release_us long, repaired boolean")
        self.clock = handle.getValueState("clock", "recv_us long")

    def _load(self) -> None:
        self.held: dict[int, dict[tuple[int, int], float]] = {}
        for us, i, px in self.trades.get() if self.trades.exists() else ():
            self.held.setdefault(us // MINUTE_US * MINUTE_US, {})[us, i] = px
        self.open = {g[0]: list(g) for g in self.gaps.get()} if self.gaps.exists() else {}
        self.now = self.clock.get()[0] if self.clock.exists() else 0

    def _store(self) -> None:
        self._forget()
        rows = [(us, i, px) for own in self.held.values() for (us, i), px in own.items()]
        for state, values in ((self.trades, rows), (self.gaps, [tuple(g) for g in self.open.values()])):
            if values:
                state.put(values)
            else:
                state.clear()
        self.clock.update((self.now,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if (due := self._next_due()) is not None:
            self.handle.registerTimer(-(-due // 1000))

    def _forget(self) -> None:
        """Drop the gaps of which all minutes are final."""
        first = min((g[1] for g in self.open.values() if self._release(g) > self.now), default=_FAR)
        over = [k for k, g in self.open.items() if max(self._release(g), g[2] + MINUTE_US + self.grace) <= self.now and g[2] + MINUTE_US < first]
        for k in over:
            del self.open[k]

    def _release(self, gap: list) -> int:
        """When a gap stops holding minutes, as far as is known."""
        return gap[3] if gap[3] < _FAR else gap[2] + self.deadline if gap[2] < _FAR else _FAR

    def _final_at(self, minute: int) -> int:
        end = minute + MINUTE_US
        return max([end + self.grace, *(self._release(g) for g in self.open.values() if g[1] < end)])

    def _next_due(self) -> int | None:
        """When the first minute that waits will be final, if that is known."""
        due = self._final_at(min(self.held)) if self.held else _FAR
        return due if due < _FAR else None

    def _finish(self, symbol: str, clock: int) -> Iterator[tuple]:
        """The minutes that are final at clock; they leave the state."""
        self.now = max(self.now, clock)
        while (due := self._next_due()) is not None and due <= clock:
            minute = min(self.held)
            px = [x for _, x in sorted(self.held.pop(minute).items())]
            cut = [g for g in self.open.values() if g[1] < minute + MINUTE_US and g[2] > minute]
            kind = "DATA_GAP" if any(not g[4] for g in cut) else "REPAIRED" if cut else "OK"
            yield (symbol, kind, minute, px[0], max(px), min(px), px[-1], len(px))

    def _control(self, symbol: str, row) -> Iterator[tuple]:
        """What a row that changes the gaps does."""
        recv = int(row.recv_us)
        yield from self._finish(symbol, recv)
        gap = None if row.gap < 0 else self.open.get(int(row.gap))
        if row.kind == "LOST":
            self.open.setdefault(int(row.gap), [int(row.gap), int(row.us), _FAR, _FAR, False])
        elif row.kind == "BACK" and gap is not None:
            gap[2] = int(row.us)
        elif row.kind == "RESOLVED":
            if gap is not None and recv < gap[2] + self.deadline:
                gap[3], gap[4] = min(gap[3], recv), True
            else:
                yield (symbol, "LATE_REPAIR", int(row.gap), None, None, None, None, 0)

    def _trades(self, symbol: str, part: pd.DataFrame) -> Iterator[tuple]:
        """Trades and repairs between which no gap changes; when their minutes are final is looked up once a minute."""
        recv, us, ids, px, gaps = (part[c].to_numpy() for c in ("recv_us", "us", "trade_id", "px", "gap"))
        until = {k: g[2] + self.deadline for k, g in self.open.items() if not g[4]}
        own, at = np.unique(gaps, return_inverse=True)
        bound = np.array([min(until.get(k, 0), _FAR) for k in own.tolist()], np.int64)[at]
        taken = (part["kind"] == "TRADE").to_numpy() | (recv < bound)
        minutes, at = np.unique(us // MINUTE_US * MINUTE_US, return_inverse=True)
        late = np.array([self._final_at(m) for m in minutes.tolist()], np.int64)[at] <= recv
        for k in np.flatnonzero(taken & ~late).tolist():
            self.held.setdefault(int(minutes[at[k]]), {})[int(us[k]), int(ids[k])] = float(px[k])
        for k in np.flatnonzero(taken & late).tolist():
            yield (symbol, "LATE", int(us[k]), *[float(px[k])] * 4, 1)
        yield from self._finish(symbol, int(recv[-1]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._load()
        frame = pd.concat(list(rows)).sort_values(["recv_us", "seq"])
        changes = np.flatnonzero(frame["kind"].isin(["LOST", "BACK", "RESOLVED"]).to_numpy()).tolist()
        out, start = [], 0
        for end in [*changes, len(frame)]:
            for a in range(start, end, TOGETHER):
                out += self._trades(key[0], frame.iloc[a : min(end, a + TOGETHER)])
            if end < len(frame):
                out += self._control(key[0], frame.iloc[end])
            start = end + 1
        self._store()
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load()
        out = list(self._finish(key[0], timerValues.getCurrentWatermarkInMs() * 1000))
        self._store()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [field.split()[0] for field in OUT.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({"open_us": "int64", "n": "int64", "open": "float64", "high": "float64", "low": "float64", "close": "float64"})


def held_minutes(rows: DataFrame, grace_us: int = 2_000_000, deadline_us: int = 600_000_000) -> DataFrame:
    """Finished minutes and what came too late (symbol, kind, open_us, open, high, low, close, n).

    rows: symbol, recv (timestamp), recv_us, seq, kind, us, trade_id, px, gap (-1: none). Rows of one
    receipt go in order of seq. kind: TRADE; LOST and BACK (us is when gap began and ended); REPAIR (a
    trade that a repair of gap brings); RESOLVED (gap is repaired). Receipts never go back.
    Result kinds: OK, REPAIRED, DATA_GAP (a gap was not repaired in time), LATE (a trade of a final
    minute), LATE_REPAIR (open_us is the gap). Minutes without trades give no row; a repeated
    trade_id at one time counts once; trades of a minute still held at the end are not given out.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = rows.withWatermark("recv", "0 seconds").groupBy("symbol")
    return timed.transformWithStateInPandas(HeldMinutes(grace_us, deadline_us), OUT, "Append", "EventTime")


def control_rows(rows: DataFrame, kind: str, us: F.Column, recv_us: F.Column, seq: F.Column, gap: F.Column, trade_id: F.Column | None = None, px: F.Column | None = None) -> DataFrame:
    """rows as rows of held_minutes()."""
    recv = F.timestamp_micros(recv_us.cast("long"))
    none = F.lit(-1).cast("long")
    return rows.select(
        "symbol", recv.alias("recv"), recv_us.cast("long").alias("recv_us"), seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), us.cast("long").alias("us"),
        (none if trade_id is None else trade_id).alias("trade_id"), (F.lit(0.0) if px is None else px).alias("px"), gap.cast("long").alias("gap"),
    )
