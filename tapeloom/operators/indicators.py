"""Indicators of bar series: true range, Wilder's ATR, EMA, slopes and displacement states."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series() -> Window:
    """The window of a symbol's bars in order."""
    return Window.partitionBy("symbol").orderBy("idx")


#: Bars of a series that one task looks at together.
CHUNK = 1024


def windowed(bars: DataFrame, columns: Callable[[WindowSpec], dict[str, Column]], before: int = 0, after: int = 0, chunk: int = CHUNK) -> DataFrame:
    """bars with columns(w) beside, where w is a window that reaches so many bars back and ahead.

    The series is cut into chunks by idx; a bar near a border is in both, so a task never holds the
    whole of a series.
    """
    idx = F.col("idx")
    spread = bars.withColumn("_chunk", F.explode(F.sequence(F.floor((idx - after) / chunk), F.floor((idx + before) / chunk))))
    made = spread.withColumns(columns(Window.partitionBy("symbol", "_chunk").orderBy("idx")))
    return made.where(F.floor(idx / chunk) == F.col("_chunk")).drop("_chunk")


def running_last(bars: DataFrame, values: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """bars with the last value that is not null up to each bar; what a chunk ends with is carried on
    from one row a chunk."""
    cut = bars.withColumns({f"_{n}": v for n, v in values.items()}).withColumn("_chunk", F.floor(F.col("idx") / chunk))
    inside = Window.partitionBy("symbol", "_chunk").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("symbol").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = {n: F.max(F.when(F.col(f"_{n}").isNotNull(), F.struct("idx", F.col(f"_{n}").alias("v")))) for n in values}
    ends = cut.groupBy("symbol", "_chunk").agg(*(c.alias(f"_end_{n}") for n, c in last.items()))
    carried = ends.select("symbol", "_chunk", *(F.last(f"_end_{n}", True).over(earlier).getField("v").alias(f"_end_{n}") for n in values))
    made = cut.withColumns({f"_{n}": F.last(f"_{n}", True).over(inside) for n in values}).join(carried, ["symbol", "_chunk"])
    return made.withColumns({n: F.coalesce(f"_{n}", f"_end_{n}") for n in values}).drop("_chunk", *(f"_{n}" for n in values), *(f"_end_{n}" for n in values))


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    spread = F.col("high") - F.col("low")
    return F.when(before.isNull(), spread).otherwise(F.greatest(spread, F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def smoothed(rows: DataFrame, value: str, name: str, length: int, keep: float, add: float, divide: float = 1.0, chunk: int = CHUNK) -> DataFrame:
    """rows with the recursive mean s = (s * keep + value * add) / divide by symbol, started at bar
    length-1 by the mean of the first length values and null before.  rows are numbered by idx from 0.

    Each step is an affine map of the mean before it.  A chunk of bars is folded to one such map, the
    maps of a symbol's chunks (one row each) are applied one after the other, which gives the mean at
    each chunk's beginning, and from there the chunks run by themselves.
    """

    def step(state: float, v: float) -> float:
        return (state * keep + v * add) / divide

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        shift, n = 0.0, 0
        for i, v in zip(frame["idx"].tolist(), frame[value].tolist(), strict=True):
            if i >= length:
                shift, n = step(shift, v), n + 1
        early = frame.loc[frame["idx"] < length, value].sum()
        return pd.DataFrame([(frame["symbol"].iloc[0], frame["_chunk"].iloc[0], (keep / divide) ** n, shift, float(early), bool((frame["idx"] == length - 1).any()))])

    def scan(maps: pd.DataFrame) -> pd.DataFrame:
        out, state, total = [], None, 0.0
        for symbol, at, scale, shift, early, seeds in maps.sort_values("_chunk").itertuples(index=False):
            out.append((symbol, at, state, total))
            total += early
            start = total / length if seeds else state
            state = None if start is None else start * scale + shift
        return pd.DataFrame(out, columns=["symbol", "_chunk", "_state", "_total"]).astype({"_state": float})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("idx")
        state, total = frame["_state"].iloc[0], frame["_total"].iloc[0]
        out: list[float | None] = []
        for i, v in zip(frame["idx"].tolist(), frame[value].tolist(), strict=True):
            if i < length:
                total += v
                state = total / length if i == length - 1 else None
            else:
                state = step(state, v)
            out.append(state)
        frame[name] = pd.Series(out, index=frame.index, dtype=float)
        return frame.drop(columns=["_chunk", "_state", "_total"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    cut = rows.withColumn("_chunk", F.floor(F.col("idx") / chunk))
    names = ["symbol", "_chunk"]
    maps = cut.select(*names, "idx", value).groupBy(*names).applyInPandas(fold, "symbol string, _chunk long, scale double, shift double, early double, seeds boolean")
    begins = maps.groupBy("symbol").applyInPandas(scan, "symbol string, _chunk long, _state double, _total double")
    schema = ", ".join(f"`{n}` {t}" for n, t in kinds.items()) + f", `{name}` double"
    return cut.join(begins, names).groupBy(*names).applyInPandas(run, schema)


def with_atr(bars: DataFrame, length: int = 14) -> DataFrame:
    """bars with tr and atr: the mean true range, then (atr * (n - 1) + tr) / n."""
    ranged = windowed(bars, lambda w: {"tr": true_range(w)}, before=1)
    return smoothed(ranged, "tr", "atr", length, length - 1, 1.0, length)


def with_ema(bars: DataFrame, length: int, name: str = "ema") -> DataFrame:
    """bars with an exponential mean of close, alpha 2 / (n + 1), started by a plain mean."""
    alpha = 2.0 / (length + 1)
    return smoothed(bars, "close", name, length, 1 - alpha, alpha)


def with_slope(rows: DataFrame, value: str, over: int, name: str = "slope") -> DataFrame:
    """rows with the sign of the change of value over so many bars; 0 where it is unknown."""
    sign = lambda w: F.coalesce(F.signum(F.col(value) - F.lag(value, over).over(w)), F.lit(0.0)).cast("int")
    return windowed(rows, lambda w: {name: sign(w)}, before=over)


def with_displacement(bars: DataFrame, name: str = "state") -> DataFrame:
    """bars with 1 or -1 since the last close beyond the former bar's high + ATR or low - ATR; 0 before."""

    def own(w: WindowSpec) -> Column:
        high, low, atr = (F.lag(c).over(w) for c in ("high", "low", "atr"))
        return F.when(F.col("close") > high + atr, 1).when(F.col("close") < low - atr, -1)

    moved = windowed(bars, lambda w: {"_moved": own(w)}, before=1)
    return running_last(moved, {name: F.col("_moved")}).drop("_moved").withColumn(name, F.coalesce(name, F.lit(0)))
