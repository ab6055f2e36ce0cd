"""Time grids: lengths of timeframes, bucket starts, and rounding to a tick."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a timeframe, and the seconds by which its buckets are shifted on the half-hour grid.
SECONDS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
HALF_HOUR = {"1m": 0, "5m": 0, "15m": 0, "1h": 1800, "4h": 1800, "1d": 0}


def bucket(time: str | Column, tf: str, grid: str = "utc") -> Column:
    """Start of the bucket of a timeframe; grid "tehran" opens 1h and 4h buckets at hh:30 UTC."""
    shift = HALF_HOUR[tf] if grid == "tehran" else 0
    return F.window(time, f"{SECONDS[tf]} seconds", f"{SECONDS[tf]} seconds", f"{shift} seconds")["start"]


def seconds(time: str | Column) -> Column:
    """Epoch seconds of a timestamp without time zone, as if in UTC."""
    time = F.col(time) if isinstance(time, str) else time
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), time)


def later(time: str | Column, n: int | str) -> Column:
    """time plus n seconds; n may be SQL."""
    name = time if isinstance(time, str) else None
    return F.expr(f"timestampadd(SECOND, {n}, {name})") if name else F.timestamp_add("SECOND", F.lit(n), time)


def floor_tick(value: Column, tick: float) -> Column:
    return F.floor(value / tick + 1e-9) * tick


def ceil_tick(value: Column, tick: float) -> Column:
    return F.ceil(value / tick - 1e-9) * tick
