"""Controls of event studies: the nearest rows in two numbers, and random levels of like distance and width."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.passage import first_passage
from tapeloom.operators.persist import made_once
from tapeloom.operators.stats import hashed

#: Rows of a cell of the grid, and the most strips of a key (each has as many cells).
PER_CELL, STRIPS = 64, 1024


def _place(value: Column, cuts: Column) -> Column:
    """How many cuts are at most value."""
    return F.size(F.filter(cuts, lambda c: c <= value))


def _quantiles(value: str, parts: int) -> Column:
    if parts == 1:
        return F.array().cast("array<double>")
    return F.percentile_approx(value, [i / parts for i in range(1, parts)], 100 * parts)


def _every(found: str, parts: int, strips: Column) -> Column:
    """Those of parts - 1 quantiles that cut into so many strips (a divisor of parts)."""
    return F.array_distinct(F.filter(found, lambda c, i: (i + 1) % (F.lit(parts) / strips).cast("int") == 0))


def _distance() -> Column:
    """Square of the distance of the rows of asks and points beside each other."""
    return (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))


def _cells(asks: DataFrame, rows: DataFrame, key: str, reach: Column, around: int) -> DataFrame:
    """asks with each cell (strip, cell) that they reach: so far to each side, and so many cells more."""
    strips = F.sequence(_place(F.col("x") - reach, F.col("x_cuts")) - around, _place(F.col("x") + reach, F.col("x_cuts")) + around)
    at = asks.select("*", F.explode(strips).alias("strip")).join(rows, [key, "strip"])
    cells = F.sequence(_place(F.col("y") - reach, F.col("y_cuts")) - around, _place(F.col("y") + reach, F.col("y_cuts")) + around)
    return at.select("*", F.explode(cells).alias("cell")).drop("x_cuts", "y_cuts")


def nearest_controls(events: DataFrame, pool: DataFrame, key: str, n: int, per_cell: int = PER_CELL) -> DataFrame:
    """event_id, rank, control_id, distance2: the n rows of pool (all, if fewer) nearest to each event.

    events: event_id, key, x, y; pool: control_id, key, x, y. Near is the straight distance in (x, y);
    ties go to the smaller control_id. Rows without key, x or y, or with one that is not finite, take no part.

    The pool lies in strips of equal numbers by x, each cut into cells of equal numbers by y. The
    cells about an event give n rows and so a bound; then the cells within the bound are read. Of
    pool rows with the same (x, y) only the first n can be among the n nearest, so no cell grows
    with repeated values; events of the same (x, y) ask once. An event with fewer than n rows about
    it reads the whole pool of its key: this takes a pool of a few cells.
    """
    def finite(df: DataFrame) -> DataFrame:
        numbers = df.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
        return numbers.where(f"{key} is not null and abs(x) < double('Infinity') and abs(y) < double('Infinity')")

    same = Window.partitionBy(key, "x", "y").orderBy("control_id")
    kept = finite(pool).select(key, "control_id", "x", "y").withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= n).drop("_r")
    kept = made_once(kept, "pool")
    sizes = kept.groupBy(key).agg(F.count("*").alias("size"))
    largest = sizes.agg(F.max("size")).first()[0] or 1
    parts = 2 ** max(0, min(int(math.log2(STRIPS)), math.floor(math.log2(largest / per_cell) / 2)))
    wanted = F.greatest(F.lit(0.0), F.floor(F.log2(F.col("size") / per_cell) / 2).cast("double"))
    strips = F.least(F.lit(parts), F.pow(F.lit(2.0), wanted).cast("int"))
    by_x = kept.groupBy(key).agg(F.count("*").alias("size"), _quantiles("x", parts).alias("_q"))
    by_x = by_x.select(key, strips.alias("strips"), _every("_q", parts, strips).alias("x_cuts"))
    by_x = made_once(by_x, "strips")
    placed = kept.join(by_x, key).withColumn("strip", _place(F.col("x"), F.col("x_cuts"))).drop("x_cuts")
    by_y = placed.groupBy(key, "strip").agg(F.first("strips").alias("strips"), _quantiles("y", parts).alias("_q"))
    by_y = by_y.select(key, "strip", _every("_q", parts, F.col("strips")).alias("y_cuts"))
    by_y = made_once(by_y, "cells")
    points = placed.join(by_y, [key, "strip"]).select(
        key, "strip", _place(F.col("y"), F.col("y_cuts")).alias("cell"), "control_id", F.col("x").alias("px"), F.col("y").alias("py")
    )
    points = made_once(points, "points")

    rows = finite(events)
    asks = rows.select(key, "x", "y").distinct().join(by_x.drop("strips"), key)
    first = _cells(asks, by_y, key, F.lit(0.0), 1).join(points, [key, "strip", "cell"]).groupBy(key, "x", "y")
    bound = first.agg(F.array_sort(F.collect_list(_distance())).alias("d")).select(key, "x", "y", F.get("d", F.lit(n - 1)).alias("most"))
    bounded = asks.join(bound, [key, "x", "y"], "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
    reach = F.sqrt("most") * (1 + 1e-9)
    met = _cells(bounded, by_y, key, reach, 0).join(points, [key, "strip", "cell"]).withColumn("distance2", _distance())
    nearest = Window.partitionBy(key, "x", "y").orderBy("distance2", "control_id")
    ranked = met.where("distance2 <= most").withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= n)
    return rows.select("event_id", key, "x", "y").join(ranked.select(key, "x", "y", "rank", "control_id", "distance2"), [key, "x", "y"]).select(
        "event_id", "rank", "control_id", "distance2"
    )


def random_levels(zones: DataFrame, bars: DataFrame, n: int, days: int, warm: int, window: int, horizon: int, tick: float, split: float) -> DataFrame:
    """id, symbol, dir, zone, touch_idx, entry, stop, atr: n random levels a zone, touched or not.

    zones: id, symbol, dir, idx (bar of an hour at whose close they are known), entry, top, bottom. A level is drawn
    at a bar of at most so many days before or after the zone, warm bars after the series' start,
    with window and horizon before its end, and on the zone's side of the split (a share of the
    series). It lies as far from the close before it, and its stop as wide beyond it, as the zone,
    both in ATR of their time. touch_idx: the first bar within window that trades at the level, or
    null. Zones on the wrong side of the price, without ATR or without room give none.
    """
    ends = bars.groupBy("symbol").agg(F.max("idx").alias("last_idx"))
    at = zones.join(bars.select("symbol", "idx", "close", "atr"), ["symbol", "idx"]).where("atr > 0").join(F.broadcast(ends), "symbol")
    far = F.col("dir") * (F.col("close") - F.col("entry")) / F.col("atr")
    wide = (F.col("top") - F.col("bottom")) / F.col("atr")
    cut = F.floor(F.col("last_idx") * split)
    early = F.col("idx") < cut
    lo = F.greatest(F.lit(warm), F.col("idx") - 24 * days, F.when(early, 0).otherwise(cut))
    hi = F.least(F.col("last_idx") - window - horizon, F.col("idx") + 24 * days, F.when(early, cut).otherwise(F.col("last_idx")))
    room = at.select("id", "symbol", "dir", far.alias("far"), wide.alias("wide"), lo.alias("from"), hi.alias("to")).where("far >= 0 and wide > 0 and `to` > `from`")
    drawn = room.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("j"))
    drawn = drawn.withColumn("lo", F.col("from") + hashed(F.col("id"), F.col("j").cast("string"), buckets=F.col("to") - F.col("from")))
    before = bars.select("symbol", (F.col("idx") + 1).alias("lo"), F.col("close").alias("_close"), F.col("atr").alias("_atr"))
    level = F.col("_close") - F.col("dir") * F.col("far") * F.col("_atr")
    asks = (
        drawn.join(before, ["symbol", "lo"]).where("_atr > 0")
        .withColumn("entry", level)
        .withColumn("stop", F.col("entry") - F.col("dir") * F.col("wide") * F.col("_atr") - F.col("dir") * tick)
        .select(F.concat_ws("/", "id", "j").alias("id"), F.col("id").alias("zone"), "symbol", "dir", "lo", (F.col("lo") + window - 1).alias("hi"), "entry", "stop", F.col("_atr").alias("atr"))
    )
    touched = F.when(F.col("a.dir") == 1, F.col("b.low") <= F.col("a.entry")).otherwise(F.col("b.high") >= F.col("a.entry"))
    return first_passage(asks, bars.select("symbol", "idx", "high", "low"), touched, "touch_idx").drop("hi").withColumnRenamed("lo", "drawn_idx")
