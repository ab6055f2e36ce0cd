"""Exact repair of gaps in a live feed from windows of a second source that has its own clock.

A window is what the second source listed when it was asked.  A gap is repaired only if the trades
that are put in could stand nowhere else; whatever is uncertain fails with a code.  Times are
microseconds; a trade's window time lies delta_min to delta_max after its live time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.persist import made_once
from tapeloom.operators.reconcile import nearest_matches

MINUTE_US = 60_000_000
#: The codes, in the order in which they are looked for.
CODES = (
    "NO_REST_TRADES", "FETCHED_TOO_EARLY", "REST_WINDOW_TOO_SHORT", "TIME_MODEL_VIOLATION",
    "AMBIGUOUS_MINUTE", "AMBIGUOUS_OPEN", "AMBIGUOUS_CLOSE", "REPAIRED",
)


def _minute(us: Column) -> Column:
    return F.floor(us / MINUTE_US)


def _candidates(shown: DataFrame, live: DataFrame, within: int) -> DataFrame:
    """gap_id, id, us, price, qty of the live trades that a gap's window rows can take.

    A window row takes one of the n nearest live trades of its price and quantity within ``within``
    (ties: the smaller id), n being the rows of its gap of that price and quantity: others have taken
    fewer. They are looked for in cells of time, so a gap has no copy of all trades around it.
    """
    width = max(MINUTE_US, 2 * within)
    same = Window.partitionBy("gap_id", "price", "qty")
    keys = ["symbol", "price", "qty", "_cell"]
    asks = shown.select("symbol", "gap_id", "price", "qty", F.col("created_us").alias("us"), F.count("*").over(same).alias("n"), F.floor(F.col("created_us") / width).alias("_cell"))
    cells = F.array_distinct(F.transform(F.array(F.lit(-within), F.lit(0), F.lit(within)), lambda x: F.floor((F.col("us") + x) / width)))
    own = live.select("symbol", "price", "qty", "id", "us", F.explode(cells).alias("_cell"))

    names = ["gap_id", "id", "us", "price", "qty"]

    def look(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(known):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in names})
        us, ids = known["us"].to_numpy(), known["id"].to_numpy()
        ahead, back = np.lexsort((ids, us)), np.lexsort((-ids, us))  # from a time on, the smaller id of equal times comes first in both
        times = us[ahead]
        t, n = asked["us"].to_numpy(), asked["n"].to_numpy()
        low, at, high = (np.searchsorted(times, x, side) for x, side in ((t - within, "left"), (t, "left"), (t + within, "right")))
        up, down = np.minimum(high - at, n), np.minimum(at - low, n)

        def places(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            of = np.repeat(np.arange(len(count)), count)
            return of, np.repeat(start - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())

        of_up, k_up = places(at, up)
        of_down, k_down = places(at - down, down)
        of, k = np.append(of_up, of_down), np.append(ahead[k_up], back[k_down])
        order = np.lexsort((ids[k], np.abs(us[k] - t[of]), of))
        of, k = of[order], k[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of, "left")
        of, k = of[rank < n[of]], k[rank < n[of]]
        own = {"gap_id": pd.Series(asked["gap_id"].to_numpy(object)[of], dtype=object)} | {c: asked[c].to_numpy()[of] for c in ("price", "qty")}
        return pd.DataFrame(own | {"id": ids[k], "us": us[k]})[names]

    kinds = dict(shown.dtypes)
    schema = f"gap_id {kinds['gap_id']}, id long, us long, price {kinds['price']}, qty {kinds['qty']}"
    return asks.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInPandas(look, schema).distinct()


def _ends(live: DataFrame) -> DataFrame:
    """symbol, minute, and the first and the last time of its live trades with the least and the largest price at each."""
    at = live.groupBy("symbol", _minute(F.col("us")).alias("minute"), "us").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    return at.groupBy("symbol", "minute").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), *(f(F.struct("low", "high"), "us").alias(n) for f, n in ((F.min_by, "first"), (F.max_by, "last")))
    )


def repaired(gaps: DataFrame, windows: DataFrame, live: DataFrame, delta_min: int, delta_max: int, within: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(decisions, trades): one row a gap, and the trades that repaired gaps get.

    gaps: gap_id, symbol, start_us, end_us, fetched_us (when its window was asked for). windows:
    gap_id, id, created_us, price, qty. live: symbol, id, us, price, qty.
    decisions: gap_id, code, matched, low_us, high_us (the smallest and largest clock difference of
    its matches), recovered. trades: gap_id, id, us, price, qty, copy (1, 2, .. of equal ones); us is
    the middle of where the trade may stand.

    A window row takes the nearest live trade of equal price and quantity within ``within``, in order
    of time, each once; a difference outside the bounds means that the clocks are not what they
    should be. Rows without a match are the missing trades. A row that is looked at may always stand
    in the gap; each must fall into one minute, and no minute's first or last price may depend on
    where exactly it stands. ids are unique over all windows, and over all live trades.

    A gap's work is its own window and as many live trades a row as may be taken; of a minute's live
    trades its first and last are found once for all gaps. A gap without a window is a gap all the same; empty tables give none.
    """
    gaps = gaps.select("gap_id", "symbol", "start_us", "end_us", "fetched_us")
    rest = made_once(windows.join(gaps, "gap_id"), "windows")
    bounds = rest.groupBy("gap_id").agg(F.min("created_us").alias("oldest"))
    inside = (F.col("created_us") >= F.col("start_us") + delta_min) & (F.col("created_us") < F.col("end_us") + delta_max)
    shown = rest.where(inside)
    keys = ["gap_id", "price", "qty"]
    near = made_once(_candidates(shown, live, within), "near")
    met = nearest_matches(
        shown.select(*keys, "id", F.col("created_us").cast("double").alias("t")), near.select(*keys, "id", F.col("us").cast("double").alias("t")), keys, float(within)
    )
    met = made_once(met, "met")
    offsets = (
        shown.select("gap_id", F.col("id").alias("left_id"), "created_us").join(met, "left_id")
        .join(near.select("gap_id", F.col("id").alias("right_id"), "us"), ["gap_id", "right_id"])
        .groupBy("gap_id").agg(F.count("*").alias("matched"), F.min(F.col("created_us") - F.col("us")).alias("low_us"), F.max(F.col("created_us") - F.col("us")).alias("high_us"))
    )
    lo = F.greatest(F.col("created_us") - delta_max, F.col("start_us"))
    hi = F.least(F.col("created_us") - delta_min, F.col("end_us") - 1)
    missing = shown.join(met.select(F.col("left_id").alias("id")), "id", "left_anti").withColumn("lo", lo).withColumn("hi", hi)
    missing = made_once(missing.withColumn("minute", _minute(F.col("lo"))), "missing")
    misplaced = F.when(F.col("minute") != _minute(F.col("hi")), "AMBIGUOUS_MINUTE")
    places = missing.withColumn("why", misplaced).where("why is not null").groupBy("gap_id").agg(F.min_by("why", F.struct("created_us", "id")).alias("place"))
    touched = missing.select("gap_id", "symbol", "minute").distinct()
    # of live trades only those at the first and the last time of a minute can be its ends
    known = touched.join(_ends(live), ["symbol", "minute"]).select("gap_id", "minute", F.explode(F.array(
        *(F.struct(F.col(f"{n}_us").alias("us"), F.col(f"{n}.{p}").alias("price")) for n in ("first", "last") for p in ("low", "high"))
    )).alias("_t")).select("gap_id", "minute", "_t.us", "_t.price")
    spans = known.select("gap_id", "minute", F.col("us").alias("lo"), F.col("us").alias("hi"), "price").unionByName(missing.select("gap_id", "minute", "lo", "hi", "price"))
    own = Window.partitionBy("gap_id", "minute")
    spans = spans.withColumn("_first", F.min("hi").over(own)).withColumn("_last", F.max("lo").over(own))
    firsts, lasts = F.when(F.col("lo") <= F.col("_first"), F.col("price")), F.when(F.col("hi") >= F.col("_last"), F.col("price"))
    ends = spans.groupBy("gap_id", "minute").agg((F.min(firsts) < F.max(firsts)).alias("open"), (F.min(lasts) < F.max(lasts)).alias("close"))
    ends = ends.where("open or close").groupBy("gap_id").agg(F.min_by(F.when(F.col("open"), "AMBIGUOUS_OPEN").otherwise("AMBIGUOUS_CLOSE"), "minute").alias("end"))
    found = gaps.join(bounds, "gap_id", "left").join(offsets, "gap_id", "left").join(places, "gap_id", "left").join(ends, "gap_id", "left")
    recovered = missing.groupBy("gap_id").agg(F.count("*").alias("n"))
    code = (
        F.when(F.col("oldest").isNull(), CODES[0])
        .when(F.col("fetched_us") < F.col("end_us") + delta_max, CODES[1])
        .when(F.col("oldest") >= F.col("start_us"), CODES[2])
        .when((F.col("low_us") < delta_min) | (F.col("high_us") > delta_max), CODES[3])
        .otherwise(F.coalesce("place", "end", F.lit("REPAIRED")))
    )
    decided = found.join(recovered, "gap_id", "left").withColumn("code", code)
    fits = F.col("code") == "REPAIRED"
    decisions = made_once(
        decided.select("gap_id", "code", F.coalesce("matched", F.lit(0)).alias("matched"), "low_us", "high_us", F.when(fits, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("recovered")),
        "decisions",
    )
    copies = Window.partitionBy("gap_id", "created_us", "price", "qty").orderBy("id")
    trades = missing.join(decisions.where(fits).select("gap_id"), "gap_id", "left_semi").select(
        "gap_id", "id", F.floor((F.col("lo") + F.col("hi")) / 2).alias("us"), "price", "qty", F.row_number().over(copies).alias("copy")
    )
    return decisions, trades
