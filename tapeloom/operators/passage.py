"""First passage: the first later bar that fulfils a condition, within a bounded horizon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bars of a block; a search joins the blocks that its horizon touches.
BLOCK = 64


def first_passage(asks: DataFrame, bars: DataFrame, condition: Column, name: str, block: int = BLOCK, extra: dict[str, Column] | None = None) -> DataFrame:
    """asks with the idx of the first bar that fulfils condition, or null.

    asks has id, symbol, lo and hi (first and last idx searched); bars has symbol and idx.
    Columns of asks are named a.*, those of bars b.* in condition. The join's keys are symbol and
    block of bars, so it is an equi-join whose size is the sum of the horizons. extra: more
    columns taken from the bar that is found.
    """
    extra = extra or {}
    blocked = bars.withColumn("_block", F.floor(F.col("idx") / block))
    spread = asks.where("hi >= lo").select(
        "*", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))).alias("_block")
    )
    a, b = spread.alias("a"), blocked.alias("b")
    met = a.join(b, (F.col("a.symbol") == F.col("b.symbol")) & (F.col("a._block") == F.col("b._block")))
    met = met.where((F.col("b.idx") >= F.col("a.lo")) & (F.col("b.idx") <= F.col("a.hi")) & condition)
    first = met.groupBy(F.col("a.id").alias("id")).agg(
        F.min("b.idx").alias(name), *(F.min_by(c, F.col("b.idx")).alias(k) for k, c in extra.items())
    )
    return asks.join(first, "id", "left")


def spans(asks: DataFrame, bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each ask (symbol, lo, hi) beside every row of bars (symbol, idx) with lo <= idx <= hi.

    Joined on symbol and block like first_passage, so the result is as large as the spans are long.
    Other columns of asks and bars must not share names; asks with hi < lo give no rows.
    """
    spread = asks.where("hi >= lo").select(
        "*", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))).alias("_block")
    )
    blocked = bars.withColumn("_block", F.floor(F.col("idx") / block))
    return spread.join(blocked, ["symbol", "_block"]).where(F.col("idx").between(F.col("lo"), F.col("hi"))).drop("_block")
