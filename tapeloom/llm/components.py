"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.shared import discard, durable

#: Edges that one task writes, about.
EDGES_TOGETHER = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of edges (a, b); component is the least node reachable.

    Every round is one table in the shared folder; nothing but its row count and a checksum
    reaches the driver.  Steps are joins and minima, so a node with very many edges never gathers
    them in one task.  Loops and repeated edges change nothing; no edges give no rows.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    stars = durable(edges.where("a != b").select(hi.alias("hi"), lo.alias("lo")).distinct(), "edges")
    seen = None
    parts = 8 + stars.count() // EDGES_TOGETHER  # a round never adds edges
    while True:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        roots = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(roots, "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        kept = roots.select("hi", F.col("m").alias("lo"))
        after = durable(moved.unionByName(kept).distinct().coalesce(parts), "stars")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        discard(stars)
        stars = after
        if mark == seen:
            break
        seen = mark
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
