"""Exact token counts: a histogram of encoded lengths with suffix sums.

One row a distinct length answers, for every context limit, how many documents reach it, how
many tokens they hold and how many tokens remain if all documents are cut there.

Cases: a null or empty text has length 0 and is counted; an empty table gives an empty
histogram; repeated rows count as often as they occur; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.shared import byte_slices, durable
from tapeloom.llm.tokenize import SLICE_BYTES, encoder

#: Lengths that share a band of the suffix sums.
BAND = 4096


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): exact numbers of documents by encoded length."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        held: dict[int, int] = {}
        for part in byte_slices(batches, "text", SLICE_BYTES):
            _, offsets = enc.encode(part.column("text"))
            sizes, n = np.unique(np.diff(offsets), return_counts=True)
            for size, k in zip(sizes.tolist(), n.tolist(), strict=True):
                held[size] = held.get(size, 0) + k
        yield pa.RecordBatch.from_pydict(
            {"n_tokens": pa.array(held.keys(), pa.int64()), "n_docs": pa.array(held.values(), pa.int64())}
        )

    return (
        docs.select(F.col(text).cast("string").alias("text"))
        .mapInArrow(counts, "n_tokens long, n_docs long")
        .groupBy("n_tokens")
        .agg(F.sum("n_docs").alias("n_docs"))
    )


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, for each of its lengths taken as a context limit:

    docs_at_least, tokens_at_least: documents of that length or more, and their tokens;
    tokens_truncated: all tokens left if every document is cut to the limit;
    share_at_most: share of documents not longer than it.
    Sums run inside bands of lengths and once over the bands, so no task needs all lengths; the
    histogram is made once.
    """
    histogram = durable(histogram, "histogram")
    banded = histogram.withColumn("band", F.expr(f"n_tokens div {BAND}"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    bands = banded.groupBy("band").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    later = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    bands = bands.select(
        "band",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(whole).alias("d_all"),
        F.sum("t").over(whole).alias("t_all"),
    )
    inside = Window.partitionBy("band").orderBy(F.desc("n_tokens"))
    return (
        banded.withColumn("d_in", F.sum("n_docs").over(inside))
        .withColumn("t_in", F.sum(tokens).over(inside))
        .join(bands, "band")
        .select(
            "n_tokens",
            "n_docs",
            (F.col("d_in") + F.col("d_later")).alias("docs_at_least"),
            (F.col("t_in") + F.col("t_later")).alias("tokens_at_least"),
            "d_all",
            "t_all",
        )
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias(
                "tokens_truncated"
            ),
            ((F.col("d_all") - F.col("docs_at_least") + F.col("n_docs")) / F.col("d_all")).alias("share_at_most"),
        )
    )


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(context, docs_over, tokens_kept) for any context limits, from suffix_sums()."""
    spark = sums.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(int(x),) for x in limits], "context long"))
    every = F.broadcast(sums.agg(F.max("tokens_at_least").alias("every")))
    # the suffix that begins at the least length over the limit
    over = (
        sums.join(wanted, F.col("n_tokens") > F.col("context"))
        .groupBy("context")
        .agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("cut"))
    )
    docs, tokens = (F.coalesce(f"cut.{c}_at_least", F.lit(0)) for c in ("docs", "tokens"))
    found = wanted.join(over, "context", "left").join(every)
    return found.where("every is not null").select(
        "context", docs.alias("docs_over"), (F.col("every") - tokens + F.col("context") * docs).alias("tokens_kept")
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that at least that share of documents don't exceed."""
    spark = sums.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(float(x),) for x in shares], "share double"))
    return (
        sums.join(wanted, F.col("share_at_most") >= F.col("share"))
        .groupBy("share")
        .agg(F.min("n_tokens").alias("n_tokens"))
    )
