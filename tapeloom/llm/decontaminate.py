"""Benchmark decontamination with DataFrame functions alone.

A benchmark item's windows are its runs of ``width`` words; a shorter item is one window.  The
hashes of all windows are broadcast, every window of words of a document is probed against them,
and a hit counts only if the words themselves are equal.  contamination() shuffles no text.

Words are lower-cased A-Z runs of digits, a-z and characters beyond ASCII.

Cases: a null text has no words and no hit; an item without words has no window; items of equal
text are all reported; rows of equal doc_id and text get equal results; an empty benchmark hits
nothing; an empty table gives no rows; extra columns of docs are kept by decontaminate().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.shared import durable

WIDTH = 10
#: Bytes of windows that are broadcast at once; more go in turns, each over all documents.
BROADCAST_WINDOWS = 128 << 20
#: Bytes that a broadcast window takes beside its words (its array, key and number).
ROW_BYTES = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() is A-Z only where all is ASCII, and much faster there
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(folded, _BETWEEN), "")


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, span, run): the runs of words of each item, span words each."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where("size(w) > 0")
    span = F.least(F.size("w"), F.lit(width))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - span + 1), lambda i: F.slice("w", i, span))
    return own.select("item_id", span.alias("span"), F.explode(runs).alias("run")).distinct()


def _keyed(docs: DataFrame) -> DataFrame:
    """docs wrapped, beside a key of its own that no column of docs can clash with."""
    return docs.select(F.struct("*").alias("doc"), F.xxhash64(docs["doc_id"].cast("string"), docs["text"].cast("string")).alias("row"))


def _window_hash(run: str, span: int, first: str = "0") -> str:
    return "xxhash64(" + ", ".join(f"get({run}, {first} + {k})" for k in range(span)) + ")"


def _by_span(spans: list[int], hash_of: Callable[[int], str]) -> str:
    return "case span " + " ".join(f"when {n} then {hash_of(n)}" for n in spans) + " end"


def _hits(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(row, at, span, win) of every window of a document that an item has, and (win, item_id).

    Each text is split once, and the windows of all lengths are probed in that pass.  A hit is
    verified on the words where it is found, so only places and numbers of windows leave it.
    Windows beyond BROADCAST_WINDOWS bytes are broadcast in turns, a share of the hashes each.
    """
    every = durable(windows(benchmark, width), "windows")
    runs = every.groupBy("span", "run").agg(F.min("item_id").alias("any_item"))
    size = f"{ROW_BYTES} + aggregate(run, 0L, (n, x) -> n + octet_length(x) + 16)"
    sizes = runs.groupBy("span").agg(F.sum(F.expr(size)).alias("bytes")).collect()  # at most width rows
    spans = sorted(r["span"] for r in sizes)
    if not spans:
        none = docs.select("row").limit(0)
        return none.select("row", F.lit(0).alias("at"), F.lit(0).alias("span"), F.lit("").alias("win")), every.select(F.lit("").alias("win"), "item_id").limit(0)
    win = F.sha2(F.array_join("run", " "), 256).alias("win")
    probe = durable(runs.select(win, F.col("span").alias("length"), "run", F.expr(_by_span(spans, lambda n: _window_hash("run", n))).alias("h")), "probe")
    turns = max(1, -(-sum(r["bytes"] for r in sizes) // BROADCAST_WINDOWS))
    split = docs.select("row", words(F.col("doc.text")).alias("w")).where(F.size("w") >= spans[0])
    each = split.select("row", "w", F.explode(F.array(*map(F.lit, spans))).alias("span")).where(F.size("w") >= F.col("span"))
    hashes = F.expr(_by_span(spans, lambda n: f"transform(sequence(0, size(w) - {n}), i -> {_window_hash('w', n, 'i')})"))
    # posexplode() would have Spark filter by size(hashes) first, and split the text for each of its words
    placed = each.withColumn("hashes", hashes).select("row", "w", "span", F.posexplode_outer("hashes").alias("at", "h"))
    found = None
    for turn in range(turns):
        own = F.broadcast(probe.where(F.pmod("h", F.lit(turns)) == turn)).withColumnsRenamed({"h": "own_h", "run": "own_run"})
        run = F.slice("w", F.col("at") + 1, F.col("span"))
        # not "run = own_run", which would be a key of the join and cut out of the text at every word
        same = (F.col("h") == F.col("own_h")) & (F.col("span") == F.col("length")) & (run >= F.col("own_run")) & (run <= F.col("own_run"))
        part = placed.join(own, same).select("row", "at", "span", "win")
        found = part if found is None else found.unionByName(part)
    of_items = every.select(F.sha2(F.array_join("run", " "), 256).alias("win"), "item_id")
    return durable(found.distinct(), "hits"), of_items


_PLACES = "array_distinct(flatten(transform(spans, x -> sequence(x.at, x.at + x.span - 1))))"


def _places(hits: DataFrame) -> DataFrame:
    """(row, places): the words of each hit document that its hits cover."""
    return hits.groupBy("row").agg(F.collect_set(F.struct("at", "span")).alias("spans")).select("row", F.expr(_PLACES).alias("places"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    keyed = _keyed(docs)
    hits, of_items = _hits(keyed, benchmark, width)
    places = _places(hits).select("row", F.size("places").alias("n_hit"))
    listed = hits.select("row", "win").distinct().join(of_items, "win").groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    counted = F.coalesce(F.regexp_count("doc.text", F.lit(_WORD)), F.lit(0)).cast("long")
    own = keyed.select("row", F.col("doc.doc_id").alias("doc_id"), counted.alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return own.join(places.join(listed, "row"), "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", width: int = WIDTH) -> DataFrame:
    """docs without contaminated documents, or (remove="spans") without their hit words.

    A hit word goes with the characters up to the next word; all columns of docs are kept.  Texts
    are shuffled once, by a key of their own, whatever the number of hits.
    """
    keyed = _keyed(docs)
    hits, _ = _hits(keyed, benchmark, width)
    if remove == "documents":
        return keyed.join(hits.select("row").distinct().hint("merge"), "row", "left_anti").select("doc.*")
    checked = keyed.join(_places(hits).hint("merge"), "row", "left")
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    own = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    gaps = F.split(text, _WORD, -1)
    kept = F.transform(own, lambda w, i: F.when(F.array_contains("places", i), F.lit("")).otherwise(F.concat(w, F.get(gaps, i + 1))))
    cut = F.when(F.col("places").isNull(), F.col("doc.text")).otherwise(F.concat(gaps[0], F.array_join(kept, "")))
    columns = [cut.alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    return checked.select(*columns)
