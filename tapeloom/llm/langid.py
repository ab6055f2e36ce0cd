"""Language identification by the nearest of several clustered centroids a language.

A text is the normalised TF-IDF vector of its hashed byte n-grams (letters folded, everything but
letters a blank).  Document frequencies are counted over all learnable documents; centroids are
spherical k-means clusters of about ``SAMPLE`` documents a language, picked by a hash.  A text gets
the language of the centroid with the largest cosine, and is rejected if that is well below what
excerpts of its length of the language's own documents reach; a text of a few letters, whose distance
says nothing, is not.

Cases: a null text, or one without letters, is ``und``, score 0, rejected; without any learnable
document every text is; ties go to the language that sorts first; repeated rows each get a row;
an empty table gives no rows; columns of docs other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.shared import byte_slices, give_back
from tapeloom.llm.shingles import buffers

UNKNOWN = "und"
#: Bins of the hashed n-grams (a power of two), bytes of an n-gram, clusters and sampled documents a language.
BINS, GRAM, CLUSTERS, SAMPLE = 8192, 3, 4, 800
#: A text is rejected below this share of the cosine that all but one in 200 excerpts of its length reach.
REJECT_SHARE = 0.7
#: Lengths are told apart by powers of two of the number of n-grams; below LEAST_BAND none is rejected.
BANDS, LEAST_BAND = 14, 4
SLICE_BYTES = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_SHIFT = np.uint32(32 - BINS.bit_length() + 1)


def gram_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, counts by bin) of each text that is not empty."""
    padded = pc.binary_join_element_wise(" ", pc.fill_null(pc.utf8_lower(texts), ""), " ", "")
    data, offsets = buffers(padded)
    data = _FOLD[data].astype(np.uint32)
    n = len(data) - GRAM + 1
    if n < 1:
        return
    code = np.zeros(n, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | data[k : n + k]
    blank = code == sum(32 << (8 * k) for k in range(GRAM))
    bins = ((code * np.uint32(2654435761)) >> _SHIFT).astype(np.int32)
    bins[blank] = BINS
    for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if b - a >= GRAM:
            yield row, np.bincount(bins[a : b - GRAM + 1], minlength=BINS + 1)[:BINS]


def vectors(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of unit length for each text, or of zeros if it has no n-gram; the band of its length."""
    out, bands = np.zeros((len(texts), BINS), np.float32), np.zeros(len(texts), np.int64)
    for row, counts in gram_counts(texts):
        bands[row] = min(BANDS - 1, int(counts.sum()).bit_length())
        own = np.log1p(counts.astype(np.float32)) * idf
        if norm := np.sqrt(own @ own):
            out[row] = own / norm
    return out, bands


def excerpt(text: str, size: int, place: int) -> str:
    """Whole words of text from about place on, of size characters or more if there are as many."""
    start = place % max(1, len(text) - size + 1)
    start = text.find(" ", start) + 1 if start else 0
    end = text.find(" ", start + size)
    return text[start : end if end >= 0 else len(text)]


def reached(texts: list[str], centres: np.ndarray, idf: np.ndarray) -> list[float]:
    """For each band the cosine that all but one in 200 excerpts of that length of texts reach."""
    found: list[list[float]] = [[] for _ in range(BANDS)]
    for band in range(BANDS):
        pieces = pa.array([excerpt(t, 1 << band, 7919 * i) for i, t in enumerate(texts)], pa.string())
        for k in range(0, len(pieces), 256):
            points, own = vectors(pieces[k : k + 256], idf)
            for b, cosine in zip(own.tolist(), (points @ centres.T).max(1).tolist(), strict=True):
                found[b].append(cosine)
    least, last = [], 0.0
    for band, cosines in enumerate(found):
        last = 0.0 if band < LEAST_BAND else float(np.quantile(cosines, 0.005)) if len(cosines) >= 20 else last
        least.append(last)
    return least


def clustered(points: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids of spherical k-means, started from points far from each other."""
    centres = [points.mean(0)]
    nearest = points @ (centres[0] / (np.linalg.norm(centres[0]) or 1))
    centres = [points[int(nearest.argmax())]]
    nearest = points @ centres[0]
    for _ in range(1, min(clusters, len(points))):
        centres.append(points[int(nearest.argmin())])
        nearest = np.maximum(nearest, points @ centres[-1])
    centres = np.array(centres)
    for _ in range(rounds):
        own = (points @ centres.T).argmax(1)
        for k in range(len(centres)):
            if (own == k).any():
                mean = points[own == k].sum(0)
                centres[k] = mean / (np.linalg.norm(mean) or 1)
    return centres


@dataclass
class LanguageModel:
    """languages, centres and least give each centroid's language, vector and rejection bounds by band."""

    idf: np.ndarray
    languages: list[str]
    centres: np.ndarray
    least: np.ndarray


def fit(docs: DataFrame, clusters: int = CLUSTERS, sample: int = SAMPLE) -> LanguageModel:
    """Learn from docs (text, lang), whose lang is not null.

    Sampling is by a hash of all columns of docs, about sample documents a language and 4 * sample
    at most; one task holds one language's sample and returns its centroids. With a name of the row
    among the columns, copies of a text are drawn one by one. Document frequencies are those of all docs.
    """
    known = docs.where("lang is not null and text is not null").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        (F.pmod(F.xxhash64(*docs.columns, F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("draw"),
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BINS + 1, np.int64)
        for part in byte_slices(batches, "text", SLICE_BYTES):
            for _, counts in gram_counts(part.column("text")):
                total[:BINS] += counts > 0
                total[BINS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bin": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    found = known.select("text").mapInArrow(frequencies, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    seen = np.zeros(BINS + 1, np.float64)
    for row in found.collect():  # at most BINS + 1 rows
        seen[row["bin"]] = row["n"]
    idf = (np.log((1 + seen[BINS]) / (1 + seen[:BINS])) + 1).astype(np.float32)

    # a row a language; without the broadcast every text would be dealt by its language
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"))
    picked = known.join(F.broadcast(sizes), "lang").where(F.col("draw") * F.col("size") < sample)
    first = Window.partitionBy("lang").orderBy("draw", "text")
    picked = picked.withColumn("r", F.row_number().over(first)).where(F.col("r") <= 4 * sample).select("lang", "text")

    def centroids(frame: pd.DataFrame) -> pd.DataFrame:
        points = vectors(pa.array(frame["text"], pa.string()), idf)[0]
        points = points[points.any(1)]
        if not len(points):
            return pd.DataFrame({"lang": [], "centre": [], "least": []})
        centres = clustered(points, clusters)
        least = reached(frame["text"].tolist(), centres, idf)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "centre": [c.tolist() for c in centres], "least": [least] * len(centres)})

    rows = picked.groupBy("lang").applyInPandas(centroids, "lang string, centre array<float>, least array<double>").collect()
    rows = sorted(rows, key=lambda r: r["lang"])  # a few rows a language
    return LanguageModel(
        idf,
        [r["lang"] for r in rows],
        np.array([r["centre"] for r in rows], np.float32).reshape(len(rows), BINS),
        np.array([r["least"] for r in rows]).reshape(len(rows), BANDS),
    )


def labels(texts: pa.Array, model: LanguageModel, reject_share: float) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and whether it is rejected, of each text."""
    points, bands = vectors(texts, model.idf)
    cosines = points @ model.centres.T if model.languages else np.zeros((len(texts), 1))
    best = cosines.argmax(1)
    top = np.clip(cosines[np.arange(len(texts)), best].astype(np.float64), 0, 1)
    plain = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_pylist()
    names, scores, rejected = [], [], []
    for i, has in enumerate(plain):
        has = bool(model.languages) and (has or any(map(str.isalpha, texts[i].as_py() or "")))
        names.append(model.languages[best[i]] if has else UNKNOWN)
        scores.append(float(top[i]) if has else 0.0)
        rejected.append(not has or bool(top[i] < reject_share * model.least[best[i], bands[i]]))
    return names, scores, rejected


def predict(docs: DataFrame, model: LanguageModel, reject_share: float = REJECT_SHARE) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 to 1), rejected of every whole text of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # clusters * BINS floats a language

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", SLICE_BYTES):
            for k in range(0, part.num_rows, 256):
                rows = part.slice(k, 256)
                names, scores, rejected = labels(rows.column("text"), shared.value, reject_share)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": rows.column("doc_id"), "lang_pred": names, "score": scores, "rejected": rejected}
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(label, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: LanguageModel, reject_share: float = REJECT_SHARE) -> DataFrame:
    """The rows of docs whose text is not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def fits(texts: pd.Series) -> pd.Series:
        out: list[bool] = []
        for k in range(0, len(texts), 256):
            out += labels(pa.array(texts.iloc[k : k + 256], pa.string()), shared.value, reject_share)[2]
        give_back()
        return ~pd.Series(out, dtype=bool)

    return docs.where(fits(F.col("text").cast("string")))
