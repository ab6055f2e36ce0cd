"""The registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import alignment, ann, decontaminate, langid, linededup, neardup, negatives, packing, pii, quality, substrings, tokencount, tokenfile
from tapeloom.llm.shared import bounded_batches, crc32_of, durable_path

WORDS, BYTES, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The queries' key; whoever publishes data passes a secret of their own.
PII_KEY = "tapeloom-query-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings"), is_query="vec_id % 50 = 0", k=5)


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token file of all documents and read it back."""
    path = durable_path(spark, "tokens")
    tokenfile.write_token_file(
        table(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path(WORDS), end_id=1
    )
    return tokenfile.token_index(spark, path)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_of("doc_id") % 4 == 2
    model = langid.fit(docs.where(~F.coalesce(held_out, F.lit(False))).select("doc_id", "text", "lang"))
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the line chunks that repeat across documents."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels of those not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc32_of("doc_id") % 3 == 1
    labels = table(spark, sf_dir, "labels").where(~F.coalesce(held_out, F.lit(False)))
    labelled = quality.sampled(docs, labels.select("doc_id", F.col("quality").alias("label")))
    found = quality.score(docs, quality.fit(labelled.select("doc_id", "text", "label")))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums."""
    counts = tokencount.length_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES))
    return tokencount.suffix_sums(counts)


def op9_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with personal data replaced by pseudonyms."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=PII_KEY)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), end_id=2)


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without word windows of documents of smaller doc_id."""
    cleaned = substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token groups and links of two tokenizers over every document."""
    return alignment.linked(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector's positives."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), shifted.alias("label"), F.col("embedding").alias("vector"))
    return negatives.hard_negatives(rows, is_anchor="id % 50 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_token_file": op2_token_file,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_quality_rules": op6_quality_rules,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_token_counts": op8_token_counts,
    "op9_pseudonyms": op9_pseudonyms,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_hard_negatives": op13_hard_negatives,
}

_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS span,
         array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), spans AS (SELECT DISTINCT span FROM bw),
dw AS (
  SELECT r, span, i, array_to_string(w[i:i + span - 1], ' ') AS run
  FROM (SELECT r, span, w, unnest(range(1, len(w) - span + 2)) AS i FROM d, spans WHERE len(w) >= span)
), hit AS (SELECT r, i, span, item_id FROM dw JOIN bw USING (span, run)),
places AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + span)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""

OP7_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.other
), least_of AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least_of USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS run
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (SELECT run, min(doc_id) AS least FROM s GROUP BY run HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM s JOIN f USING (run) WHERE doc_id > least)
), words AS (
  SELECT r, p, w[p] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r
), n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""

OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
       (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": OP5_SQL,
    "op7_near_duplicates": OP7_SQL,
    "op11_substring_dedup": OP11_SQL,
    "op13_hard_negatives": OP13_SQL,
}
