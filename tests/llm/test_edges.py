"""Nulls, ties, repeated rows, long texts, empty tables and clashing names, operator by operator."""

import random

import numpy as np
import public_tokenizers
import pytest

from tapeloom.llm import ann, langid, linededup, neardup, packing, tokencount, tokenfile
from tapeloom.llm.shared import durable_path

BYTES = "byte_bpe_50k.json"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def test_packing_with_clashing_columns_and_repeated_rows(spark):
    rows = [(1, words(30, 1)), (1, words(30, 1)), (None, words(5, 2)), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as piece", "2 as length", "'x' as sequence_id", "3 as ids", "4 as size")
    got = packing.pack(docs, public_tokenizers.path(BYTES)).toPandas()
    assert len(got) == 4 and got.doc_id.isna().sum() == 1
    one = got[got.doc_id == 1]
    assert one.ids_crc32.nunique() == 1 and len(one) == 2


def test_packing_sends_every_underfull_bin_up(spark):
    # pieces of three fifths fit nothing: a round leaves all of them, so it is the last
    big = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "0L as start", "600L as length", "id as ids_crc32")
    path = durable_path(spark, "big")
    big.write.parquet(path)
    packed = packing.pack_pieces(spark.read.parquet(path), 1024).toPandas()
    assert sorted(packed.doc_id) == list(range(3000)) and packed.sequence_id.nunique() == 3000 and (packed.offset == 0).all()


def test_counts_with_clashing_columns_and_nothing_over_a_limit(spark):
    docs = spark.createDataFrame([("a b c",), ("",), (None,)], "text string").selectExpr("*", "1 as n_tokens", "2 as band")
    sums = tokencount.suffix_sums(tokencount.length_histogram(docs, public_tokenizers.path(BYTES)))
    assert {(r.n_tokens, r.n_docs) for r in sums.collect()} == {(3, 1), (0, 2)}
    assert [(r.docs_over, r.tokens_kept) for r in tokencount.truncated_totals(sums, [100]).collect()] == [(0, 3)]
    assert tokencount.truncated_totals(sums.limit(0), [100]).count() == 0


def test_token_file_with_clashing_columns(spark):
    docs = spark.createDataFrame([(2, "one two"), (1, None)], "doc_id long, text string").selectExpr("*", "1 as block", "2 as start", "'x' as ids")
    path = durable_path(spark, "t")
    tokenfile.write_token_file(docs, path, tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    got = tokenfile.token_index(spark, path).orderBy("doc_id").collect()
    assert [(r.doc_id, r.start) for r in got] == [(1, 0), (2, got[0].n_tokens)] and got[0].n_tokens == 1


def test_line_dedup_with_null_ids_and_a_long_text(spark):
    passage = "\n".join(words(20, k) for k in range(4))
    long = "\n".join(words(12, 1000 + k) for k in range(5000))
    rows = [(None, f"a\n{passage}\nb"), (3, f"{long}\n{passage}"), (4, long), (5, None)]
    done = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert done[None].text == rows[0][1] and passage.split("\n")[1] not in done[3].text
    assert done[3].text.startswith(long.split("\n")[0]) and done[4].text == "" and done[5].text is None


def test_languages_with_ties(spark):
    docs = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["bb", "aa"] * 40)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert {r.lang_pred for r in langid.predict(docs, model).collect()} == {"aa"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_large_nodes_give_all_links_of_two_close_families(spark):
    """Two families of near copies that meet in the same nodes: each is one group, and a member
    between them joins both."""
    r = random.Random(3)
    base = [f"t{k}" for k in range(120)]
    shift = base[:100] + [f"u{k}" for k in range(20)]
    between = base[:110] + [f"u{k}" for k in range(10)]

    def copy(ws):
        ws = list(ws)
        ws[r.randrange(len(ws))] = f"x{r.randrange(10**9)}"
        return " ".join(ws)

    rows = [(i, copy(base)) for i in range(60)] + [(100 + i, copy(shift)) for i in range(60)]
    docs = spark.createDataFrame([*rows, (500, " ".join(between))], "doc_id long, text string").repartition(3)

    def sets(text):
        w = text.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    texts = dict([*rows, (500, " ".join(between))])
    own = {k: sets(t) for k, t in texts.items()}
    group = {k: k for k in own}
    for a in own:
        for b in own:
            if a < b and 100 * len(own[a] & own[b]) >= 75 * len(own[a] | own[b]) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    for small in (8, 32):
        got = {x.doc_id: x.component_id for x in neardup.near_duplicates(docs, small=small).collect()}
        assert got == group


def test_neighbours_of_mixed_lengths_ties_and_a_large_group(spark):
    rng = np.random.default_rng(1)
    near = rng.normal(size=16)
    vectors = [(i, (near + 1e-3 * rng.normal(size=16)).tolist()) for i in range(300)] + [(300 + i, rng.normal(size=16).tolist()) for i in range(300)]
    vectors += [(1000 + i, rng.normal(size=3).tolist()) for i in range(4)] + [(1100, vectors[0][1]), (1101, vectors[0][1]), (1200, [float("nan")] * 16), (1201, None), (None, vectors[1][1])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "'x' as unit")
    found = {}
    for x in ann.nearest(frame, "vec_id % 50 = 0", 5).collect():
        found.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    usable = {i: np.array(v) for i, v in vectors if i is not None and v is not None and np.isfinite(v).all()}
    hits = total = 0
    for q in (i for i in usable if i % 50 == 0):
        same = [i for i in usable if i != q and len(usable[i]) == len(usable[q])]
        score = {i: usable[i] @ usable[q] / np.linalg.norm(usable[i]) / np.linalg.norm(usable[q]) for i in same}
        best = sorted(same, key=lambda i: (-score[i], i))[:5]
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, len(best) + 1))
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in got)
        total += len(best)
        hits += sum(s >= score[best[-1]] - 1e-12 for _, _, s in got)
    assert hits >= 0.9 * total
    assert {i for _, i, _ in found[0]} >= {1100, 1101} and {i for _, i, _ in found[1000]} == {1001, 1002, 1003}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
