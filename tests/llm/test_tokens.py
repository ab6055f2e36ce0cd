import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapeloom.llm import packing, tokencount, tokenfile
from tapeloom.llm.shared import durable, durable_path
from tapeloom.llm.tokenize import encoder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", None, " ", "a ", " \n b", "\n\n\n x\n", "  a  b\n\n c d", "don't  I'll  x", "x <|endoftext|> y<|startoftext|>z",
    "İstanbul ΣΑΣ é ﬁ ½ ×÷", "日本 語 ok", "12345 a1b2", "a\tb \tc  d", "ab\n cd", "Éa ç, ß. ÿ!", "a<|b", "x" * 5000,
]
DOCS = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id")]


def plain_ids(name, text):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_odd_texts_have_the_library_s_ids(name):
    ids, offsets = encoder(public_tokenizers.path(name)).encode(pa.array(ODD, pa.string()))
    for i, text in enumerate(ODD):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain_ids(name, text), repr(text)


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abÉé ñ.,'\n\t5#<|A ßΣ̈", max_size=30), min_size=1, max_size=6))
def test_any_texts_have_the_library_s_ids(name, texts):
    enc = encoder(public_tokenizers.path(name))
    ids, offsets = enc.encode(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70), st.integers(0, 70), st.integers(0, 70))
def test_packed_bits_come_back(bits, values, a, b):
    ids = np.array([v % (1 << bits) for v in values], np.uint32)
    packed = tokenfile.pack_bits(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    a, b = sorted((min(a, len(ids)), min(b, len(ids))))
    assert tokenfile.unpack_bits(packed, bits, a, b).tolist() == ids[a:b].tolist()


def test_token_file_round_trip(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    path = durable_path(spark, "t")
    tokenfile.write_token_file(docs, path, public_tokenizers.path(FILES[0]), end_id=1, block_ids=16, shards=3)
    rows = sorted(tokenfile.token_index(spark, path).collect(), key=lambda r: (r.start))
    start = 0
    for (name, text), row in zip(sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")), rows, strict=True):
        ids = np.array([*plain_ids(FILES[0], text), 1], "<u4")
        assert tuple(row) == (name, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = tokenfile.read_documents(spark, path, [6]).collect()
    assert [r.ids for r in one] == [[*plain_ids(FILES[0], ODD[6]), 1]]


def test_token_file_of_nothing(spark):
    path = durable_path(spark, "t")
    tokenfile.write_token_file(spark.createDataFrame([], "doc_id long, text string"), path, public_tokenizers.path(FILES[0]))
    assert tokenfile.token_index(spark, path).count() == 0


def test_counts_and_suffix_sums(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    sums = tokencount.suffix_sums(tokencount.length_histogram(docs, public_tokenizers.path(FILES[1]))).cache()
    sizes = [len(plain_ids(FILES[1], t)) for _, t in DOCS]
    for r in sums.collect():
        n = r.n_tokens
        assert r.n_docs == sizes.count(n)
        assert r.docs_at_least == sum(s >= n for s in sizes)
        assert r.tokens_at_least == sum(s for s in sizes if s >= n)
        assert r.tokens_truncated == sum(min(s, n) for s in sizes)
    got = {r.context: (r.docs_over, r.tokens_kept) for r in tokencount.truncated_totals(sums, [0, 4, 10**6]).collect()}
    assert got == {c: (sum(s > c for s in sizes), sum(min(s, c) for s in sizes)) for c in (0, 4, 10**6)}
    assert {r.share: r.n_tokens for r in tokencount.quantiles(sums, [0.5]).collect()}[0.5] == sorted(sizes)[(len(sizes) - 1) // 2]
    assert tokencount.suffix_sums(tokencount.length_histogram(docs.limit(0), public_tokenizers.path(FILES[1]))).count() == 0


def test_best_fit_takes_the_fullest_bin_that_fits():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1]


def test_packing_keeps_every_piece(spark):
    texts = [(i, "word " * (i * 37 % 400)) for i in range(120)] + DOCS
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    packed = packing.pack(docs, public_tokenizers.path(FILES[1]), end_id=2, capacity=128).toPandas()
    expected = []
    for name, text in texts:
        ids = np.array([*plain_ids(FILES[1], text), 2], "<u4")
        first = len(ids) % 128 or 128
        cuts = [0, *range(first, len(ids) + 1, 128)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((-1 if name is None else name, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    got = packed.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype({"doc_id": "int64"})
    assert sorted(map(tuple, got.values.tolist())) == sorted(expected)
    for _, one in packed.sort_values("offset").groupby("sequence_id"):
        assert one["offset"].tolist() == [0, *one["length"].cumsum().tolist()[:-1]] and one["length"].sum() <= 128
    assert packed.sequence_id.nunique() <= 1.1 * packed["length"].sum() / 128 + 2
    assert dict(packed.dtypes.astype(str)).items() >= {"length": "int64", "offset": "int64", "start": "int64"}.items()
    assert packing.pack(docs.limit(0), public_tokenizers.path(FILES[1])).count() == 0


def test_sorted_pieces_pack_as_well_as_shuffled_ones(spark):
    length = "cast(if(id < 4000, 560 + id % 141, 324 + id % 137) as int)"
    pieces = spark.range(8000).selectExpr("id as doc_id", "0 as piece", "0L as start", f"cast({length} as long) as length", "id as ids_crc32")
    made = []
    for name, frame in (("sorted", pieces.repartitionByRange(16, "doc_id")), ("shuffled", pieces.repartition(3))):
        packed = packing.pack_pieces(durable(frame, name), 1024).toPandas()
        assert sorted(packed.doc_id) == list(range(8000)) and packed.groupby("sequence_id")["length"].sum().max() <= 1024
        made.append(packed.sequence_id.nunique())
        least = packed["length"].sum() / 1024
    assert made[0] == made[1] and made[0] <= 1.02 * max(4000, least)
