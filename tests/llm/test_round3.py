"""Substring deduplication, token alignment and hard negatives against plain versions."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import alignment, negatives, substrings
from tapeloom.llm.pieces import PieceEncoder

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_substrings(docs, width):
    words = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - width + 1):
                key = tuple(w[i : i + width])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if d is not None and first[tuple(w[i : i + width])] < d:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def texts_with_repeats(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "Ü", " x", "日本"]
    shared = [" ".join(rng.choices(vocabulary, k=rng.randint(3, 40))) for _ in range(6)]
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
        yield i, rng.choice([" ", "\n", "\t \x0b"]).join(parts)


@pytest.mark.parametrize("block_bytes", [2000, 1 << 20])
def test_substrings_equal_plain_version(spark, block_bytes):
    rng = random.Random(5)
    docs = [*texts_with_repeats(rng, 80), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (500, None), (501, ""), (502, " \n"), (503, "a b c d e f g h"), (504, "x " * 3000)]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("did", F.lit("a")).withColumn("kept", F.lit(2.0)).repartition(3)
    found = substrings.dedup_substrings(table, width=4, block_bytes=block_bytes)
    # columns of the result that were in docs keep docs' values where the names clash
    assert found.columns[:5] == ["doc_id", "text", "block", "did", "kept"]
    rows = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()]
    assert sorted(rows, key=repr) == plain_substrings(docs, 4)
    assert {r["kept"] for r in found.collect()} == {2.0}


def test_substrings_keep_untouched_texts_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "  one\ttwo  three "), (2, "p q r s t")], "doc_id long, text string")
    assert {r["text"] for r in substrings.dedup_substrings(docs, width=3).collect()} == {"  one\ttwo  three ", "p q r s t"}
    assert substrings.dedup_substrings(docs.limit(0)).count() == 0


def test_a_window_in_a_third_of_all_documents(spark):
    line = " ".join(f"c{i}" for i in range(20))
    docs = [(i, f"u{i} v{i} {line} x{i}" if i % 3 == 0 else f"u{i} v{i} x{i}") for i in range(600)]
    found = substrings.dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"), block_bytes=2000)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found.collect()), key=repr) == plain_substrings(docs, 13)


def plain_groups(text, a_model, b_model):
    """[(a ids, b ids)] of each group of a text, or none."""
    if not text:
        return []
    letters = {chr(b) if b in {*range(33, 127), *range(161, 173), *range(174, 256)} else None: b for b in range(256)}
    rest = [b for b in range(256) if b not in letters.values() or chr(b) not in letters]
    letters = {k: v for k, v in letters.items() if k} | {chr(256 + i): b for i, b in enumerate(rest)}
    a = a_model.encode(" " + text, add_special_tokens=False)
    a_bytes = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a.ids]
    b = b_model.encode(text)
    b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b_model.id_to_piece(i)) for i in b)]
    if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
        return []
    groups, i, j, a_end, b_end = [], 0, 0, 0, 0
    while i < len(a_bytes):
        own = ([], [])
        while True:
            if a_end <= b_end:
                own[0].append(a.ids[i])
                a_end += len(a_bytes[i])
                i += 1
            else:
                own[1].append(b[j])
                b_end += len(b_bytes[j])
                j += 1
            if a_end == b_end:
                break
        groups.append(own)
    return groups


def plain_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(BYTES)
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = [(d, plain_groups(t, a_model, b_model)) for d, t in docs]
    counts = Counter()
    for _, groups in found:
        counts.update({(x, y) for a, b in groups for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for d, groups in found:
        links = [(x, y) for a, b in groups for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((d, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), digest))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("block_bytes", [4000, 1 << 20])
def test_alignment_equals_plain_version(spark, block_bytes):
    sf = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40).select("doc_id", "text").collect()
    odd = ["<|endoftext|> and <s> </s> <unk>", "two  spaces   here ", " lead", "trail ", "▁ literal", "日本語のテキスト 😀😀 naïve", "\n\n\t tab\n", "", None, "a", "don't they're", " ", "x" * 3000, " " * 500, "same words", "same words", "ﬁ ligature é é", "<0x0A> text"]
    docs = [*map(tuple, sf), *((1000 + i, t) for i, t in enumerate(odd)), (None, "no id")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("block", F.lit("x")).repartition(3)
    found = alignment.linked(table, BYTES, PIECES, block_bytes)
    assert found.columns == COLUMNS
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_alignment(docs)
    assert alignment.linked(table.limit(0), BYTES, PIECES).count() == 0


def test_large_groups_are_counted_by_distinct_ids(spark, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS_TOGETHER", 3)
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(BYTES)
    a_model.encode_special_tokens = True
    texts = ["日本語のテキスト 日本語", "ÄÖÜ straße überall", None, "plain words"]
    own = alignment.Alignment(pa.array(texts), BYTES, PIECES)
    row, pair, times = own.pairs()
    expected = Counter()
    for i, t in enumerate(texts):
        for a, b in plain_groups(t, a_model, sentencepiece.SentencePieceProcessor(model_file=PIECES)):
            expected.update((i, x << 32 | y) for x in a for y in b)
    assert dict(zip(zip(row.tolist(), pair.tolist(), strict=True), times.tolist(), strict=True)) == dict(expected)


def test_groups_are_rows_of_ids(spark):
    docs = spark.createDataFrame([(7, "some words align"), (8, None)], "doc_id long, text string")
    rows = alignment.groups(docs, BYTES, PIECES).orderBy("grp").collect()
    assert [r["grp"] for r in rows] == list(range(len(rows))) and {r["doc_id"] for r in rows} == {7}
    text = ";".join(",".join(map(str, r["a_ids"])) + "|" + ",".join(map(str, r["b_ids"])) for r in rows)
    assert hashlib.sha256(text.encode()).hexdigest() == alignment.linked(docs, BYTES, PIECES).where("doc_id = 7").first()["groups_sha256"]


def test_pieces_equal_the_model(spark):
    own = PieceEncoder(PIECES)
    texts = ["hello world", "  two", "a b  c", "", None, "Ünïcödé 日本", "line\nbreak \n x", "tab\there", "▁", "▁ x", "trail ", " "]
    ids, cuts = own.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[cuts[i] : cuts[i + 1]].tolist() == (own.model.encode(t) if t else [])


def plain_negatives(rows, every):
    rows = {i: (label, [int(256 * x // 1) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v)}
    out = []
    for a, (label, v) in rows.items():
        if a % every:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w, strict=False)), i, other) for i, (other, w) in rows.items() if i != a), key=lambda s: (-s[0], s[1]))
        for p_score, p, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * p_score <= 100 * s[0] <= 95 * p_score][:3]
            out += [(a, p, k + 1, i, p_score, s) for k, (s, i, _) in enumerate(fit)]
    return sorted(out)


NEGATIVES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 20, "span_blocks": 2, "chunk_anchors": 4, "pivots": 3}])
def test_negatives_equal_plain_version(spark, sizes):
    rng = random.Random(3)
    rows = [(i, 1 if rng.random() < 0.4 else rng.randint(0, 6), [rng.gauss(0.1, 0.3) for _ in range(8)]) for i in range(400)]
    rows += [(400 + i, 1, rows[i][2]) for i in range(30)]  # ties
    rows += [(900, None, [0.1] * 8), (901, 1, None), (902, 1, [None] * 8), (903, 1, [float("nan")] * 8), (904, 2, [float("inf")] * 8), (None, 1, [0.1] * 8), (905, 1, [0.5]), (910, 3, []), (920, 2, [0.0] * 8)]
    table = spark.createDataFrame([*rows, rows[0]], "id long, label int, vector array<double>").withColumn("grp", F.lit("x")).repartition(3)
    found = negatives.hard_negatives(table, "id % 10 = 0", **sizes)
    assert found.columns == NEGATIVES
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, 10)


def test_negatives_with_large_components_and_empty_tables(spark):
    rows = [(i, i % 3, [1e5 + i, -7e4 * i, 3.0 * i]) for i in range(40)]
    table = spark.createDataFrame(rows, "id long, label int, vector array<double>")
    assert sorted(map(tuple, negatives.hard_negatives(table, "id % 10 = 0").collect())) == plain_negatives(rows, 10)
    assert negatives.hard_negatives(table.limit(0), "id % 10 = 0").count() == 0
    with pytest.raises(ValueError, match="long"):
        negatives.hard_negatives(spark.createDataFrame([(0, 1, [1e30])], "id long, label int, vector array<double>"), "id = 0")


def test_brackets_hold_and_prune(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 40, (300, 16)) + 40 * np.repeat(np.eye(16)[:3] * 8, 100, 0))
    top = float((x * x).sum(1).max())
    pivots = x[[0, 100, 200, 250]]

    def rows(some, anchors):
        part = object.__new__(negatives._Rows)
        part.ids = part.labels = np.arange(len(some))
        part.vectors, part.norms = some, (some * some).sum(1)
        part.distances = negatives._distances(some, pivots, top, anchors)
        return part

    low, high = negatives._bracket(rows(x[:20], True), rows(x, False), top)
    exact = x[:20] @ x.T
    assert (low <= exact).all() and (exact <= high).all()
    assert (high < np.sort(exact, 1)[:, -5, None]).mean() > 0.3


def test_steps_round_trip(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 1 << 24, n)) for n in (1, 5, 400, 3)] + [np.array([0, 65534, 65535, 131070, 1 << 23])]
    cuts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    places, sizes = substrings._places(pa.chunked_array([substrings._steps(np.concatenate(rows), cuts)]))
    assert sizes.tolist() == [len(r) for r in rows] and places.tolist() == np.concatenate(rows).tolist()


def test_line_dedup_of_blank_and_short_lines(spark):
    import resource

    from tapeloom.llm import linededup

    long_line = " ".join(f"t{i}" for i in range(60))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    for text, units in (("\n" * 100_000 + long_line, 2), ("\n".join(f"w{i}" for i in range(100_000)), 199_000)):
        assert len(linededup.units_of(text)[1]) >= units / 2
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20  # in KB
    docs = [(1, "\n" * 20_000 + long_line), (2, "\n" * 300 + long_line + "\nown"), (3, "x\n" * 5000)]
    done = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert done[1].text == docs[0][1] and done[2].text == "\n" * 300 + "own"


def test_line_dedup_with_blank_lines_between(spark):
    from tapeloom.llm import linededup

    lines = [f"a{i} b{i} c{i} d{i}" for i in range(20)]
    docs = [(1, "\n".join(lines)), (2, "before\n" + "\n\n".join(lines) + "\nafter"), (3, "other text")]
    done = {r.doc_id: r.text for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert done[1] == docs[0][1] and done[2].split() == ["before", "after"] and done[3] == "other text"


def test_line_dedup_where_different_texts_share_a_hash(spark):
    from tapeloom.llm import linededup

    schema = "did long, row_key long, a int, b int, hash long, rest long"
    units = [(1, 1, 0, 2, 7, 1), (2, 2, 5, 6, 7, 2), (3, 3, 0, 2, 7, 1), (4, 4, 1, 2, 7, 2), (5, 5, 0, 1, 7, 3), (6, 6, 0, 1, 8, 1)]
    gone = {r.did: [tuple(x) for x in r.gone] for r in linededup._gone(spark.createDataFrame(units, schema)).collect()}
    assert gone == {3: [(0, 2)], 4: [(1, 2)]}
