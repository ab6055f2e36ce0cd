import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    r = random.Random(1)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    item = text(20)
    rows = [(i, "\n".join(text(30) for _ in range(4)), "en", "s", 0) for i in range(30)]
    rows += [(100, rows[0][1].replace(" ", "  ", 1), "en", "s", 0), (101, rows[0][1], "en", "s", 0), (102, f"{text(40)}\n{item}\n{text(40)}", "en", "s", 0)]
    rows += [(103, None, None, None, None), (104, "123 456", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = []
    for k, (_, stage) in enumerate(pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        left.append({x.doc_id for x in docs.collect()})
    assert {103, 104}.isdisjoint(left[0]) and len(left[0]) == 33
    assert 101 not in left[1] and 0 in left[1]  # nothing of an exact copy is left
    assert set(range(30)) <= left[3] and 102 in left[2] and 102 not in left[3]
    assert pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(left[3])


def test_near_copies_with_null_and_repeated_ids(spark):
    def text(seed, n=60):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))

    near = lambda t: t + " more"
    rows = [(1, text(1)), (2, text(2)), (2, near(text(1))), (None, text(3)), (None, near(text(2))), (None, text(4)), (None, near(text(4))), (5, None), (None, None), (6, ""), (7, text(7)), (7, text(7))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as doc")
    out = pipeline.near_copies(spark, docs, "")
    assert out.columns == docs.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    fours = [x for x in got if x in ((None, text(4)), (None, near(text(4))))]
    assert len(fours) == 1
    assert sorted((x for x in got if x not in fours), key=repr) == sorted([rows[0], rows[1], rows[3], rows[7], rows[8], rows[9], rows[10]], key=repr)
