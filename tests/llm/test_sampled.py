"""Labelled documents are picked before their texts are read."""

from tapeloom.llm import quality


def test_texts_are_not_shuffled_for_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)] + [(7, "text 7"), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 2)] + [(1, None), (3, 1)], "doc_id long, label int")
    every = quality.sampled(docs, labels)
    assert sorted(r.doc_id for r in every.collect()) == sorted([*range(0, 300, 2), 3])
    assert 20 <= quality.sampled(docs, labels, 60).count() <= 100
    plan = every._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
