"""Results don't depend on how many windows are broadcast at once."""

from tapeloom.llm import decontaminate as D


def test_windows_in_turns_give_the_same(spark, monkeypatch):
    passage = " ".join(f"w{k}" for k in range(14))
    docs = spark.createDataFrame([(k, f"a{k} b{k} {passage if k % 3 == 0 else 'c d'} tiny item z{k}") for k in range(30)] + [(90, None), (None, passage)], "doc_id long, text string")
    bench = spark.createDataFrame([("i1", passage), ("i2", "Tiny item"), ("i3", passage), ("i4", "no such words")], "item_id string, text string")
    at_once = sorted(D.contamination(docs, bench).collect(), key=repr)
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 1500)
    in_turns = D.contamination(docs, bench)
    assert sorted(in_turns.collect(), key=repr) == at_once
    assert sum(r.n_items == 3 for r in at_once) == 10 and sum(r.contaminated for r in at_once) == 31
