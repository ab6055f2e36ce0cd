"""What the joins of nearest neighbours send to the driver and to all tasks."""

from __future__ import annotations

import numpy as np

from tapeloom.llm import ann


def test_no_side_of_a_join_is_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(5)
    frame = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    plans, written = [], ann.durable

    def durable(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(ann, "durable", durable)
    found = ann.nearest(frame, "vec_id % 50 = 0", 5)
    plans.append(("found", found._jdf.queryExecution().executedPlan().toString()))
    assert {"lists1", "beams0", "beams1", "found"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "BroadcastExchange" in plan] == []
    assert found.count() == 8 * 5
