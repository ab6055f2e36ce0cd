"""The matching operators that SQL cannot express, against plain searches."""

import itertools
import random

from tapeloom.operators import reconcile


def feeds(seed):
    r = random.Random(seed)
    rows = lambda: [("x" if r.random() < 0.7 else "y", i, float(r.randrange(0, 400))) for i in range(14)]
    return rows(), rows() + [("only right", 99, 5.0)]


def frames(spark, a, b):
    schema = "k string, id long, t double"
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)


def plain_nearest(a, b, within):
    used, out = set(), set()
    for key, i, t in sorted(a, key=lambda r: (r[2], r[1])):
        near = sorted((abs(t - y[2]), y[1]) for y in b if y[0] == key and abs(t - y[2]) <= within and (key, y[1]) not in used)
        if near:
            used.add((key, near[0][1]))
            out.add((i, near[0][1]))
    return out


def plain_alignment(a, b, early, late):
    """(matches, total difference) of the best order-keeping alignment, summed over keys."""

    def best(x, y):
        if not x or not y:
            return 0, 0.0
        found = [best(x[1:], y), best(x, y[1:])]
        d = y[0][2] - x[0][2]
        if -early <= d <= late:
            n, cost = best(x[1:], y[1:])
            found.append((n + 1, cost - abs(d)))
        return max(found)

    total = [0, 0.0]
    for k in {r[0] for r in a}:
        n, cost = best(*(sorted((r for r in side if r[0] == k), key=lambda r: (r[2], r[1])) for side in (a, b)))
        total = [total[0] + n, total[1] + cost]
    return total


def test_nearest_matches_equal_a_plain_loop(spark):
    for seed in range(3):
        a, b = feeds(seed)
        got = reconcile.nearest_matches(*frames(spark, a, b), ["k"], 25.0).collect()
        assert {tuple(r) for r in got} == plain_nearest(a, b, 25.0)


def test_alignment_is_as_good_as_a_plain_search(spark):
    for seed in range(2):
        a, b = (side[:9] for side in feeds(seed))
        got = [tuple(r) for r in reconcile.aligned(*frames(spark, a, b + [("only right", 99, 5.0)]), ["k"], 10.0, 60.0).collect()]
        at = [{r[1]: r for r in side} for side in (a, b)]
        assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
        assert all(at[0][i][0] == at[1][j][0] and -10 <= at[1][j][2] - at[0][i][2] <= 60 for i, j in got)
        for (i, j), (m, n) in itertools.combinations(got, 2):
            if at[0][i][0] == at[0][m][0]:
                order = [(s[x][2], x) < (s[y][2], y) for s, x, y in ((at[0], i, m), (at[1], j, n))]
                assert order[0] == order[1]
        n, cost = plain_alignment(a, b, 10.0, 60.0)
        assert (len(got), -sum(abs(at[1][j][2] - at[0][i][2]) for i, j in got)) == (n, cost)


def test_matching_of_nothing(spark):
    a, b = frames(spark, [], [])
    assert reconcile.nearest_matches(a, b, ["k"], 5.0).count() == 0
    assert reconcile.aligned(a, b, ["k"], 5.0, 5.0).count() == 0


def test_feeds_are_matched_across_midnight(spark, tmp_path):
    import datetime

    from tapeloom.plans import records

    at = datetime.datetime
    rows = [(1, 2, at(2024, 1, 1, 23, 59, 50), "click", 5.0), (2, 3, at(2024, 1, 2, 0, 0, 5), "click", 6.0), (3, 3, at(2024, 1, 5, 0, 0, 5), "click", 6.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    for query in (records.jn_order_keeping_alignment, records.jn_nearest_once):
        assert [tuple(r) for r in query(spark, str(tmp_path)).collect()] == [(1, 2)]


def test_long_dense_feeds_have_the_best_alignment(spark):
    r = random.Random(5)
    a, b = ([("x", i, float(i * 5 + r.randrange(5))) for i in range(n)] for n in (400, 380))
    best = [[(0, 0.0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a) - 1, -1, -1), range(len(b) - 1, -1, -1)):
        d = b[j][2] - a[i][2]
        n, cost = best[i + 1][j + 1]
        best[i][j] = max(best[i + 1][j], best[i][j + 1], *([(n + 1, cost - abs(d))] if -10 <= d <= 60 else []))
    got = reconcile.aligned(*frames(spark, a, b), ["k"], 10.0, 60.0).collect()
    assert (len(got), -sum(abs(b[j][2] - a[i][2]) for i, j in got)) == best[0][0]
    assert {tuple(x) for x in reconcile.nearest_matches(*frames(spark, a, b), ["k"], 25.0).collect()} == plain_nearest(a, b, 25.0)


def test_controls_share_the_keys_and_are_drawn_once(spark):
    from tapeloom.operators import stats

    events = spark.range(40).selectExpr("id as event_id", "cast(id % 4 as int) as hour")
    pool = spark.range(1000, 3000).selectExpr("id as control_id", "cast(id % 5 as int) as hour")
    got = stats.controls(events, pool, ["hour"], 5).collect()
    assert len(got) == 200 == len({tuple(r) for r in got})
    assert all(r.event_id % 4 == r.control_id % 5 for r in got)


def test_stateful_minutes_keep_what_a_batch_leaves(spark, tmp_path):
    from tapeloom.streaming import minutes as S

    batches = [[("s", 10, 1, 1.0), ("s", 61_000_000, 2, 2.0)], [("s", 62_000_000, 3, 3.0), ("s", 62_000_000, 3, 3.0), ("s", 200_000_000, 4, 4.0)], [("s", 70_000_000, 5, 9.0)]]
    schema = "symbol string, us long, trade_id long, px double"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    S.run_to_end(S.minutes_with_late(S.read_tape(spark, f"{tmp_path}/in", schema)), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r.kind, r.open_us, r.open, r.close, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("LATE", 70_000_000, 9.0, 9.0, 1), ("M1", 0, 1.0, 1.0, 1), ("M1", 60_000_000, 2.0, 3.0, 2)]


def test_parts_are_running_values_over_chunk_borders(spark):
    r = random.Random(9)
    border = 4 * 86400
    rows = lambda: [("x" if r.random() < 0.8 else None, i, float(r.randrange(border - 300, border + 300))) for i in range(25)]
    a, b = rows(), rows()
    frames_ = frames(spark, a, b)
    got = reconcile.nearest_matches(*frames_, ["k"], 20.0).collect()
    assert {tuple(x) for x in got} == plain_nearest(a, b, 20.0)
    for k in ("x", None):  # one part holds each chain of pairs
        own = {(x.side, x.id): x._part for x in reconcile.parts_of(*frames_, ["k"], 20.0, 20.0).collect() if x.k == k}
        assert all(own[0, i] == own[1, j] for ka, i, t in a for kb, j, u in b if ka == kb == k and abs(t - u) <= 20)
        assert len(set(own.values())) > 1
    plan = reconcile.parts_of(*frames_, ["k"], 20.0, 20.0)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedfollowing" not in plan  # such a frame is read anew for every row


def test_many_equal_times_are_matched_in_linear_work(spark):
    n = 3000
    a = [("x", i, float(i // n)) for i in range(2 * n)]
    b = [("x", i, float(i // n)) for i in range(n)]
    got = {tuple(x) for x in reconcile.nearest_matches(*frames(spark, a, b), ["k"], 5.0).collect()}
    assert got == {(i, i) for i in range(n)}


def test_parts_of_two_rows_are_looked_at_together(spark):
    rows = [("x", 0, 1, 100.0, 0), ("x", 1, 2, 95.0, 0), ("y", 0, 3, 100.0, 0), ("y", 1, 4, 160.0, 0), ("z", 0, 5, 100.0, 0), ("z", 1, 6, 160.5, 0), ("z", 0, 7, 300.0, 1), ("w", 1, 8, 89.5, 0), ("w", 0, 9, 100.0, 0)]
    parts = spark.createDataFrame(rows, "k string, side int, id long, t double, _part int")

    def never(*_):
        raise AssertionError("one by one")

    assert {tuple(r) for r in reconcile._by_part(parts, ["k"], never, 10.0, 60.0).collect()} == {(1, 2), (3, 4)}
