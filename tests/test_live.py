"""Repair, live state and wallets against plain sequential versions on small made-up feeds."""

from __future__ import annotations

import os
import random
import uuid

import pytest

from tapeloom.operators import repair, simulate
from tapeloom.operators import reconcile as C
from tapeloom.operators import wallet as W
from tapeloom.plans import live
from tapeloom.streaming import advance, held, matching, proof
from tapeloom.streaming import minutes as S

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MINUTE = 60_000_000


def folder(spark):
    return f"{spark.conf.get('spark.checkpoint.dir')}/test-{uuid.uuid4().hex}"


def run_stream(spark, frames, schema, make, where, restart_after=None):
    """The rows that make(stream) gives for frames as files, one a trigger; the stream may stop between."""
    groups = [frames] if restart_after is None else [frames[:restart_after], frames[restart_after:]]
    for group in groups:
        for rows in group:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        S.run_to_end(make(S.read_tape(spark, f"{where}/in", schema)), f"{where}/out", f"{where}/state")
    return spark.read.parquet(f"{where}/out")


def plain_repair(gap, window, known, d_min, d_max, within=1_000_000):
    """(code, [ids that are put in]) by looking at one trade after the other."""
    start, end, fetched = gap
    if not window:
        return "NO_REST_TRADES", []
    if fetched < end + d_max:
        return "FETCHED_TOO_EARLY", []
    if min(t for _, t, _, _ in window) >= start:
        return "REST_WINDOW_TOO_SHORT", []
    taken, missing, broken = set(), [], False
    for i, t, price, qty in sorted((r for r in window if start + d_min <= r[1] < end + d_max), key=lambda r: (r[1], r[0])):
        near = sorted((abs(t - us), k) for k, us, p, q in known if (p, q) == (price, qty) and abs(t - us) <= within and k not in taken)
        if not near:
            missing.append((i, t, price))
            continue
        taken.add(near[0][1])
        us = next(u for k, u, _, _ in known if k == near[0][1])
        broken |= not d_min <= t - us <= d_max
    if broken:
        return "TIME_MODEL_VIOLATION", []
    placed = []
    for i, t, price in missing:
        lo, hi = max(t - d_max, start), min(t - d_min, end - 1)
        if lo // MINUTE != hi // MINUTE:
            return "AMBIGUOUS_MINUTE", []
        placed.append((lo, hi, price, i))
    for m in sorted({lo // MINUTE for lo, *_ in placed}):
        spans = [(us, us, p) for _, us, p, _ in known if us // MINUTE == m] + [(lo, hi, p) for lo, hi, p, _ in placed if lo // MINUTE == m]
        first, last = min(hi for _, hi, _ in spans), max(lo for lo, _, _ in spans)
        if len({p for lo, _, p in spans if lo <= first}) > 1:
            return "AMBIGUOUS_OPEN", []
        if len({p for _, hi, p in spans if hi >= last}) > 1:
            return "AMBIGUOUS_CLOSE", []
    return "REPAIRED", sorted(i for *_, i in placed)


def test_repair_equals_a_plain_walk_and_has_every_code(spark):
    rng = random.Random(11)
    gaps, windows, trades, expected, number = [], [], [], {}, 0
    for g in range(260):
        symbol, base = f"s{g}", 10 * MINUTE
        start = base + rng.randrange(0, MINUTE, 10_000)
        end = start + rng.choice([2, 5, 9]) * 1_000_000
        own = []
        for _ in range(rng.randint(4, 30)):
            number += 1
            own.append((number, base + rng.randrange(-5_000_000, MINUTE + 15_000_000, 10_000), rng.choice([1, 1, 1, 2]), rng.randint(0, 1)))
        known = [r for r in own if not start <= r[1] < end and rng.random() > 0.02]
        shift = 700_000 if rng.random() < 0.05 else 0
        window = [] if rng.random() < 0.05 else [(i + 1_000_000, us + rng.randrange(-90_000, 480_000, 10_000) + shift, p, q) for i, us, p, q in own]
        if rng.random() < 0.08:
            window = [r for r in window if r[1] >= start]
        elif window:
            number += 1
            window.append((number + 1_000_000, base - 9_000_000, 1, 0))
        fetched = end + rng.choice([100_000, 900_000, 900_000, 900_000, 900_000])
        gaps.append((f"g{g}", symbol, start, end, fetched))
        windows += [(f"g{g}", *r) for r in window]
        trades += [(symbol, *r) for r in known]
        expected[f"g{g}"] = plain_repair((start, end, fetched), window, known, -100_000, 500_000)
    decisions, put_in = repair.repaired(
        spark.createDataFrame(gaps, "gap_id string, symbol string, start_us long, end_us long, fetched_us long"),
        spark.createDataFrame(windows, "gap_id string, id long, created_us long, price long, qty long"),
        spark.createDataFrame(trades, "symbol string, id long, us long, price long, qty long"), -100_000, 500_000,
    )
    got = {r.gap_id: (r.code, []) for r in decisions.collect()}
    for r in put_in.collect():
        got[r.gap_id][1].append(r.id)
    assert {k: (code, sorted(ids)) for k, (code, ids) in got.items()} == expected
    assert {code for code, _ in expected.values()} == set(repair.CODES)
    assert all(r.recovered == len(expected[r.gap_id][1]) for r in decisions.collect())


def plain_held(rows, grace, deadline):
    """What held_minutes() gives for the rows of one symbol, looking at them in order of receipt."""
    gaps = {}
    for r in rows:
        if r["kind"] == "LOST":
            gaps[r["gap"]] = [r["us"], None, None]
    for r in rows:
        if r["kind"] == "BACK":
            gaps[r["gap"]][1] = r["us"]
    for r in rows:
        if r["kind"] == "RESOLVED" and r["recv_us"] < gaps[r["gap"]][1] + deadline and gaps[r["gap"]][2] is None:
            gaps[r["gap"]][2] = r["recv_us"]
    due = lambda m: max([m + MINUTE + grace, *(g[1] + deadline if g[2] is None else g[2] for g in gaps.values() if g[0] < m + MINUTE)])
    out, held_ = [], {}
    for r in rows:
        m = r["us"] // MINUTE * MINUTE
        if r["kind"] == "RESOLVED" and gaps[r["gap"]][2] != r["recv_us"]:
            out.append(("LATE_REPAIR", r["gap"], 0))
        elif r["kind"] == "REPAIR" and r["recv_us"] < gaps[r["gap"]][1] + deadline and (gaps[r["gap"]][2] or r["recv_us"]) >= r["recv_us"]:
            held_.setdefault(m, {})[r["us"], r["trade_id"]] = 1
        elif r["kind"] == "TRADE":
            if due(m) <= r["recv_us"]:
                out.append(("LATE", r["us"], 1))
            else:
                held_.setdefault(m, {})[r["us"], r["trade_id"]] = 1
    clock = max(r["recv_us"] for r in rows) // 1000 * 1000
    for m, own in held_.items():
        if due(m) <= clock:
            cut = [g for g in gaps.values() if g[0] < m + MINUTE and g[1] > m]
            out.append(("DATA_GAP" if any(g[2] is None for g in cut) else "REPAIRED" if cut else "OK", m, len(own)))
    return sorted(out)


@pytest.mark.parametrize("files", [1, 5])
def test_held_minutes_do_not_depend_on_batches(spark, files):
    rng = random.Random(4)
    grace, deadline, rows, number = 2_000_000, 200_000_000, [], 0

    def add(recv, kind, us, gap=-1, trade=-1):
        rows.append({"recv_us": recv, "kind": kind, "us": us, "gap": gap, "trade_id": trade})

    for g in range(12):
        start = 100 * MINUTE + g * 9 * MINUTE + rng.randrange(0, MINUTE, 1000)
        end = start + rng.randrange(MINUTE, 3 * MINUTE, 1000)
        add(start, "LOST", start, g)
        add(end, "BACK", end, g)
        fixed = end + rng.choice([40_000_000, 120_000_000, 260_000_000]) + 7
        fate = rng.choice(["yes", "yes", "twice", "no"])
        for us in sorted(rng.randrange(start, end, 1000) for _ in range(6)):
            number += 1
            if fate != "no":
                add(fixed, "REPAIR", us, g, number)
        if fate != "no":
            add(fixed, "RESOLVED", start, g)
        for _ in range(60):
            number += 1
            us = start - 2 * MINUTE + rng.randrange(0, 9 * MINUTE, 1000)
            if not start <= us < end:
                add(us + rng.choice([100_000, 100_000, 100_000, 90_000_000]) + 3, "TRADE", us, -1, number)
    rank = {"LOST": 0, "BACK": 1, "TRADE": 2, "REPAIR": 3, "RESOLVED": 4}
    rows.sort(key=lambda r: (r["recv_us"], rank[r["kind"]], r["trade_id"]))
    schema = "symbol string, recv timestamp, recv_us long, seq long, kind string, us long, trade_id long, px double, gap long"
    import datetime

    made = [("s", datetime.datetime.fromtimestamp(0, datetime.UTC) + datetime.timedelta(microseconds=r["recv_us"]), r["recv_us"], i, r["kind"], r["us"], r["trade_id"], 1.0, r["gap"]) for i, r in enumerate(rows)]
    step = -(-len(made) // files)
    frames = [made[i : i + step] for i in range(0, len(made), step)]
    got = run_stream(spark, frames, schema, lambda s: held.held_minutes(s, grace, deadline), folder(spark), restart_after=files // 2 or None)
    assert sorted((r.kind, r.open_us, r.n) for r in got.collect()) == plain_held(rows, grace, deadline)
    assert {r.kind for r in got.collect()} == {"OK", "REPAIRED", "DATA_GAP", "LATE", "LATE_REPAIR"}


def test_held_minutes_look_at_their_gaps_once_a_minute():
    work = held.HeldMinutes(2_000_000, 200_000_000)
    work.held, work.now = {}, 0
    work.open = {g: [g, g * 9 * MINUTE, g * 9 * MINUTE + MINUTE, 1 << 62, False] for g in range(50)}
    asked, final_at = [], work._final_at
    work._final_at = lambda minute: asked.append(minute) or final_at(minute)
    us = [k * MINUTE // 500 for k in range(5000)]
    rows = held.pd.DataFrame({"recv_us": us, "us": us, "trade_id": range(5000), "px": 1.0, "gap": -1, "kind": "TRADE"})
    done = list(work._trades("s", rows))
    assert sum(r[-1] for r in done) + sum(map(len, work.held.values())) == 5000 and {r[1] for r in done} == {"DATA_GAP", "OK"}
    assert len(asked) < 100  # 10 minutes; once a trade before


def test_orders_advance_as_in_a_race_over_a_restart(spark):
    rng = random.Random(8)
    price, bars, orders = 100.0, [], []
    for i in range(300):
        price += rng.gauss(0, 1)
        bars.append(("s", i, price + abs(rng.gauss(0, 1)), price - abs(rng.gauss(0, 1))))
        if i % 4 == 0:
            side = rng.choice([1, -1])
            entry = price - side * rng.random() * 2
            entry -= side * 15 * (i % 3 == 0)
            orders.append((f"o{i}", "s", side, i, entry, entry - side * 2, entry + side * (3 if i % 3 else 60)))
    frame = spark.createDataFrame(orders, "id string, symbol string, dir int, created_idx long, entry double, stop double, target double")
    raced = simulate.race(frame, spark.createDataFrame(bars, "symbol string, idx long, high double, low double"), hold=30, expiry=10)
    expected = {r.id: (r.filled_idx, r.exit_idx, r.state) for r in raced.collect()}
    rows = [("s", "BAR", i, h, low, None, None, None, None, None) for _, i, h, low in bars]
    rows += [("s", "ORDER", i, None, None, o, side, e, s, t) for o, _, side, i, e, s, t in orders]
    frames = [[r for r in rows if lo <= r[2] < hi] for lo, hi in ((0, 70), (70, 71), (71, 200), (200, 300))]
    frames[2] += [r for r in frames[0] if r[2] > 60]  # bars and orders that come again
    where = folder(spark)
    events = run_stream(spark, frames, advance.ROW, lambda s: advance.advanced_orders(s, hold=30, expiry=10), where, restart_after=2)
    late = events.where("kind = 'LATE'").count()
    got = {r.id: (r.filled_idx, r.exit_idx, r.state) for r in advance.order_states(events.where("kind <> 'LATE'")).collect()}
    assert got == expected and {s for *_, s in got.values()} >= {"TP", "SL", "MISSED", "EXPIRED"}
    assert late <= sum(60 < o[3] < 70 for o in orders)  # those that had ended when they came again


def plain_proofs(rows, safety):
    """{trade: state} and the covered spans, over all rows at once."""
    sessions, receipts = {}, {}
    for conn in {r[0] for r in rows}:
        n = 0
        for _, at, i, kind, sent in sorted((r for r in rows if r[0] == conn), key=lambda r: (r[1], r[2])):
            n += kind == "LOST"
            s = sessions.setdefault((conn, n), [None, None])
            if kind == "PONG":
                s[:] = [min(at + safety, s[0]) if s[0] is not None else at + safety, max(sent, s[1]) if s[1] is not None else sent]
            elif kind == "TRADE":
                receipts.setdefault(i, []).append((conn, n, at))
    last = {c: max(n for d, n in sessions if d == c) for c, _ in sessions}
    states = {}
    for i, own in receipts.items():
        shown = [(at, sessions[c, n]) for c, n, at in own if sessions[c, n][1] is not None and at <= sessions[c, n][1]]
        covered = any(s[0] <= at for at, s in shown)
        states[i] = "PROVEN" if covered else "IN_GAP" if shown else "ORPHAN" if all(n < last[c] for c, n, _ in own) else "PENDING"
    return states, {(c, n): (s[0], max(s[0], s[1] - safety)) for (c, n), s in sessions.items() if s[0] is not None}


def test_proofs_with_late_pongs(spark):
    rng = random.Random(6)
    rows = []
    for i in range(900):
        at = i * 1000 + rng.randrange(0, 900)
        kind = rng.choices(["TRADE", "PONG", "LOST"], [8, 3, 0.4])[0]
        for conn in rng.sample(range(3), 2 if kind == "TRADE" and i % 2 else 1):
            rows.append((conn, at + conn, i, kind, at - 400 if kind == "PONG" else None))
    states, spans = plain_proofs(rows, 300)
    file = lambda r: min(5, r[1] // 225_000 + (2 if r[3] == "PONG" and r[2] % 5 == 0 else 0))
    frames = [[r for r in rows if file(r) == k] for k in range(6)]
    schema = "conn long, at_us long, id long, kind string, sent_us long"
    events = run_stream(spark, frames, schema, lambda s: proof.proofs(s, 300, 1 << 40), folder(spark), restart_after=3)
    assert {r.trade_id: r.state for r in proof.releases(events).collect()} == states
    assert {(r.conn, r.session): (r.start, r.end) for r in proof.spans_of(events, 300).collect()} == spans
    assert set(states.values()) == {"PROVEN", "IN_GAP", "ORPHAN", "PENDING"}


def test_proofs_of_batches_are_those_of_state(spark):
    rng = random.Random(16)
    rows = []
    for i in range(900):
        at = i * 1000 + rng.randrange(0, 900)
        kind = rng.choices(["TRADE", "PONG", "LOST"], [8, 3, 0.4])[0]
        for conn in rng.sample(range(3), 2 if kind == "TRADE" and i % 2 else 1):
            rows.append((conn, at + conn, i, kind, at - 400 if kind == "PONG" else None))
    states, spans = plain_proofs(rows, 300)
    file = lambda r: min(5, r[1] // 225_000 + (2 if r[3] == "PONG" and r[2] % 5 == 0 else 0))
    frames = [[r for r in rows if file(r) == k] for k in range(6)]
    frames[2] += [r for r in frames[1] if r[3] == "LOST"]  # losses that come again
    schema = "conn long, at_us long, id long, kind string, sent_us long"
    where = folder(spark)
    for group in (frames[:3], frames[3:]):  # the stream stops between
        for own in group:
            spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
        proof.prove_batches(S.read_tape(spark, f"{where}/in", schema), where, f"{where}/state", 300, 1 << 40)
    events = proof.events_of(spark, where)
    assert {r.trade_id: r.state for r in proof.releases(events).collect()} == states
    assert {(r.conn, r.session): (r.start, r.end) for r in proof.spans_of(events, 300).collect()} == spans
    marks = [tuple(r) for r in events.where("kind in ('SHOWN', 'COVERED')").select("kind", "conn", "trade_id").collect()]
    assert len(marks) == len(set(marks))  # each is told once
    first = sorted(map(tuple, events.fillna(-1).collect()))
    proof.prove_batches(S.read_tape(spark, f"{where}/in", schema), where, f"{where}/state-lost", 300, 1 << 40)  # every batch once more
    assert sorted(map(tuple, proof.events_of(spark, where).fillna(-1).collect())) == first


def test_batches_give_what_one_alignment_gives(spark):
    matched, single = matching.finish(spark, live._reconciled(spark, SF_DIR), ["event_type", "fp"], live.EARLY, live.LATE)
    a, b = live.records._feeds(spark, SF_DIR)
    whole = {tuple(r) for r in C.aligned(a, b, ["event_type", "fp"], live.EARLY, live.LATE).collect()}
    got = [tuple(r) for r in matched.collect()]
    assert len(got) == len(set(got)) and set(got) == whole
    alone = {(0, r.id) for r in a.collect()} | {(1, r.id) for r in b.collect()}
    alone -= {(0, x) for x, _ in whole} | {(1, y) for _, y in whole}
    rows = [tuple(r) for r in single.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == alone


def test_a_batch_of_revisions_that_comes_again_changes_nothing(spark):
    import datetime

    at = lambda m, s: datetime.datetime(2024, 1, 1 + m // 1440, m // 60 % 24, m % 60, s)
    frames = [[("s", at(m, 5 * k), 10 * m + k, float(m + k), 1.0) for m in (0, 1, 1500)] for k in range(3)]
    schema = "symbol string, ts timestamp, trade_id long, px double, qty double"
    where = folder(spark)
    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{where}/in")
    S.revise_batches(S.read_tape(spark, f"{where}/in", schema), where, f"{where}/state")
    first = sorted(map(tuple, S.revised_minutes(spark, where).collect()))
    S.revise_batches(S.read_tape(spark, f"{where}/in", schema), where, f"{where}/state-lost")  # every batch once more
    assert sorted(map(tuple, S.revised_minutes(spark, where).collect())) == first
    assert {r.n for r in S.revised_minutes(spark, where).collect()} == {3}


def test_wallets_have_every_note_and_add_up(spark):
    rows = live._booked(spark, SF_DIR)[0].collect()
    notes = {r.note for r in rows}
    assert {"WALLET_EMPTY", "NO_FREE_MARGIN", "SIZE_BELOW_STEP", "MARGIN_LIMITED", "LIQ_LIMITED"} <= notes or SF_DIR.endswith("sf0.001")
    for name, initial, *_ in live.WALLETS:
        own = sorted((r for r in rows if r.wallet == name), key=lambda r: r.seq)
        balance = initial
        for r in own:
            balance += r.amount
            assert abs(balance - r.balance) < 1e-6 and r.margin >= -1e-9


def test_wallet_by_hand(spark):
    trades = spark.createDataFrame(
        [("a", "s", 1, 100.0, 90.0, 1, 2, 9, 120.0), ("b", "s", -1, 100.0, 110.0, 3, None, 5, None), ("c", "s", 1, 50.0, 49.0, 4, 4, 4, 49.0), ("d", "s", 1, 10.0, 9.0, 9, None, None, None)],
        "id string, symbol string, dir int, entry double, stop double, created_at long, filled_at long, ended_at long, price double",
    )
    fundings = spark.createDataFrame([("a", 8, 110.0)], "id string, at long, price double")
    wallets = spark.createDataFrame([("w", 1000.0, 0.1, 2.0, 1.0, 0.0, 0.005)], "wallet string, initial double, risk double, leverage double, step double, buffer double, maintenance double")
    rows = W.ledger(W.events_of(trades, fundings), wallets, 0.0, 0.0, 0.01)
    got = [(r.at, r.id, r.kind, r.note, r.qty, round(r.amount, 6), round(r.balance, 6), round(r.margin, 6)) for r in sorted(rows.collect(), key=lambda r: r.seq)]
    assert got == [
        (1, "a", "OPENED", "", 10.0, 0.0, 1000.0, 500.0),
        (3, "b", "OPENED", "", 10.0, 0.0, 1000.0, 1000.0),
        (4, "c", "REJECTED", "NO_FREE_MARGIN", 0.0, 0.0, 1000.0, 1000.0),
        (5, "b", "RELEASED", "", 10.0, 0.0, 1000.0, 500.0),
        (8, "a", "FUNDING", "", 10.0, -11.0, 989.0, 500.0),
        (9, "a", "REALIZED_PNL", "", 10.0, 200.0, 1189.0, 0.0),
        (9, "d", "OPENED", "", 118.0, 0.0, 1189.0, 590.0),
    ]
    prices = spark.createDataFrame([("s", 12.0)], "symbol string, price double")
    view = W.views(rows, wallets, trades, prices, 0.0, 0.0).first()
    assert (round(view.balance, 6), round(view.free, 6), view.open, view.rejected, view.unrealized) == (1189.0, 599.0, 1, 1, 0.0)
