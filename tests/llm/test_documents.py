import hashlib
import random
import re

import numpy as np
import pytest

from tapeloom.llm import ann, decontaminate, langid, linededup, neardup, pii, quality


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def near_docs():
    base = [words(120, s) for s in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for k in range(60):
        w = base[k % 6].split()
        w[(7 * k) % 100] = f"x{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(300 + k, base[7]) for k in range(40)]
    return rows + [(400, None), (401, ""), (402, "a b"), (403, "A  b"), (404, "  \n "), (0, base[0]), (None, base[3])]


def groups_of(rows, similarity=0.75):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (name, _), g in zip(rows, group):
        if name is not None:
            least[g] = min(least.get(g, name), name)
    return [(name, len(s), least.get(g, name)) for (name, _), s, g in zip(rows, sets, group)]


@pytest.mark.parametrize("small", [512, 8])  # 8: the branching and block paths
def test_near_duplicates_equal_all_pairs(spark, small):
    rows = near_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "'x' as key", "2 as node").repartition(4)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, small=small).collect()]
    order = lambda x: tuple((v is None, v or 0) for v in x)
    assert sorted(got, key=order) == sorted(groups_of(rows), key=order)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contamination_equals_plain_search(spark):
    items = [(i, words(n, 50 + i)) for i, n in enumerate((9, 12, 30, 1, 14))] + [(5, None), (6, "!!"), (7, words(12, 51))]
    rows = [(i, words(60, i)) for i in range(20)]
    rows += [(30, f"Start {items[1][1].upper()} end"), (31, f"é {items[0][1]}, x; {items[2][1][:200]}"), (32, None), (33, ""), (34, "w1"), (30, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as row", "2 as doc", "3 as hits")
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for name, text in items:
        w = pattern.findall(low(text))
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    expected = []
    for name, text in rows:
        w = pattern.findall(low(text))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        expected.append((name, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect())) == sorted(expected)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not e[-1] for e in expected)
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect() if r.doc_id != 30}
    assert cut[1] == rows[1][1] and cut[32] is None
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_repeated_chunks_leave_once(spark):
    passage = words(60, 1)
    block = "\n".join(words(8, s) for s in range(90, 96))
    rows = [(i, f"{words(9, 200 + i)}\n{passage}\n{words(9, 300 + i)}") for i in range(30)]
    rows += [(100 + i, f"{words(9, 400 + i)}\n{block}\n{words(9, 500 + i)}") for i in range(6)]
    rows += [(200, None), (201, ""), (202, "\n\n\n"), (203, "\n\n\n"), (204, words(5, 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "2 as did", "3 as gone").repartition(4)
    done = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert len(done) == len(rows)
    assert [i for i in range(30) if passage in done[i].text] == [0]
    for i in range(30):
        assert words(9, 200 + i) in done[i].text and words(9, 300 + i) in done[i].text
    assert done[100].text == dict(rows)[100] and sum(done[100 + i].lines_removed for i in range(1, 6)) >= 5
    for name in (200, 201, 202, 203, 204):
        assert done[name].text == dict(rows)[name]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_passages_of_short_lines_leave_everywhere(spark):
    rows, passages = [], {}
    for n in range(2, 7):  # lines of a passage of over 50 words
        for p in range(4):
            passages[n, p] = [words(60 // n + k % 2, f"{n} {p} {k}") for k in range(n)]
            for copy in range(5):
                r = random.Random(f"{n} {p} {copy}")
                private = lambda: [words(r.randrange(2, 9), r.random(), 10**6) for _ in range(r.randrange(1, 8))]
                rows.append((len(rows), "\n".join([*private(), *passages[n, p], *private()])))
    again = "\n".join([words(10, 7)] * 20)
    rows.append((len(rows), again))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    done = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    for i, (_, text) in enumerate(rows[:-1]):
        passage = list(passages.values())[i // 5]
        gone = set() if i % 5 == 0 else set(passage)
        assert done[i].text.split("\n") == [line for line in text.split("\n") if line not in gone]
        assert done[i].lines_removed == len(gone)
    assert set(done[len(rows) - 1].text.split("\n")) == {words(10, 7)}


def test_chunks_cover_all_lines():
    text = "\n".join(words(n, n) for n in (3, 70, 1, 2, 9, 60, 80, 4))
    chunks = linededup.chunks_of(text)
    assert [a for a, _, _ in chunks] == [0, *(b for _, b, _ in chunks[:-1])] and chunks[-1][1] == 8
    assert (1, 2, True) in chunks


def test_languages(spark):
    stems = {"aa": "the and ing tion", "bb": "der und sch keit", "cc": "les que ment eau"}
    rows = []
    for lang, parts in stems.items():
        for i in range(60):
            r = random.Random(f"{lang}{i}")
            rows.append((len(rows), " ".join(r.choice(parts.split()) + r.choice(parts.split()) for _ in range(40)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 3 <> 0"))
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "123 !?"), (903, "日本語")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.predict(docs.select("doc_id", "text").unionByName(odd), model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 and not got[i].rejected for i, _, lang in rows)
    assert all(got[i].lang_pred == "und" and got[i].rejected for i in (900, 901, 902)) and got[903].rejected
    kept = langid.accepted(docs.selectExpr("*", "1 as rejected"), model)
    assert kept.count() == len(rows) and "rejected" in kept.columns
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_junk_is_rejected_and_clean_text_is_not(spark):
    stems = {"aa": "the and ing tion", "bb": "der und sch keit", "cc": "les que ment eau"}
    r = random.Random(5)
    texts = {lang: [" ".join(r.choice(p.split()) + r.choice(p.split()) for _ in range(r.choice((3, 10, 40, 200)))) for _ in range(150)] for lang, p in stems.items()}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, ts in texts.items() for t in ts)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").where("doc_id % 2 = 0"))
    junk = ["".join(r.choice("bcdfgjklmpqvwxz") + (" " if r.random() < 0.2 else "") for _ in range(n)) for n in (60, 200, 2000)] + ["日本語の文章です。" * 20]
    docs = rows + [(1000 + i, t, None) for i, t in enumerate(junk)] + [(2000, texts["aa"][0], None), (2000, texts["aa"][0], None)]
    got = langid.predict(spark.createDataFrame(docs, "doc_id long, text string, lang string"), model).collect()
    assert {x.doc_id for x in got if x.rejected} == {1000, 1001, 1002, 1003}
    held = [x for x in got if x.doc_id < 1000 and x.doc_id % 2]
    assert all(x.lang_pred == rows[x.doc_id][2] for x in held)
    assert len({(x.lang_pred, x.score) for x in got if x.doc_id == 2000}) == 1


def test_quality_on_held_out_rows_and_repeated_ones(spark):
    rows = [(i, words(20 + i % 30, i) + ".", 1) for i in range(200)] + [(200 + i, words(20 + i % 30, i).upper().replace(" ", " | "), 0) for i in range(100)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = quality.fit(labelled.where("doc_id % 3 <> 1"), trees=4)
    docs = labelled.drop("label").unionByName(labelled.where("doc_id = 1").drop("label")).selectExpr("*", "1 as length", "'x' as bars")
    got = quality.score(docs, model).collect()
    truth = {i: label for i, _, label in rows}
    held = [x for x in got if x.doc_id % 3 == 1]
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.95 * len(held)
    assert len(got) == 301 and len({x.score for x in got if x.doc_id == 1}) == 1
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_rules(spark):
    rows = [(words(30, i) + ".", 1) for i in range(150)] + [(words(30, i).replace(" ", "### "), 0) for i in range(60)]
    labelled = spark.createDataFrame(rows, "text string, label int")
    model = quality.fit(labelled, trees=4)
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(900, None), (901, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert sum(got[i].predicted == label for i, (_, label) in enumerate(rows)) >= 0.97 * len(rows)
    assert got[900].score == got[901].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert quality.score(docs, quality.fit(labelled.limit(0))).where("score <> 0.5").count() == 0


def test_tree_paths_become_rules():
    text = """Model
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0"""
    assert quality.tree_rules(text, ["a", "b"]) == {
        (("a", False, 0.5),), (("a", False, 0.5), ("b", False, 2.0)), (("a", False, 0.5), ("b", True, 2.0)), (("a", True, 0.5),),
    }


def luhn(text):
    digits = [int(c) for c in text if c.isdigit()][::-1]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits)) % 10 == 0


def test_pseudonyms(spark):
    rows = [
        (1, "Card 4111 1111 1111 1111 and 4111-1111-1111-1111, not 4111 1111 1111 1112."), (2, "pay 4111111111111111 now"),
        (3, "mail Jo.Doe34@mail7.example.com, +1 (017) 555-7713; ip 152.143.123.131."), (4, "on 2024-02-29, 13/02/2020 and 9999-99-99"),
        (5, "GB82 WEST 1234 5698 7654 32 here"), (6, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 300.1.1.1 123-45-6789'),
        (7, None), (8, ""), (9, "plain words 12 and 2024"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as new", "2 as found")
    done = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    cards = re.findall(r"\d[\d -]{14,}\d", done[1].text)
    assert luhn(cards[0]) and cards[0].replace(" ", "") == cards[1].replace("-", "") == re.findall(r"\d{16}", done[2].text)[0] != "4111111111111111"
    assert "4111 1111 1111 1112" in done[1].text and done[1].n_card == 2
    for old in ("Jo.Doe34", "017) 555-7713", "152.143.123.131"):
        assert old not in done[3].text
    assert re.fullmatch(r"mail [A-Z][a-z]\.[A-Z][a-z]{2}\d\d@[a-z]{4}\d\.[a-z]{7}\.com, \+\d \(\d{3}\) \d{3}-\d{4}; ip (\d{1,3}\.){3}\d{1,3}\.", done[3].text)
    assert re.fullmatch(r"on (19|20)\d\d-\d\d-\d\d, \d\d/\d\d/(19|20)\d\d and 9999-99-99", done[4].text) and "2024-02-29" not in done[4].text
    iban = re.match(r"GB[\dA-Z ]{25}", done[5].text)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and "WEST" not in done[5].text
    assert "24be64439e3e" not in done[6].text and "300.1.1.1" in done[6].text and done[6].n_secret == done[6].n_national == 1
    assert [done[i].text for i in (7, 8, 9)] == [None, "", "plain words 12 and 2024"]
    again = {r.doc_id: r.text for r in pii.pseudonymise(docs, "other").collect()}
    assert again[2] != done[2].text


def test_values_beside_values_get_pseudonyms(spark):
    card, iban, day, number, phone, ip = "4111 1111 1111 1111", "BE68539007547034", "2024-01-05", "123-45-6789", "555-123-4567", "10.1.2.3"
    austrian = "AT61 1904 3002 3457 3201"
    texts = {
        1: (f"card {card} 123", {"card": 1}), 2: (f"{day} 2024-01-06", {"date": 2}), 3: (f"{number} {phone}", {"national": 1, "phone": 1}),
        4: (f"pay {iban} EUR 20", {"iban": 1}), 5: (f"pay {austrian} EUR 20 to {iban}", {"iban": 2}), 6: (f"5 {number} {phone}, {card} {day}", {"national": 1, "phone": 1, "card": 1, "date": 1}),
        7: (f"+32 470 12 34 56 {day} {ip}", {"phone": 1, "date": 1, "ip": 1}), 8: (f"a%{card}@x1.com😀 {day}", {"card": 1, "date": 1}),
        9: (f"{card}", {"card": 1}), 10: (f"{day}", {"date": 1}), 11: (f"{number}", {"national": 1}), 12: (f"{phone}", {"phone": 1}), 13: (f"{iban}", {"iban": 1}),
        14: ("4111 1111 1111 1112 123, 300.1.1.1 and 9999-99-99", {}), 15: ("41 11 1111 1111 1111 11", {"card": 1}),
    }
    docs = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    done = {r.doc_id: r for r in pii.pseudonymise(docs, "k").collect()}
    for i, (text, counts) in texts.items():
        if i != 8:
            assert {k: n for k in pii.KINDS if (n := done[i][f"n_{k}"])} == counts, (text, done[i])
        for value in (card, iban, austrian, day, "2024-01-06", number, phone, "470 12 34 56", ip):
            assert value not in text or value not in done[i].text, (text, done[i].text)
    new = {k: done[i].text for k, i in (("card", 9), ("day", 10), ("number", 11), ("phone", 12), ("iban", 13))}
    assert done[1].text == f"card {new['card']} 123" and done[2].text.startswith(new["day"] + " ")
    assert done[3].text == f"{new['number']} {new['phone']}" and done[4].text == f"pay {new['iban']} EUR 20"
    assert done[6].text == f"5 {new['number']} {new['phone']}, {new['card']} {new['day']}" and done[5].text.endswith(f" EUR 20 to {new['iban']}")
    assert done[14].text == texts[14][0] and done[8].text.endswith(f"😀 {new['day']}")


def test_pseudonyms_of_long_runs_and_of_nothing(spark):
    run = "0123456789abcdef" * 20_000
    rows = [(1, f"key {run} end"), (2, f"mail {'a.b' * 5000}@x.example.com"), (3, f"again {run}"), (3, f"again {run}"), (4, "1 2 3 " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as m", "2 as g")
    done = pii.pseudonymise(docs, "k").orderBy("doc_id").collect()
    new = re.fullmatch(r"key ([0-9a-f]+) end", done[0].text)[1]
    assert len(new) == len(run) and new != run and done[2].text == done[3].text == f"again {new}"
    assert done[1].text.endswith("@" + done[1].text.split("@")[1]) and len(done[1].text) == len(rows[1][1]) and "a.ba.b" not in done[1].text
    assert len(done[4].text) == len(rows[4][1])
    assert pii.pseudonymise(docs.limit(0), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    sql = pii._feistel("array(id div 13, id % 13)", "array(7, 13)", "key")
    got = [tuple(r.v) for r in spark.range(91).selectExpr(f"{sql} as v").collect()]
    assert len(set(got)) == 91 and all(0 <= a < 7 and 0 <= b < 13 for a, b in got)


def test_nearest_neighbours(spark):
    r = np.random.default_rng(0)
    points = r.normal(size=(600, 16))
    points[100:250] = points[100]
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    rows += [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0] * 3), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for x in ann.nearest(frame, "vec_id % 50 = 0", 5).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(range(0, 600, 50))
    for q, found in got.items():
        sims = unit @ unit[q]
        sims[q] = -9
        best = np.lexsort((np.arange(600), -np.round(sims, 12)))[:5]
        hits += len({v for _, v, _ in found} & set(best.tolist()))
        assert [k for k, _, _ in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(s - sims[v]) < 1e-12 for _, v, s in found)
    assert hits >= 0.95 * 5 * len(got)
    assert ann.nearest(frame.limit(0), "vec_id % 50 = 0", 5).count() == 0
