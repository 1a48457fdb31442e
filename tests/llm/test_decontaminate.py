import random
import re

import numpy as np
import pyarrow as pa

from annoscope.llm import decontaminate as dc


def norm(t):
    return re.sub(r"\s+", " ", t.lower())


def distance_in(item, text):
    """Least edits of the whole item anywhere in the text (Sellers)."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def sample(rnd, n):
    return " ".join("".join(rnd.choice(["th", "er", "on", "é", "an", "ß"]) for _ in range(rnd.randrange(1, 5))) for _ in range(n))


def edited(rnd, t, n):
    for _ in range(n):
        i = rnd.randrange(len(t))
        t = rnd.choice([t[:i] + t[i + 1:], t[:i] + "x" + t[i:], t[:i] + "z" + t[i + 1:]])
    return t


def test_every_item_within_the_budget_is_found(spark):
    rnd = random.Random(3)
    items = [(i, sample(rnd, rnd.randrange(6, 40))) for i in range(25)] + [(30, None), (31, "short"), (32, ""), (33, "  "), (None, sample(rnd, 20))]
    rows = []
    for d in range(120):
        t = sample(rnd, rnd.randrange(0, 60))
        if rnd.random() < 0.6:
            item = rnd.choice(items[:25])[1]
            t += " " + edited(rnd, item, rnd.randrange(0, max(1, len(item) // 6))).replace(" ", rnd.choice([" ", "\n", "  "])) + " " + sample(rnd, rnd.randrange(0, 30))
        rows.append((d if d != 50 else None, t.upper() if rnd.random() < 0.3 and "ß" not in t else t))
    rows += [(200, None), (201, ""), (202, items[0][1]), (202, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.find_leaks(docs, bench).collect()
    ix = dc.index([x for x in items if x[1]])
    budget = {i: int(ix.edits[k]) for k, i in enumerate(ix.ids)}
    want = {(d, i) for d, t in rows for i, x in items if t and x and i in budget
            and distance_in(norm(x).strip(), norm(t)) <= budget[i]}
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 30
    texts, by_id = dict(rows), dict(items)
    for r in got:
        if r.doc_id is not None:
            assert distance_in(norm(by_id[r.item_id]).strip(), norm(texts[r.doc_id])[:]) <= r.edits <= budget[r.item_id]
            assert abs(len(norm(texts[r.doc_id][r.begin:r.end])) - len(norm(by_id[r.item_id]).strip())) <= 2 * r.edits + 2
    assert sum(r.doc_id == 202 and r.item_id == 0 for r in got) == 2
    left = dc.drop_leaked(docs, bench).collect()
    assert sorted(r.text for r in left if r.text) == sorted(t for d, t in rows if t and not any(p[0] == d for p in want))
    blocks = dc.find_leaks(docs, bench, block_chars=1000).collect()
    assert {(r.doc_id, r.item_id) for r in blocks} == want


def test_long_items_by_segment_and_empty_tables(spark):
    rnd = random.Random(4)
    long_item = sample(rnd, 400)
    docs = spark.createDataFrame([(1, "a " + long_item[500:1300] + " b", "k"), (2, sample(rnd, 300), None)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, long_item)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.find_leaks(docs, bench).collect()} == {(1, 7)}
    assert [r.asDict() for r in dc.drop_leaked(docs, bench).collect()] == [docs.collect()[1].asDict()]
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(docs, none).collect() == [] and dc.drop_leaked(docs, none).count() == 2
    assert dc.find_leaks(spark.createDataFrame([], "doc_id long, text string"), bench).collect() == []


def test_gram_hashes_by_doubling():
    points = np.array([5, 6, 7, 5, 6, 7, 5, 6, 7, 8], dtype=np.uint32)
    for q in (1, 2, 3, 5, 6, 7, 8):
        h = dc._grams(points, q)
        assert len(h) == len(points) - q + 1
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (points[i:i + q].tolist() == points[j:j + q].tolist())
    assert pa.types.is_string(pa.array([""], pa.string()).type)


def test_copied_parts_of_items_are_found_with_their_range(spark):
    rnd = random.Random(5)
    question, long_item = sample(rnd, 200)[:390].strip(), sample(rnd, 500)[:2000].strip()
    parts = {0: (0, question[:312]), 1: (0, question[-312:]), 2: (1, long_item[-120:])}
    parts |= {10 + k: (1, long_item[at:at + 300]) for k, at in enumerate(range(0, 1700, 90))} | {50 + k: (1, long_item[at:at + 125]) for k, at in enumerate(range(3, 1800, 130))}
    rows = [(d, "some words before " + part + " and after") for d, (_, part) in parts.items()]
    rows += [(100, "other words " + sample(rnd, 80)), (101, "x " + question + " y"), (102, question[100:170])]
    bench = spark.createDataFrame([(0, question), (1, long_item)], "item_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted(tuple(r) for r in dc.find_leaks(docs, bench).collect())
    assert [(d, i) for d, i, *_ in got] == sorted([(d, i) for d, (i, _) in parts.items()] + [(101, 0)])
    for d, i, begin, end, edits in got:
        if d != 101:  # windows are half their length apart: up to that much at either end is not reported
            at, n = len("some words before "), len(parts[d][1])
            assert at - 2 <= begin <= at + dc.PASSAGE // 2 and at + n - dc.PASSAGE // 2 <= end <= at + n + 2 and edits <= 2
    assert next(g for g in got if g[0] == 101) == (101, 0, 2, 2 + len(question), 0)
    assert sorted(r.doc_id for r in dc.drop_leaked(docs, bench).collect()) == [100, 102]


def test_a_phrase_that_all_items_share_needs_little_memory(monkeypatch):
    import random
    import tracemalloc

    from annoscope.llm import decontaminate as D

    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9))) for _ in range(3000)]
    phrase = "Which of the following statements is correct? "
    items = [(i, (phrase + " ".join(rnd.choice(words) for _ in range(60)))[:400]) for i in range(2500)]
    ix = D.index(items)
    filler = [" ".join(rnd.choice(words) for _ in range(12)) for _ in range(60)]
    text = " ".join(f"{phrase}{f}" for f in filler[:30]) + " " + items[77][1] + " " + " ".join(f"{phrase}{f}" for f in filler[30:])
    table = pa.table({"text": [text, items[5][1]]})
    tracemalloc.start()
    got = list(D._search(ix, table))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(row, ix.ids[item]) for row, item, *_ in got} == {(0, 77), (1, 5)} and peak < 250 << 20
    monkeypatch.setattr(D, "_POSTINGS", 1000)
    small = D.index(items[:60] + [items[77]])
    parts = list(D._search(small, table))
    monkeypatch.setattr(D, "_POSTINGS", 1 << 40)
    assert parts == list(D._search(small, table)) and parts
