import math
import random
import re
from collections import Counter

from annoscope.llm import _exchange as ex
from annoscope.llm.near_dedup import IDF_STRENGTH, components, keep_one, near_duplicates


def brute(rows, similarity=0.8):
    """Components of all pairs whose exact weighted Jaccard similarity reaches the threshold."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        sets[i] = Counter(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    df = Counter(s for c in sets.values() for s in c)
    top = math.log(len(rows) + 1)
    idf = {s: 1 + IDF_STRENGTH * (top - math.log(n + 1)) / top for s, n in df.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            if sets[a] and sets[b]:
                low = sum(min(sets[a][s], sets[b][s]) * idf[s] for s in sets[a].keys() & sets[b].keys())
                high = sum(max(sets[a][s], sets[b][s]) * idf[s] for s in sets[a].keys() | sets[b].keys())
                if low >= similarity * high:
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
    return {i: find(i) for i in sets}


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = [a + b for a in "abcdefghij" for b in ("er", "on", "é", "ing", "x1")]
    rows, texts = [], []
    for i in range(220):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts).split()
            for _ in range(rnd.choice([0, 0, 1, 2, 4, 9])):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            t = " ".join(w)
        else:
            t = " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 5, 40, 90, 200])))
        texts.append(t)
        rows.append((i, t if rnd.random() < 0.8 else t.upper() + "!"))
    return rows + [(900, None), (901, ""), (902, " ... "), (903, None)]


def test_classes_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
        assert got == brute(rows)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    t = "one two three four five six seven"
    rows = [(5, t, 1, "x"), (5, t, 1, "x"), (9, t + ".", 2, None), (None, t, 3, "z"), (None, t, 3, "z"), (4, "else where", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id int, leader string")
    got = sorted(((r.doc_id, r.class_id) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 5), (9, 5), (4, 4), (None, None)], key=str)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 95: 90, 100: 90}


def test_rows_are_compared_not_ids(spark):
    t, u = "one two three four five six seven", "an altogether different text with eight words"
    rows = [(0, t, 1), (1, t, 2), (1, u, 3), (None, t, 4), (None, u + "!", 5), (None, "words of nobody else here at all", 6), (None, None, 7), (None, None, 8), (2, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int").repartition(3)
    left = sorted(((r.doc_id, r.text, r.digest) for r in keep_one(docs).collect()), key=str)
    assert left == sorted([rows[0], rows[2], *rows[5:]], key=str)
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == {0: 0, 1: 0, 2: 2, None: None}
    nobody = spark.createDataFrame([(None, t, 1), (None, t, 1), (None, t + ".", 2), (3, u, 1), (3, u, 1), (3, u, 1)], "doc_id long, text string, n int")
    got = [tuple(r) for r in keep_one(nobody).collect()]
    assert len(got) == 2 and (3, u, 1) in got
    assert keep_one(docs.limit(0)).collect() == []


def test_rows_without_an_id_spread_over_all_blocks(spark):
    rows = [(i if i % 3 else None, f"text {i} " + "word " * 40) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lay = ex.Layout(blocks=20, parts=4, tasks=4, rows=len(rows))
    sizes = [r["count"] for r in ex.dealt(docs, lay).groupBy(ex.CHUNK).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2 * len(rows) / 20
