import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from annoscope.llm import quality as q


def corpus(seed, n=600):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rnd.choice(["the", "über", "ation", "en", "re", "for", "heit"]) + rnd.choice("aeiou") * rnd.randrange(3) for _ in range(rnd.randrange(5, 80))]
        good = rnd.random() < 0.75
        if not good:
            kind = rnd.randrange(3)
            words = [w + "***" for w in words] if kind == 0 else words[:1] * 60 if kind == 1 else [x for w in words for x in (w, "|")]
        rows.append((i, " ".join(words)))
        if rnd.random() < 0.7:
            labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark):
    rows, labels = corpus(1)
    rows += [(1000, None), (1001, ""), (None, "the end"), (5, "x"), (1002, "a " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = spark.createDataFrame(labels + [(7777, 1), (3, None), (None, 0)], "doc_id long, quality int")
    got = q.classify(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
    truth = dict(labels)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.95
    flipped = [(i, 1 - y) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, y) for i, y in labels]
    again = q.classify(docs, spark.createDataFrame(flipped, "doc_id long, quality int")).collect()
    key = lambda r: (str(r.doc_id), round(r.score, 6))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_stage_keeps_columns_and_degenerate_labels(spark):
    rows, labels = corpus(2, 200)
    docs = spark.createDataFrame([(i, t, "s", i * 2) for i, t in rows], "doc_id long, text string, score string, stats long")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    kept = q.keep_good(docs, marks)
    want = {r.doc_id for r in q.classify(docs, marks).collect() if r.predicted}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    none = q.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r.score for r in none} == {0.5}
    one = q.classify(docs, spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, quality int")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.9
    assert q.classify(spark.createDataFrame([], "doc_id long, text string"), marks).collect() == []


def test_statistics_against_plain_python():
    texts = ["The cat. The cat sat!\nThe cat sat!", "", None, "é É 12 | x\n\n", "a a a b"]
    got = q.statistics(pa.array(texts))
    base = len(q._CLASSES) + 1
    for i, t in enumerate(texts):
        w = (t or "").split()
        n = max(len(w), 1)
        assert got[i, base] == pytest.approx(np.log1p(len(w)))
        assert got[i, base + 1] == pytest.approx(sum(len(x.encode()) for x in w) / n)
        assert got[i, base + 3] == pytest.approx(len(set(w)) / n)
        assert got[i, base + 4] == pytest.approx(max([w.count(x) for x in w], default=0) / n)
        pairs = list(zip(w, w[1:]))
        assert got[i, base + 5] == pytest.approx(len(set(pairs)) / max(len(pairs), 1))
        assert got[i, base + 7] == pytest.approx(sum(a == b for a, b in pairs) / n)
        assert got[i, :base].sum() == pytest.approx(1.0 if t else 0.0)


def test_isotonic_pools():
    x, y = q._isotonic(np.array([0.0, 1, 2, 3]), np.array([1.0, 0, 2, 4]), np.array([2.0, 2, 4, 4]))
    assert np.all(np.diff(x) > 0) and np.all(np.diff(y) >= 0) and x.tolist() == [0, 1, 2, 3] and y[0] == y[1] == 1.5 / 5
