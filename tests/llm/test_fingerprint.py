import hashlib
import random

import numpy as np

from annoscope.llm import fingerprint as fp

U = np.uint64


def points(t):
    return np.array([ord(c) for c in t], dtype=U) + U(1)


def naive(t, k=fp.K, s=fp.S, size=fp.SIZE):
    """Every k-mer by itself: an anchor if its least s-mer is its first or last."""
    one = lambda x: int(fp._rolled(points(x), len(x))[0])
    found = {}
    if 0 < len(t) < k:
        return [0]
    for i in range(len(t) - k + 1):
        g = t[i:i + k]
        inner = [one(g[j:j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(one(g) >> 24, i)
    return [h << 24 | p for h, p in sorted(found.items())[:size]]


def test_anchors_match_naive_selection():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab é日") for _ in range(n)) for n in (0, 3, 15, 16, 17, 40, 300, 700)] + ["ab" * 200, "x" * 100]
    for t, got in zip(texts, fp.fingerprints(texts)):
        want = naive(t)
        assert (len(got) == 1 and int(got[0]) & fp._POSITION == 0) if want == [0] else got.tolist() == want
        assert fp.decoded(fp.encoded(got)).tolist() == got.tolist()


def test_likeness():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("etaoinshr") for _ in range(rnd.randrange(2, 9)))
    t = " ".join(word() for _ in range(600))
    u = " ".join(word() for _ in range(600))
    half = t[: len(t) // 2] + u[: len(u) // 2]
    moved = "A new beginning. " + t
    a, b, h, m, e = fp.fingerprints([t, u, half, moved, ""])
    assert fp.likeness(a, a) == 1 and fp.likeness(e, e) == 1 and fp.likeness(a, e) == 0
    assert fp.likeness(a, b) < 0.05 and 0.3 < fp.likeness(a, h) < 0.7 and fp.likeness(a, m) > 0.9


def test_next_and_edited_documents(spark):
    rnd = random.Random(3)
    rows = [(i * 3, "".join(rnd.choice("abcdé 日") for _ in range(rnd.choice([0, 1, 3, 4, 50, 400])))) for i in range(90)]
    rows += [(None, "no id"), (270, None), (9, "again"), (9, "again"), (2**62, "last one, long id")]
    docs = spark.createDataFrame([(i, t, "g") for i, t in rows], "doc_id long, text string, group string").repartition(5)
    got = fp.compared(docs).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    want = []
    for (known, i, t), (_, _, following) in zip(order, order[1:] + order[:1]):
        n = len(t) // 4
        new = t[: len(t) - n] + following[:n]
        f, g, h = fp.fingerprints([t, new, following])
        want.append((i if known else None, len(t), hashlib.sha256(new.encode()).hexdigest(), fp.encoded(f), fp.encoded(g),
                     fp.likeness(f, g), fp.likeness(f, h)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_document_and_empty_table(spark):
    one = fp.compared(spark.createDataFrame([(4, "just one text here")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fp.compared(spark.createDataFrame([], "doc_id long, text string")).collect() == []
