import random
import re

from annoscope.llm.substring_dedup import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, w=13):
    """Every window's smallest document, then the words that a window with a smaller one covers."""
    words = {i: WORD.findall(t or "") for i, t in enumerate(r[1] for r in rows)}
    ids = [float("inf") if r[0] is None else r[0] for r in rows]
    least = {}
    for i, ws in words.items():
        for k in range(len(ws) - w + 1):
            key = tuple(ws[k:k + w])
            least[key] = min(least.get(key, float("inf")), ids[i])
    out = []
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - w + 1):
            if least[tuple(ws[k:k + w])] < ids[i]:
                gone |= set(range(k, k + w))
        out.append((rows[i][0], len(ws), len(gone), " ".join(x for k, x in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rnd = random.Random(5)
    vocabulary = ["a", "b", "é", "über", "the", "x", "日本", "zz", "the,", "of"]
    passages = [[rnd.choice(vocabulary) + str(rnd.randrange(40)) for _ in range(rnd.randrange(8, 40))] for _ in range(12)]
    rows = [(None, "n " * 20), (None, "n " * 20), (7, None), (8, ""), (9, " \t\n"), (10, "one")]
    for i in range(11, 160):
        ws = []
        for _ in range(rnd.randrange(1, 5)):
            ws += rnd.choice(passages) if rnd.random() < 0.5 else [rnd.choice(vocabulary) + str(rnd.randrange(999)) for _ in range(rnd.randrange(30))]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(ws)))
    rows += [(200, "same words " * 30), (200, "same words " * 30), (201, "same words " * 31), (3, rows[50][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = remove_repeats(docs).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got], key=str) == brute(rows)
    for r in got:
        assert sum(e - s for s, e in r.removed) == r.n_removed
    assert sum(r.n_removed for r in got) > 100


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(empty).collect() == []
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "a b", 6, "y")], "doc_id long, text string, n_words int, _part string")
    assert sorted((r.doc_id, r.n_removed) for r in remove_repeats(docs).collect()) == [(1, 0), (2, 0)]
