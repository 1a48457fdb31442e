import base64
import random
import re

import numpy as np

from annoscope.llm.token_count import VOCABULARY, automaton, count_tokens, read_vocabulary


def greedy(word, tokens, before=b" ", mark=b""):
    """Longest match from the left, piece by piece; one unknown token where that fails."""
    first = {t for t in tokens if not (mark and t.startswith(mark))}
    inner = {t[len(mark):] for t in tokens if t.startswith(mark) and len(t) > len(mark)} if mark else first
    w, at, n = before + word, 0, 0
    while at < len(w):
        table = first if at == 0 else inner
        size = next((k for k in range(len(w) - at, 0, -1) if w[at:at + k] in table), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


def counts(machine, words):
    data = np.frombuffer(b"|".join(words), np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    return machine.counts(data, end - [len(w) for w in words], end).tolist()


def test_random_vocabularies_match_greedy_search():
    rnd = random.Random(1)
    for trial in range(60):
        mark = rnd.choice([b"", b"##"])
        tokens = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 6))) for _ in range(rnd.randrange(1, 25))}
        tokens |= {mark + t for t in tokens if rnd.random() < 0.7}
        if rnd.random() < 0.5:
            tokens |= {b"a", b"b", b"c", mark + b"a", mark + b"b", mark + b"c"}
        before = b"" if mark else rnd.choice([b"", b"a"])
        words = [bytes(rnd.choice(b"abcd" if rnd.random() < 0.1 else b"abc") for _ in range(rnd.randrange(1, 14))) for _ in range(80)]
        assert counts(automaton(tokens, before, mark), words) == [greedy(w, tokens, before, mark) for w in words]


def test_whole_texts_and_public_vocabulary(spark):
    tokens = read_vocabulary()
    texts = ["The cat sat on\tthe mat.", "", None, " \n ", "Über naïve 日本語 émotions!!", "x" * 5000, "antidisestablishmentarianism " * 3]
    rows = list(enumerate(texts)) + [(None, "null id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_tokens int")
    table = set(tokens)
    want = []
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        want.append((i, len(w), sum(greedy(x, table) if len(x) < 200 else 0 for x in w)))
    got = [tuple(r) for r in count_tokens(docs).collect()]
    long_word = next(g for g in got if g[0] == 5)
    assert sorted([g for g in got if g[0] != 5], key=str) == sorted([w for w in want if w[0] != 5], key=str)
    assert long_word[1] == 1 and 0 < long_word[2] <= 5001
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_vocabulary_file_is_a_parameter(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([b"ab", b"##c", b"a"])))
    docs = spark.createDataFrame([(1, "abc abcc ac ab a b")], "doc_id long, text string")
    assert count_tokens(docs, str(path), before=b"", continuation=b"##").first()["n_tokens"] == 2 + 3 + 2 + 1 + 1 + 1
    assert VOCABULARY.startswith("/opt/tokenizers/")
