import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from annoscope.llm import alignment as al


def test_merge_paths_find_the_groups_at_every_piece_size():
    rnd = random.Random(4)
    for _ in range(150):
        top = rnd.randrange(1, 60)
        a = np.array(sorted(rnd.sample(range(1, top), rnd.randrange(0, top))) + [top])
        b = np.array(sorted(rnd.sample(range(1, top), rnd.randrange(0, top))) + [top])
        common = sorted(set(a.tolist()) & set(b.tolist()))
        want = [[sum(c < x for c in common) for x in side.tolist()] for side in (a, b)]
        for piece in (1, 2, 3, 7, 1000):
            ga, gb, n = al.groups(a, b, piece)
            assert [ga.tolist(), gb.tolist(), n] == [*want, len(common)]
            i, j = al.diagonals(a, b, piece)
            assert set(np.diff(i + j)[:-1].tolist()) <= {piece}
            merged = sorted([(v, 0) for v in a.tolist()] + [(v, 1) for v in b.tolist()])
            assert all(sum(s == 0 for _, s in merged[:x + y]) == x for x, y in zip(i.tolist(), j.tolist()))


def brute(rows):
    """The contract word for word, with the two libraries' own encoders."""
    t = Tokenizer.from_file(al.TOKENIZER_A)
    t.encode_special_tokens = True
    letters = al._byte_letters()
    entry = {i: bytes(letters[c] for c in p) for p, i in json.load(open(al.TOKENIZER_A))["model"]["vocab"].items() if i != 50256}
    sp = sentencepiece.SentencePieceProcessor(model_file=al.TOKENIZER_B)
    out, held = [], Counter()
    for doc, text in rows:
        a_ids = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = sp.encode(text) if text else []
        a_tok = [entry[i] for i in a_ids]
        b_tok = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        want = (" " + (text or "")).encode()
        if not text or b"".join(a_tok) != want or b"".join(b_tok) != want:
            out.append((doc, [], [], [], Counter()))
            continue
        ends = [np.cumsum([len(x) for x in tok]).tolist() for tok in (a_tok, b_tok)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        group = [[sum(c < e for c in cuts) for e in side] for side in ends] if len(text) < 3000 else [np.searchsorted(cuts, side).tolist() for side in ends]
        members = [([], []) for _ in cuts]
        for side, ids in ((0, a_ids), (1, b_ids)):
            for g, i in zip(group[side], ids):
                members[g][side].append(i)
        pairs = Counter((x, y) for xs, ys in members for x in xs for y in ys)
        held.update(pairs.keys())
        out.append((doc, a_ids, b_ids, members, pairs))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    res = []
    for doc, a_ids, b_ids, members, pairs in out:
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in members)
        res.append((doc, len(a_ids), len(b_ids), len(members), sum(pairs.values()), sum(n for p, n in pairs.items() if held[p] == best[p[0]]),
                    sum(n * held[p] for p, n in pairs.items()), hashlib.sha256(said.encode()).hexdigest() if members else ""))
    return res


EDGE = ["", None, " ", "  two  spaces ", "a", "The cat's naïve 日本語 émotions!! 😀🏽 <|endoftext|> <s> </s>", "▁marked", "tab\tnew\nline\r\n", "ﬁ ﬂ ½   x\u0000y", "x" * 3000,
        "^" * 200, "ab" * 500 + "é" * 50, "العربية नमस्ते", "the cat the cat the cat"]
FIELDS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("most", [al.BROADCAST_PAIRS, 0])
def test_rows_match_brute_force(spark, most):
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()[:60]]
    rows = given + [(10_000 + i, x) for i, x in enumerate(EDGE)] + [(None, "null id"), (None, "null id"), (3, "again")]
    docs = spark.createDataFrame([(i, x, "k", 1) for i, x in rows], "doc_id long, text string, key string, n_a int").repartition(3)
    got = [tuple(r[c] for c in FIELDS) for r in al.align(docs, broadcast_pairs=most).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert al.align(docs.limit(0)).collect() == []


def test_links_in_small_parts_hold_each_pair_once():
    rnd = np.random.default_rng(1)
    ga, gb = np.sort(rnd.integers(0, 12, 300)), np.sort(rnd.integers(0, 12, 200))
    a, b, doc = rnd.integers(0, 9, 300), rnd.integers(0, 7, 200), np.arange(12) // 4
    want = Counter((int(doc[g]), int(x) * 7 + int(y)) for g, x in zip(ga, a) for h, y in zip(gb, b) if g == h)
    for most in (1, 10, 1000):
        parts = list(al.links(doc, a, b, ga, gb, 9, 7, most))
        flat = [(int(d), int(p), int(m)) for d, p, m in ((d, p, m) for part in parts for d, p, m in zip(*part))]
        assert len(flat) == len(want) and {(d, p): m for d, p, m in flat} == want


def test_quick_and_whole_encoder_agree_also_on_long_texts():
    with open(al.TOKENIZER_A, "rb") as fa, open(al.TOKENIZER_B, "rb") as fb:
        a_file, b_file = fa.read(), fb.read()
    assert al._by_rank(json.loads(a_file))
    t = al.Tokenizers(a_file, b_file, True)
    for text in [x for x in EDGE if x] + [" " * 70_000 + "x", "word " * 20_000, "\n" * 400_000]:
        assert t.encode_a(text) == t.whole.encode(text, add_special_tokens=False).ids
    spec = json.loads(a_file)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    assert not al._by_rank(spec)
