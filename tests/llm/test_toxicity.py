import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from annoscope.llm import toxicity as tx


def enumerated(emissions, moves):
    """Marginals of a chain by summing over all state sequences; also the log of the sum."""
    n = len(emissions)
    total, on = 0.0, np.zeros(n)
    for states in itertools.product((0, 1), repeat=n):
        w = sum(e for e, y in zip(emissions, states) if y)
        w += sum({(0, 0): 0.0, (0, 1): moves[0], (1, 0): moves[1], (1, 1): moves[2]}[p] for p in zip(states, states[1:]))
        total += np.exp(w)
        on += np.exp(w) * np.array(states)
    return on / total, np.log(total)


def test_marginals_match_enumeration(monkeypatch):
    monkeypatch.setattr(tx, "_BLOCK", 3)  # chains of several blocks
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(0, 9, 6)
        first = np.concatenate([[0], np.cumsum(sizes)])
        e, moves = rng.normal(0, 2, first[-1]), rng.normal(0, 1.5, 3)
        r, s = tx.messages(np.exp(e), first, *np.exp(moves))
        p = r * s / (1 + r * s)
        for a, b in zip(first, first[1:]):
            if b > a:
                assert p[a:b] == pytest.approx(enumerated(e[a:b], moves)[0], abs=1e-9)


def test_fit_reaches_a_point_without_gradient():
    rng = np.random.default_rng(1)
    first = np.array([0, 6, 6, 13, 20, 27])
    kind = rng.integers(0, 3, 27)
    label = ((kind == 1) | (rng.random(27) < 0.2)).astype(float)
    extra = rng.integers(0, 2, (27, 4)).astype(float)
    chain = tx.fit_chain(kind, extra, first, label, 2, steps=4000, ridge=0.05)

    def objective(w):
        c, value = tx.Chain(w[:2], w[2:-3], w[-3:]), 0.0
        e = c.emissions(kind, extra)
        for a, b in zip(first, first[1:]):
            y = label[a:b].astype(int)
            value += float(e[a:b] @ y) + sum((0, w[-3], w[-2], w[-1])[2 * p + q] for p, q in zip(y, y[1:]))
            value -= enumerated(e[a:b], w[-3:])[1] if b > a else 0.0
        return value / 27 * 100 - 0.05 / 2 * float(w @ w)

    w = np.concatenate([chain.types, chain.rest, chain.moves])
    best = objective(w)
    for i in range(len(w)):
        for step in (-0.02, 0.02):
            moved = w.copy()
            moved[i] += step
            assert objective(moved) <= best + 1e-3


def test_a_fit_ends_after_its_steps():
    rng = np.random.default_rng(6)
    first, kind = np.array([0, 9, 20]), rng.integers(0, 3, 20)
    extra, label = rng.integers(0, 2, (20, 4)).astype(float), (kind == 1).astype(float)
    asked, width = [], 12

    def evaluate(point):
        asked.append(point)
        total = np.zeros(width)
        tx.add_loss(total, point, 2, kind, extra, first, label)
        return total

    squares = np.zeros(width)
    tx._squares(squares, 2, kind, extra, first)
    assert tx._descend(evaluate, squares[:-2], 0.01, 3).any() and len(asked) == 3


def corpus(seed, n=900):
    rnd = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "é", "ing", "st", "nd", "ou"]
    word = lambda: "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4)))
    rows, labels, bad = [], [], {}
    for i in range(n):
        ws = [word() for _ in range(rnd.randrange(10, 120))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(rnd.randrange(3, 6)):
                ws.insert(rnd.randrange(len(ws)), rnd.choice(["vile", "Rotten", "grub" + rnd.choice(parts)]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
        bad[i] = [m.span() for m in re.finditer(r"\b(vile|Rotten|grub\w+)\b", rows[-1][1])]
    return rows, labels, bad


def test_held_out_documents_and_spans(spark):
    rows, labels, bad = corpus(3)
    extra = [(5000, None), (5001, ""), (None, "vile vile Rotten vile"), (5, "er on an"), (5002, "er on an the " * 20_000 + "vile Rotten vile")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows + extra], "doc_id long, text string, score int").repartition(3)
    marks = spark.createDataFrame(labels + [(7, None), (99999, 1)], "doc_id long, toxic int")
    got = tx.detect(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    truth, hits, total, right = dict(labels), 0, 0, []
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.held_out and r.doc_id in truth and r.doc_id != 5:
            right.append(r.predicted == truth[r.doc_id])
            found = {(s.begin, s.end) for s in r.spans}
            inside = {b for b in bad[r.doc_id] if any(s <= b[0] and b[1] <= e for s, e in found)}
            hits, total = hits + len(inside), total + len(bad[r.doc_id])
    assert np.mean(right) > 0.97 and hits / total > 0.9
    by_id = {r.doc_id: r for r in got if r.doc_id != 5}
    assert by_id[None].predicted == 1 and by_id[5000].predicted == 0 and by_id[5002].spans and by_id[5000].score == by_id[5001].score


def test_degenerate_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "some text here") for i in range(30)], "doc_id long, text string")
    none = tx.detect(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert {r.score for r in none} == {0.0}
    one = tx.detect(docs, spark.createDataFrame([(i, 0) for i in range(30)], "doc_id long, toxic int")).collect()
    assert len({r.score for r in one}) == 1 and one[0].score < 0.1
    assert tx.detect(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect() == []


def test_types_are_words_and_their_beginnings():
    words = tx.Words.of(pa.array(["Éclairs éclairs éclat", "abc"]))
    whole, *starts = list(words.types())
    assert whole[0] == whole[1] != whole[2]
    three = starts[0]
    assert three[0] == three[1] == three[2] != 0 and three[3] == 0


def test_rare_pure_types_are_tagged(spark):
    """Twenty words that stand in eight toxic documents each, among 4,000 documents, are evidence and get tagged."""
    rnd = random.Random(5)
    usual = ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(4)) for _ in range(400)]
    rows, labels = [], []
    for i in range(4000):
        ws, toxic = [rnd.choice(usual) for _ in range(40)], i % 25 == 0
        if toxic:
            ws.insert(rnd.randrange(len(ws)), f"zq{chr(97 + i // 25 % 20)}xkw")
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = tx.fit(docs, marks, "toxic", F.lit(True))
    got = {r.doc_id: r for r in tx.tag(docs, model).collect()}
    tagged = [any(rows[i][1][s.begin:s.end].find("xkw") >= 0 for s in got[i].spans) for i in range(0, 4000, 25)]
    clean = [len(got[i].spans) for i in range(4000) if i % 25]
    assert np.mean(tagged) > 0.95 and np.mean([n > 0 for n in clean]) < 0.01


def test_repeated_ids_stay_within_the_sample(spark, monkeypatch):
    monkeypatch.setattr(tx, "SAMPLE", 300)
    rows, labels, _ = corpus(4, 200)
    many = [(0, f"er on an {i} the") for i in range(900)] + [(1, "same text again")] * 500
    docs = spark.createDataFrame(rows + many, "doc_id long, text string")
    kept = []
    monkeypatch.setattr(tx, "_model", lambda learn, real=tx._model: kept.append(learn.sparkSession.read.parquet(*learn.inputFiles()).count()) or real(learn))
    got = tx.detect(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == 200 + 1400 and kept[0] <= 300


def test_loss_is_the_log_likelihood_and_matches_its_gradient():
    rng = np.random.default_rng(2)
    first, kind = np.array([0, 4, 4, 9]), rng.integers(0, 3, 9)
    extra, label, w = rng.integers(0, 2, (9, 4)).astype(float), rng.integers(0, 2, 9).astype(float), rng.normal(0, 1, 10)

    def at(point):
        total = np.zeros(12)
        tx.add_loss(total, point, 2, kind, extra, first, label)
        return total

    chain, want = tx._chain_of(w, 2), 0.0
    e = chain.emissions(kind, extra)
    for a, b in ((0, 4), (4, 9)):
        y = label[a:b].astype(int)
        want += enumerated(e[a:b], w[-3:])[1] - float(e[a:b] @ y) - sum((0, *w[-3:])[2 * p + q] for p, q in zip(y, y[1:]))
    assert at(w)[-2] == pytest.approx(want, abs=1e-9) and at(w)[-1] == 9
    for i in range(10):
        step = np.eye(10)[i] * 1e-5
        assert at(w)[i] == pytest.approx((at(w + step)[-2] - at(w - step)[-2]) / 2e-5, abs=1e-5)
