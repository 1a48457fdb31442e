"""Document vectors by blocks of the vocabulary, against plain NumPy sums."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from annoscope.operators import vectors as V


def _tables(spark, n_docs, words, dim, text_ids):
    rnd = random.Random(5)
    name = (lambda i: f"doc {i}") if text_ids else (lambda i: i)
    tokens = [(name(i), "hot") for i in range(n_docs)]  # in every document
    tokens += [(name(rnd.randrange(n_docs)), f"w{rnd.randrange(2 * words)}") for _ in range(6 * n_docs)]
    tokens += [(name(0), f"w{k}") for k in range(words)] + [(None, "w1"), (name(1), None), (name(1), "")]
    vecs = [(f"w{k}", [rnd.uniform(-1, 1) for _ in range(dim)]) for k in range(words)] + [("hot", [1.0] * dim), ("w1", [2.0] * dim), (None, [9.0] * dim), ("x", None)]
    ids = [name(i) for i in range(n_docs)] + [name(10**6)]
    kind = "string" if text_ids else "long"
    return (tokens, vecs, ids, spark.createDataFrame(tokens, f"id {kind}, token string").repartition(3),
            spark.createDataFrame(vecs, "token string, vec array<float>"), spark.createDataFrame([(i,) for i in ids], f"id {kind}"))


@pytest.mark.parametrize("text_ids,numbers,rows", [(False, 1 << 22, 1 << 21), (False, 40, 1 << 21), (True, 200, 25)])
def test_document_vectors_equal_plain_sums(spark, monkeypatch, text_ids, numbers, rows):
    dim = 4
    tokens, vecs, ids, tok, vec, idt = _tables(spark, 60, 40, dim, text_ids)
    monkeypatch.setattr(V, "BLOCK_NUMBERS", numbers)
    monkeypatch.setattr(V, "SLICE_ROWS", rows)
    monkeypatch.setattr(V, "_PRODUCT_ROWS", 7)
    matrix = {}
    for t, v in vecs:
        if t is not None and v is not None:
            matrix[t] = matrix.get(t, 0) + np.array(v, dtype=np.float32).astype(float)
    sums, means = {i: np.zeros(dim) for i in ids}, {i: np.zeros(dim) for i in ids}
    for i in ids:
        own = [t for j, t in tokens if j == i]
        for t in set(own) & set(matrix):
            sums[i] += matrix[t]
        means[i] = sum((matrix[t] for t in own if t in matrix), np.zeros(dim)) / max(len(own), 1)
    for got, want in ((V.doc_vector_sum(tok, vec, idt, dim), {i: v / (np.linalg.norm(v) or 1) for i, v in sums.items()}), (V.doc_vector_mean(tok, vec, idt, dim), means)):
        rows_ = got.collect()
        assert len(rows_) == len(ids) * dim
        for r in rows_:
            assert r.value == pytest.approx(want[r.id][r.pos], abs=1e-6)


def test_no_row_carries_a_vector_per_document_and_token(spark, monkeypatch):
    *_, tok, vec, idt = _tables(spark, 60, 40, 4, False)
    monkeypatch.setattr(V, "BLOCK_NUMBERS", 80)
    parts = V.blocked_product(tok.distinct().withColumn("w", F.lit(1)), vec, idt, 4)
    plan = parts._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroups" in plan
    assert parts.groupBy("id").count().agg(F.max("count")).first()[0] <= 3  # one row per document and block
    assert V.blocked_product(tok.limit(0).withColumn("w", F.lit(1)), vec, idt, 4).count() == 0


def test_a_vector_goes_only_to_the_slices_that_have_its_token(spark, monkeypatch):
    """However many slices there are, a word of one document is placed once; one row per document."""
    n = 64
    tok = spark.createDataFrame([(i, t) for i in range(n) for t in ("hot", f"rare{i}")], "id long, token string").withColumn("w", F.lit(1))
    vec = spark.createDataFrame([(f"rare{i}", [1.0, 0.0]) for i in range(n)] + [("hot", [0.0, 1.0])], "token string, vec array<float>")
    idt = spark.createDataFrame([(i,) for i in range(n)], "id long")
    monkeypatch.setattr(V, "BLOCK_NUMBERS", 16)  # 8 slices
    placed = []
    monkeypatch.setattr(V, "written", lambda df, name: placed.append(df) or df)
    parts = V.blocked_product(tok, vec, idt, 2)
    table = {r.token: len(r.slices) for r in placed[-1].collect()}
    assert table.pop("hot") <= 8 and set(table.values()) == {1}
    got = parts.collect()
    assert len(got) == n and all(list(r.vec) == [1.0, 1.0] for r in got)


def test_distinct_tokens_shuffle_only_texts_whose_id_comes_again(spark):
    from annoscope.operators import text as T

    rows = [(1, "a b a"), (2, "b B c"), (2, "c d"), (3, None), (4, ""), (None, "x y"), (None, "y z"), (5, "q"), (5, "q")]
    texts = spark.createDataFrame(rows, "id long, text string")
    got = sorted(map(tuple, T.distinct_tokens(texts).collect()), key=repr)
    assert got == sorted(map(tuple, T.token_table(texts).select("id", "token").distinct().collect()), key=repr)
    plan = T.distinct_tokens(texts.where("id IN (1, 3, 4)"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # the repeated texts' only
