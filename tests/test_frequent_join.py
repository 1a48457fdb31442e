"""Joins with known frequent keys: equal to the plain join and scorers, with only the rows of other keys shuffled by the key."""

import json
import random

import pytest
from pyspark.sql import functions as F

from annoscope.operators import lexicon as L, skew as SK, vectors as V
from annoscope.schema import CATEGORIES


@pytest.fixture()
def rows(spark):
    rnd = random.Random(5)
    got = [(i % 150, f"w{min(int(rnd.paretovariate(0.7)), 700)}") for i in range(6000)]
    got += [(1, None), (2, ""), (None, "w1"), (None, "w650"), (200, "w0"), (201, None)]
    return spark.createDataFrame(got, "id long, token string").repartition(4)


def _counts(rows):
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _sorted(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_the_most_frequent_keys(spark, rows):
    n = {r["token"]: r["n"] for r in _counts(rows).collect()}
    got = [r["key"] for r in SK.counted_frequent_keys(_counts(rows), "token", most=20).collect()]
    assert len(got) == 20 and min(n[k] for k in got) >= sorted(n.values())[-20]
    rare = spark.range(3).select(F.col("id").cast("string").alias("token"), F.when(F.col("id") == 0, 10**9).otherwise(1).alias("n"))
    assert [r["key"] for r in SK.counted_frequent_keys(rare, "token").collect()] == ["0"]
    assert SK.counted_frequent_keys(rare.limit(0), "token").count() == 0


def test_equal_to_the_plain_join(spark, rows):
    table = spark.createDataFrame([(f"w{k}", k, None if k % 5 else "x") for k in range(0, 700, 2)] + [("w2", -7, "y"), ("w600", -8, "z"), (None, 1, "z"), ("", 2, None)],
                                  "word string, v int, s string")  # words that come twice too
    plain = rows.join(table, rows["token"] == table["word"]).select("id", "token", "v", "s")
    for keys in ([], ["w1", "w2", "w2", "", None, "not there"], [f"w{k}" for k in range(700)]):
        got = SK.frequent_join(rows, table, "token", "word", spark.createDataFrame([(k,) for k in keys], "key string"))
        assert got.columns == plain.columns and _sorted(got) == _sorted(plain)


@pytest.fixture()
def lexicon(spark):
    value = lambda k, c: None if (k + c) % 11 == 0 else (k * 7 + c * 3) % 13 / 13 - 0.4
    names = [f"{c}_p" for c in CATEGORIES] + [f"{c}_sent" for c in CATEGORIES]
    return spark.createDataFrame([(f"w{k}", *[value(k, c) for c in range(len(names))]) for k in range(1, 700) if k % 3], "word string, " + ", ".join(f"{n} double" for n in names))


def test_scores_are_those_without_frequent_words(spark, rows, lexicon):
    some = SK.counted_frequent_keys(_counts(rows), "token", most=20)
    ids = spark.range(203).select("id")
    for sentiment in (False, True):
        for kept in (None, ids):
            got, plain = (L.score_problex(rows, lexicon, sentiment=sentiment, ids=kept, frequent=f) for f in (some, None))
            assert got.columns == plain.columns and _sorted(got) == _sorted(plain)
    cos = lexicon.select(F.col("word").alias("token"), F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"{c}_p").alias("cos")) for c in CATEGORIES])).alias("x")).select("token", "x.*")
    for kept in (None, ids):
        got, plain = (V.score_embedding(rows, cos, ids=kept, frequent=f) for f in (some, None))
        assert got.columns == plain.columns and _sorted(got) == _sorted(plain)


@pytest.mark.parametrize("name", ["score_problex", "score_problex_sent", "score_embed"])
def test_queries_shuffle_no_row_of_a_frequent_word(spark, tmp_path, monkeypatch, name):
    """No row per (document, word) is made before the join, and a frequent word's rows meet a broadcast table."""
    import __spark_entry__ as entry
    from annoscope.plans import fixtures as fx

    words = spark.createDataFrame([(i, "common plain words " * 30 + f"rare{i}") for i in range(40)], "doc_id long, text string")
    vectors = spark.createDataFrame([(i, [float((i * j) % 7 - 3) for j in range(64)]) for i in range(10)], "vec_id long, embedding array<float>")
    words.write.parquet(f"{tmp_path}/documents.parquet")
    vectors.write.parquet(f"{tmp_path}/embeddings.parquet")
    seen = []
    monkeypatch.setattr(fx, "frequent_words", lambda w: seen.append(w.columns) or SK.counted_frequent_keys(w, "token", most=3))
    monkeypatch.setattr("annoscope.plans.catalog.lexicon.fx.frequent_words", fx.frequent_words)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = entry.queries()[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert df.count() == 40 and seen == [["token", "n"]], json.dumps(seen)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Union" in plan and "LeftAnti" in plan and "rightHint=(strategy=broadcast)" in plan
