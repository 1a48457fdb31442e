"""Token filters: conditions by cost, and the rows they keep."""

from pyspark.sql import functions as F

from annoscope.functions.hashing import u01, u01_below
from annoscope.operators import annotate as A, text as T


def test_a_threshold_on_hex_digits_equals_the_one_on_numbers(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") != 7, F.col("id")).alias("k"))
    for limit in (0.1, 0.5, 0.6, 1 / 3):
        assert df.where(~(u01("k", F.lit("x")) < limit).eqNullSafe(u01_below(limit, "k", F.lit("x")))).count() == 0
    assert df.where(u01_below(0.5, "k").isNull()).count() == 1


def test_tags_are_computed_only_for_tokens_that_the_lists_leave(spark, tmp_path):
    spark.createDataFrame([(1, "ab"), (2, "the"), (3, "n't"), (4, "Ab1c"), (5, "a1b"), (6, "Größe"), (7, "x-y z"), (8, None)], "id int, token string").write.parquet(f"{tmp_path}/t")
    tokens = spark.read.parquet(f"{tmp_path}/t")
    tagged = tokens.withColumn("tag", F.when(F.length("token") < 3, F.raise_error(F.lit("too early")).cast("string")).otherwise(F.lit("NN")))
    assert sorted(map(tuple, T.content_tokens(tagged).select("id", "token").collect())) == [(4, "abc"), (6, "größe"), (7, "xyz")]


def test_short_terms_are_out_before_any_pattern(spark):
    tokens = spark.range(1).select("id", F.explode(F.array(*[F.lit(t) for t in ("Ab", "the", "Größe", "a1b", "tree", " oak ")])).alias("token"))
    terms = T.bow_tokens(tokens)
    assert sorted(r.term for r in terms.collect()) == ["größe", "oak", "tree"]
    tests = terms._jdf.queryExecution().analyzed().toString().splitlines()
    depth = lambda word: next(i for i, line in enumerate(tests) if word in line.lower())
    assert depth("length(") > depth("rlike")  # below it in the plan, so before it


def test_group_keys_join_no_group_sentence_rows(spark):
    art = spark.createDataFrame([("d", "One two. Three four. Five."), ("e", "Only this. And that.")], "document_id string, text string")
    rows = [(1, "d", "care", "two. Three"), (1, "d", "care", "One"), (2, "d", "loyalty", "absent"), (1, "e", "care", None)]
    hl = spark.createDataFrame(rows, "coder_id int, document_id string, assigned_domain string, content string")
    keys = A.sentence_group_keys(hl, art)
    got = {(r.coder_id, r.document_id, r.sent_no): r.n_hits for r in keys.collect()}
    assert got == {(1, "d", 0): 2, (1, "d", 1): 1, (1, "d", 2): 0, **{(2, "d", i): 0 for i in range(3)}, **{(1, "e", i): 0 for i in range(2)}}
    joins = [line for line in keys._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert joins and not any("sent_no" in line for line in joins)
