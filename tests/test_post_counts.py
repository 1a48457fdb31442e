"""Counts of a post's categories side by side against one row for each comment and category."""

import random

from pyspark.sql import functions as F

from annoscope.plans.catalog import stats
from annoscope.schema import CATEGORIES


def test_categories_of_a_post_share_a_shuffled_row(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice(["YTA", "ESH", "NTA", None]), *[rnd.choice([0.1, 0.5, 0.9, None]) for _ in CATEGORIES]) for _ in range(200)]
    rows += rows[:20]
    c = spark.createDataFrame(rows, "post_id long, label string, " + ", ".join(f"{x}_score double" for x in CATEGORIES)).localCheckpoint()
    f = stats._comment_flags(c)
    cells = [F.count_if((F.col("ya") == i) & (F.col("flag") == j)).alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)]
    want = f.groupBy("post_id", "category").agg(*cells, F.sum("flag").alias("nf")).collect()
    got = stats._post_counts(c).select("post_id", "category", "n00", "n01", "n10", "n11", "nf")
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and len(want) == 20
    dealt = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(post_id" in x]
    assert dealt and not any("category" in x for x in dealt)
