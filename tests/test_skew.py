"""Joins on a skewed key, against the plain join."""

import random

import pytest
from pyspark.sql import functions as F

from annoscope.operators import skew as SK


@pytest.fixture()
def tables(spark):
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else "lost" if i % 10 == 1 else f"w{rnd.randrange(900)}") for i in range(6000)] + [(-1, None), (-2, ""), (-1, None), (1, "w1"), (1, "w1")]
    table = [(f"w{k}", k, None if k % 5 else "x") for k in range(0, 900, 2)] + [("hot", -7, "y"), (None, 1, "z")]
    return (spark.createDataFrame(rows, "id long, token string").repartition(4),
            spark.createDataFrame(table, "word string, v int, s string"))


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_equal_to_the_plain_join(tables, how):
    rows, table = tables
    plain = rows.join(table, rows["token"] == table["word"], how).select("id", "token", "v", "s")
    for heavy in (1, 20, 5000):
        got = SK.heavy_join(rows, table, "token", "word", how, heavy)
        assert got.columns == plain.columns and _sorted(got) == _sorted(plain)


def test_empty_sides(tables):
    rows, table = tables
    assert SK.heavy_join(rows.limit(0), table, "token", "word").count() == 0
    assert SK.heavy_join(rows, table.limit(0), "token", "word", "inner").count() == 0
    assert SK.heavy_join(rows, table.limit(0), "token", "word").where("v IS NULL AND s IS NULL").count() == rows.count()
    with pytest.raises(ValueError):
        SK.heavy_join(rows, table, "token", "word", "outer")


def test_a_word_in_a_third_of_all_rows_is_spread(spark, tables):
    """Without broadcasts by size, the longest join task has less than three times the median's rows."""
    rows, table = tables
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(old, ("-1", "false", "16")):
            spark.conf.set(k, v)
        sizes = lambda df: sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
        plain = sizes(rows.join(table, rows["token"] == table["word"], "left"))
        spread = sizes(SK.heavy_join(rows, table, "token", "word", "left", 20))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert plain[-1] > 3 * plain[len(plain) // 2] and spread[-1] < 3 * spread[len(spread) // 2]
    assert sum(spread) == rows.count()


def test_rows_with_a_frequent_key_are_not_shuffled(spark, tables):
    rows, table = tables
    for how in ("left", "inner"):
        plan = SK.heavy_join(rows, table, "token", "word", how, 20)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lstrip().startswith("Union") and "monotonically_increasing_id" not in plan
