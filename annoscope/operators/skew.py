"""Joins whose key is skewed on the row side: frequent keys by broadcast, the rest by a shuffle.

The frequent keys come from a mergeable counter sketch (``approx_top_k``), one small state a task. Only their table rows, at
most ``heavy`` of them, are broadcast, so a row with a frequent key is matched where it is and not shuffled,
only rows with other keys are; whatever the size of the table, no task gets all rows of a frequent word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from annoscope.session import written

#: Counters of the sketch per frequent key asked for: a key of more than n / (tracked counters) of n rows is always found.
TRACKED_PER_KEY = 10
#: A counted key is frequent if it has at least this share of all rows; so at most a million keys are ranked ...
FREQUENT_SHARE = 1e-6
#: ... and at most so many are broadcast, with their rows of the joined table (about 7 MB for ten numbers a row).
MOST_FREQUENT = 50_000


def frequent_keys(rows: DataFrame, key: str, heavy: int) -> DataFrame:
    """At most ``heavy`` most frequent values of the string column ``key``, by a counter sketch: ``(key)``."""
    top = F.expr(f"approx_top_k(`{key}`, {heavy}, {heavy * TRACKED_PER_KEY})")
    return rows.agg(top.alias("_top")).select(F.explode("_top").alias("_t")).select(F.col("_t.item").alias("key"))


def counted_frequent_keys(counts: DataFrame, key: str, n: str = "n", most: int = MOST_FREQUENT) -> DataFrame:
    """The frequent keys of ``counts(key, n)``, at most ``most`` of them, most rows first: ``(key)``, written once."""
    total = counts.agg(F.sum(n).alias("_total"))  # one row
    often = counts.crossJoin(F.broadcast(total)).where(F.col(n) >= F.col("_total") * FREQUENT_SHARE)
    return written(often.orderBy(F.col(n).desc(), key).limit(most).select(F.col(key).alias("key")), "frequent-keys")


def frequent_join(rows: DataFrame, table: DataFrame, key: str, table_key: str, frequent: DataFrame) -> DataFrame:
    """``rows`` joined (inner) to ``table`` on ``key = table_key``, without ``table_key``. The table's rows of the keys in ``frequent(key)``, whichever
    they are, are broadcast: a row with such a key is matched where it is, so an aggregation over the result combines it there.
    Only rows with other keys are shuffled. ``rows`` is written once, as both parts read it.
    """
    rows = written(rows, "frequent-rows")
    keys = F.broadcast(frequent.select(F.col("key").alias("_key")))
    near = F.broadcast(table.join(keys, table[table_key] == F.col("_key"), "left_semi"))
    rest = rows.join(keys, rows[key] == F.col("_key"), "left_anti")
    names = [*rows.columns, *[c for c in table.columns if c != table_key]]
    joined = lambda some, other: some.join(other, some[key] == other[table_key]).select(*names)
    return joined(rows, near).unionByName(joined(rest, table))


def heavy_join(rows: DataFrame, table: DataFrame, key: str, table_key: str, how: str = "left", heavy: int = 1000) -> DataFrame:
    """``rows`` joined to ``table`` on ``key = table_key`` (left or inner); ``table`` has one row a key and its other columns are
    added to those of ``rows``. ``rows`` is written once, as the sketch and the join both read it. Rows with a null key match nothing.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    rows = written(rows, "skew-rows")
    names = [c for c in table.columns if c != table_key]
    known = table.where(F.col(table_key).isNotNull()).select(F.col(table_key).alias("_word"), F.struct(F.lit(True).alias("_hit"), *names).alias("_row"))
    keys = written(frequent_keys(rows, key, heavy), "skew-keys")  # at most ``heavy`` rows
    found = known.join(F.broadcast(keys.withColumnRenamed("key", "_word")), "_word")
    frequent = keys.join(F.broadcast(found), keys["key"] == found["_word"], "left").select(F.col("key").alias("_freq"), F.col("_row").alias("_near"))
    marked = rows.join(F.broadcast(frequent), rows[key] == F.col("_freq"), "left")
    done = F.col("_freq").isNotNull() | F.col(key).isNull()
    near = marked.where(done).select(*rows.columns, F.col("_near").alias("_got"))
    if how == "inner":
        near = near.where(F.col("_got").isNotNull())
    rest = marked.where(~done).select(*rows.columns)
    far = rest.join(known, rest[key] == known["_word"], how).select(*rows.columns, F.col("_row").alias("_got"))
    return near.unionByName(far).select(*rows.columns, *[F.col("_got")[n].alias(n) for n in names])
