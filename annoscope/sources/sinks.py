"""Sinks (A17-A21). Distributed writers; nothing is collected to the driver."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def _mode(df: DataFrame, path: str, mode: str) -> str:
    if mode == "warn_overwrite":
        try:
            jvm = df.sparkSession._jvm  # noqa: SLF001
            hp = jvm.org.apache.hadoop.fs.Path(path)
            fs = hp.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())  # noqa: SLF001
            if fs.exists(hp):
                warnings.warn(f"{path} exists and will be overwritten", stacklevel=3)
        except Exception:  # noqa: BLE001 (best effort; only a warning)
            pass
        return "overwrite"
    return mode


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",", encoding: str = "UTF-8") -> None:
    """CSV with a header, every field quoted, white space kept; ``mode`` is Spark's, or
    ``warn_overwrite`` (warn, then overwrite)."""
    (df.write.mode(_mode(df, path, mode)).option("header", True).option("sep", sep).option("encoding", encoding)
     .option("quote", '"').option("escape", '"').option("quoteAll", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> None:
    """Matrices / tables as Parquet ``(id, features)`` etc."""
    w = df.write.mode(_mode(df, path, mode))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines (one object per row)."""
    df.write.mode(_mode(df, path, mode)).json(path)


# Largest number of values gathered into one JSON record by the writers below.
RECORD_ROWS = 10_000


def _chunked(df: DataFrame, keys: Sequence[str], by: Sequence[str], rows: int) -> DataFrame:
    """Adds ``_chunk``, which deals each key's rows by hash to records of about ``rows`` values. A key of
    at most ``rows`` values is one record; the shape depends on counts and hashes, not on the layout."""
    n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows)).cast("long").alias("_n"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    j = df.alias("d").join(n.alias("n"), same) if keys else df.alias("d").crossJoin(F.broadcast(n.alias("n")))  # one row
    return j.select("d.*", F.pmod(F.xxhash64(*[F.col(f"d.{c}") for c in by]), F.col("n._n")).alias("_chunk"))


def write_grouped_json(df: DataFrame, key: str, value: str, path: str, mode: str = "overwrite",
                       record_rows: int = RECORD_ROWS) -> None:
    """``{key: [values]}`` objects, one line per key (values in ascending order). Only a key of more
    than ``record_rows`` values is spread over several records; readers concatenate them."""
    g = _chunked(df.select(key, value), [key], [value], record_rows).groupBy(key, "_chunk") \
        .agg(F.array_sort(F.collect_list(value)).alias(value)).drop("_chunk")
    write_json_lines(g, path, mode)


def write_dic(entries: DataFrame, path: str, codes: Sequence[tuple[str, str]], record_rows: int = RECORD_ROWS,
              mode: str = "overwrite") -> None:
    """Write ``.dic`` dictionaries of about ``record_rows`` entries; each file is a complete dictionary
    (code section + its share of entries). ``entries(w, c1, c2, split)``: word, one or two codes,
    and whether the word is written as two fields (a multi-word key)."""
    header = "%\n" + "\n".join(f"{c}\t{name}" for c, name in codes) + "\n%\n"
    half = (F.length("w") / 2).cast("int")
    word = F.when(F.col("split"), F.concat(F.substring("w", 1, half), F.lit(" "), F.expr("substring(w, 1 + cast(length(w) / 2 as int))"))) \
        .otherwise(F.col("w"))
    line = F.concat_ws("\t", word, F.col("c1").cast("string"), F.col("c2").cast("string"))
    files = _chunked(entries, [], ["w"], record_rows).select("_chunk", line.alias("line")).groupBy("_chunk").agg(
        F.concat(F.lit(header), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n")).alias("value"))
    files.select("value").write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def write_fold_predictions(pred: DataFrame, path: str, record_rows: int = RECORD_ROWS, mode: str = "overwrite") -> None:
    """A15 writer: JSON lines ``{"fold":k,"y_true":[...],"y_score":[...],"y_pred":[...]}``.

    A fold is written as several records of at most ``record_rows`` predictions, so no record
    holds a whole fold; readers concatenate records of the same fold.
    """
    rows = _chunked(pred, ["fold"], ["y_score", "y_true"], record_rows)
    g = rows.groupBy("fold", "_chunk").agg(F.array_sort(F.collect_list(F.struct("y_score", "y_true", "y_pred"))).alias("rs"))
    out = g.select("fold", F.col("rs.y_true").alias("y_true"), F.col("rs.y_score").alias("y_score"),
                   F.col("rs.y_pred").alias("y_pred"))
    out.write.mode(mode).json(path)


def write_nested_corpus_json(tweets: DataFrame, path: str, record_rows: int = RECORD_ROWS, mode: str = "overwrite") -> None:
    """A6 writer: JSON lines ``{"Corpus": c, "Tweets": [{tweet_id, tweet_text, annotations: [...]}]}``.
    A corpus of more than ``record_rows`` tweets is split into hash chunks of about that size."""
    per_tweet = tweets.groupBy("corpus", "tweet_id", "tweet_text").agg(
        F.collect_list(F.struct(F.col("annotator").cast("string").alias("annotator"), "annotation")).alias("annotations"))
    recs = _chunked(per_tweet, ["corpus"], ["tweet_id"], record_rows).groupBy(F.col("corpus").alias("Corpus"), "_chunk").agg(
        F.collect_list(F.struct("tweet_id", "tweet_text", "annotations")).alias("Tweets"))
    recs.select("Corpus", "Tweets").write.mode(mode).json(path)


def write_keyed_json(df: DataFrame, key: str, value_cols: list[str], path: str, record_rows: int = RECORD_ROWS,
                     mode: str = "overwrite") -> None:
    """A7 writer: object-keyed JSON ``{key: {value...}}``, one object per record of at most
    ``record_rows`` keys; records are written as separate text rows (one object per line)."""
    g = _chunked(df, [], [key], record_rows).groupBy("_chunk").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col(key).cast("string"), F.struct(*value_cols)))).alias("m"))
    g.select(F.to_json("m").alias("value")).write.mode(mode).text(path)


def write_word_vectors(vectors: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A11 writer: ``token v1 ... vd`` text lines, no header."""
    line = F.concat_ws(" ", F.col("token"), F.array_join(F.transform("vec", lambda v: v.cast("string")), " "))
    vectors.select(line.alias("value")).write.mode(mode).text(path)


def write_json_document(values: DataFrame, path: str, key: str | None = None, pretty: bool = True, mode: str = "overwrite") -> None:
    """One JSON document in one file: a list of the JSON texts ``values(value)``, or an object of them by the column ``key``. The
    lines are sorted in Spark and streamed through the one writer that a single file needs."""
    from annoscope.session import written

    name = F.regexp_extract(F.to_json(F.struct(F.col(key or "value").cast("string").alias("k"))), r'(?s)^\{"k":(.*)\}$', 1)
    item = F.concat(name, F.lit(": " if pretty else ":"), "value") if key else F.col("value")
    rows = written(values.select(F.struct(F.col(key or "value").cast("string").alias("k"), F.monotonically_increasing_id().alias("u")).alias("at"), item.alias("item")), "json-lines")
    first = F.broadcast(rows.agg(F.min("at").alias("first")))  # one row
    lines = rows.crossJoin(first).select(F.lit(1).alias("part"), "at", F.concat(F.when(F.col("at") == F.col("first"), "").otherwise(","), "item").alias("value"))
    ends = values.sparkSession.createDataFrame([(0, "{" if key else "["), (2, "}" if key else "]")], "part int, value string")
    lines = lines.unionByName(ends, allowMissingColumns=True).orderBy("part", "at").select("value").coalesce(1)
    lines.write.mode(mode).option("lineSep", "\n" if pretty else " ").text(path)


def write_corpora_document(tweets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A6 as shipped: one list of corpora in one file on many lines, a tweet a line, from ``tweets(corpus, value)`` with the JSON text
    of each tweet. No corpus is gathered: its lines are sorted between its first and last one."""
    from annoscope.session import written

    rows = written(tweets.select("corpus", F.monotonically_increasing_id().alias("u"), "value"), "json-lines")
    corpora = written(rows.groupBy("corpus").agg(F.min("u").alias("u")), "json-corpora")
    least = F.broadcast(corpora.agg(F.min("corpus").alias("least")))  # one row
    head = F.concat(F.when(F.col("corpus") == F.col("least"), "").otherwise(","), F.regexp_replace(F.to_json(F.struct(F.col("corpus").alias("Corpus"))), r"\}$", ""), F.lit(', "Tweets": ['))
    lines = rows.join(corpora.withColumnRenamed("u", "first"), "corpus").select(
        F.lit(1).alias("a"), "corpus", F.lit(1).alias("b"), "u", F.concat(F.when(F.col("u") == F.col("first"), "").otherwise(","), "value").alias("value"))
    lines = lines.unionByName(corpora.crossJoin(least).select(F.lit(1).alias("a"), "corpus", F.lit(0).alias("b"), head.alias("value")), allowMissingColumns=True)
    lines = lines.unionByName(corpora.select(F.lit(1).alias("a"), "corpus", F.lit(2).alias("b"), F.lit("]}").alias("value")), allowMissingColumns=True)
    ends = tweets.sparkSession.createDataFrame([(0, "["), (2, "]")], "a int, value string")
    lines = lines.unionByName(ends, allowMissingColumns=True).orderBy("a", "corpus", "b", "u").select("value").coalesce(1)
    lines.write.mode(mode).text(path)
