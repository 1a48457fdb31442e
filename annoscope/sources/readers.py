"""Readers. All return lazy DataFrames with declared schemas; column pruning and filters reach
the scan (CSV/JSON prune at parse, Parquet also pushes predicates)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from annoscope.schema import CATEGORIES, PREDICTIONS, lexicon_b


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",", header: bool = True,
             encoding: str = "UTF-8", multiline: bool = True) -> DataFrame:
    """A1-A5: delimited text with a header, RFC-4180 quoting (``"`` escapes ``"``), multi-line fields."""
    return (spark.read.schema(schema).option("header", header).option("sep", sep).option("encoding", encoding)
            .option("multiLine", multiline).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(path))


def read_tsv(spark: SparkSession, path: str, schema, encoding: str = "UTF-8") -> DataFrame:
    return read_csv(spark, path, schema, sep="\t", encoding=encoding)


def read_problex_csv(spark: SparkSession, path: str, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Probability lexicon ``word, {c}_p, {c}_sent``; one row per word (of repeated words the smallest row, so
    that runs agree)."""
    rows = read_csv(spark, path, lexicon_b(categories))
    rest = [c for c in rows.columns if c != "word"]
    return rows.groupBy("word").agg(F.min(F.struct(*rest)).alias("_r")).select("word", "_r.*")


def read_whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file (``value``); used for small per-file dictionaries (A10)."""
    return spark.read.text(path, wholetext=True)


def _members(spark: SparkSession, path: str, value_type: str) -> DataFrame:
    """``(key, value)`` of the members of a file's one JSON object, read in byte ranges."""
    from annoscope.sources.json_document import read_json_document

    rows = read_json_document(spark, path).records
    m = F.from_json(F.concat(F.lit("{"), F.col("value"), F.lit("}")), f"map<string,{value_type}>", {"mode": "FAILFAST"})
    return rows.select(F.explode(m).alias("key", "value"))


def read_lexicon_json(spark: SparkSession, path: str) -> DataFrame:
    """Lexicon JSON, one object ``{word: [dim, ...]}`` a file -> ``(word, dim)``; the file's members are read in parallel."""
    return _members(spark, path, "array<string>").select(F.col("key").alias("word"), F.explode("value").alias("dim"))


def read_lexicon_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema("word string, dims array<string>").json(path)
            .select("word", F.explode("dims").alias("dim")))


TWEETS_NESTED = T.StructType([
    T.StructField("Corpus", T.StringType()),
    T.StructField("Tweets", T.ArrayType(T.StructType([
        T.StructField("tweet_id", T.StringType()),
        T.StructField("tweet_text", T.StringType()),
        T.StructField("annotations", T.ArrayType(T.StructType([
            T.StructField("annotator", T.StringType()),
            T.StructField("annotation", T.StringType()),
        ]))),
    ]))),
])


def read_nested_json(spark: SparkSession, path: str, schema: T.StructType = TWEETS_NESTED) -> DataFrame:
    """Corpus -> tweets -> annotations, flattened to one row per annotation, from JSON lines (one corpus object
    per line; files split across tasks); two ``explode``s. See ``read_corpora_json`` for one document a file.
    """
    df = spark.read.schema(schema).json(path)
    return _annotations(df.select(F.col("Corpus").alias("corpus"), F.explode("Tweets").alias("t")))


def read_corpora_json(spark: SparkSession, path: str, schema: T.StructType = TWEETS_NESTED) -> DataFrame:
    """As ``read_nested_json`` from files that hold one list of corpora each, on any number of lines. The tweets of all
    corpora are parsed in parallel; the corpus names come from what is left of the document without them."""
    from annoscope.sources.json_document import read_json_document

    doc = read_json_document(spark, path, depth=3)
    names = F.from_json("value", "array<struct<Corpus:string,Tweets:array<long>>>", {"mode": "FAILFAST"})
    corpora = doc.skeleton.select("file", F.explode(names).alias("c")).select("file", F.col("c.Corpus").alias("corpus"), F.col("c.Tweets")[0].alias("container"))
    rows = doc.records.join(corpora, ["file", "container"])
    return _annotations(rows.select("corpus", F.from_json("value", schema["Tweets"].dataType.elementType, {"mode": "FAILFAST"}).alias("t")))


def _annotations(t: DataFrame) -> DataFrame:
    a = t.select("corpus", F.col("t.tweet_id").alias("tweet_id"), F.col("t.tweet_text").alias("tweet_text"),
                 F.posexplode("t.annotations").alias("annotator_no", "a"))
    return a.select("corpus", "tweet_id", "tweet_text", "annotator_no", F.col("a.annotator").alias("annotator"),
                    F.col("a.annotation").alias("annotation"))


FRAME_VALUE = "struct<text:string,`author-label`:int,issue:string>"


def read_map_json(spark: SparkSession, paths: dict[str, str], value_type: str = FRAME_VALUE,
                  one_object_per_line: bool = True) -> DataFrame:
    """Object-keyed JSON per category ``{id: {...}}``; the key is the id and the category
    is added as a literal; categories unioned by name; party decoded (1 -> democratic).
    Objects are read one per line (files split across tasks); ``one_object_per_line=False`` is for files that hold one
    object each, on any number of lines: its members are read in parallel."""
    parts = []
    for category, path in paths.items():
        if one_object_per_line:
            members = spark.read.text(path).select(F.explode(F.from_json(F.col("value"), f"map<string,{value_type}>")).alias("id", "v"))
        else:
            members = _members(spark, path, value_type).select(F.col("key").alias("id"), F.col("value").alias("v"))
        p = members.select(
            "id", F.col("v.text").alias("text"), F.col("v.issue").alias("issue"),
            F.when(F.col("v.`author-label`") == 1, "democratic").otherwise("republican").alias("party"),
            F.lit(category).alias("category"))
        parts.append(p)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_word_vectors(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Word-vector text, no header: ``word v1 ... vd`` -> ``(token, vec array<float>)``."""
    lines = spark.read.text(path)
    parts = F.split(F.trim(F.col("value")), sep)
    return lines.where(F.trim("value") != "").select(
        F.element_at(parts, 1).alias("token"),
        F.slice(parts, 2, F.size(parts) - 1).cast("array<float>").alias("vec"))


def read_fold_predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one fold per line ``{"fold":k,"y_true":[],"y_score":[],"y_pred":[]}``
    -> ``(fold, idx, y_true, y_score, y_pred)``; ``y_pred`` may be absent (NULL)."""
    sch = "fold int, y_true array<int>, y_score array<double>, y_pred array<int>"
    df = spark.read.schema(sch).json(path)
    z = F.arrays_zip(F.col("y_true").alias("y_true"), F.col("y_score").alias("y_score"),
                     F.coalesce(F.col("y_pred"), F.array_repeat(F.lit(None).cast("int"), F.size("y_true"))).alias("y_pred"))
    e = df.select("fold", F.posexplode(z).alias("idx", "r"))
    return e.select("fold", "idx", F.col("r.y_true").alias("y_true"), F.col("r.y_score").alias("y_score"),
                    F.col("r.y_pred").alias("y_pred"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTIONS).parquet(path)
