"""Categories, dimensions and the StructTypes of the logical tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The five categories and the two poles used by every operator.
CATEGORIES: tuple[str, ...] = ("authority", "care", "fairness", "loyalty", "sanctity")
POLES: tuple[str, ...] = ("virtue", "vice")
NONE_CATEGORY = "none"


def dimensions(categories=CATEGORIES) -> list[str]:
    return [f"{c}_{p}" for c in categories for p in POLES]


DIMENSIONS: tuple[str, ...] = tuple(dimensions())

TEXT_TABLE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("text", T.StringType(), True),
])

TOKEN_TABLE = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("pos", T.IntegerType(), False),
    T.StructField("token", T.StringType(), False),
])

LEXICON_A = T.StructType([
    T.StructField("word", T.StringType(), False),
    T.StructField("dim", T.StringType(), False),
])

LEXICON_A_RAW = T.StructType([
    T.StructField("word", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("sentiment", T.StringType(), True),
])


def lexicon_b(categories=CATEGORIES) -> T.StructType:
    fields = [T.StructField("word", T.StringType(), False)]
    fields += [T.StructField(f"{c}_p", T.DoubleType(), True) for c in categories]
    fields += [T.StructField(f"{c}_sent", T.DoubleType(), True) for c in categories]
    return T.StructType(fields)


WORD_VECTORS = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("vec", T.ArrayType(T.FloatType()), False),
])

PREDICTIONS = T.StructType([
    T.StructField("fold", T.IntegerType(), True),
    T.StructField("y_true", T.IntegerType(), True),
    T.StructField("y_score", T.DoubleType(), True),
    T.StructField("y_pred", T.IntegerType(), True),
])

HIGHLIGHTS = T.StructType([
    T.StructField("coder_id", T.IntegerType(), True),
    T.StructField("document_id", T.StringType(), True),
    T.StructField("assigned_domain", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("focus_duration", T.DoubleType(), True),
])

ARTICLES = T.StructType([
    T.StructField("document_id", T.StringType(), True),
    T.StructField("url", T.StringType(), True),
    T.StructField("text", T.StringType(), True),
])
