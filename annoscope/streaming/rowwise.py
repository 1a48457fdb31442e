"""Row-wise scoring: tokenise and count *inside the row* with higher-order functions
against a lexicon held as one broadcast map value, so scoring needs no shuffle and no state and
runs unchanged on a streaming DataFrame (a stream-static join with a one-row table).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from annoscope.functions.text import TOKEN_PATTERN
from annoscope.schema import CATEGORIES, dimensions


def _buckets(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """One row with an array of buckets; bucket ``hash(key) % size`` holds the entries of its keys, about one each."""
    size = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("int").alias("_size"))  # one row
    cell = F.pmod(F.hash(key), F.col("_size")).alias("_cell")
    filled = rows.crossJoin(F.broadcast(size)).groupBy(cell).agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v"))).alias("_b"))
    cells = size.select(F.explode(F.sequence(F.lit(0), F.col("_size") - 1)).alias("_cell"))
    empty = F.array().cast(filled.schema["_b"].dataType)
    return (cells.join(filled, "_cell", "left").agg(F.array_sort(F.collect_list(F.struct("_cell", F.coalesce("_b", empty).alias("b")))).alias("_s"))
            .select(F.transform("_s", lambda x: x["b"]).alias(name)))


def _looked_up(buckets: str, token):
    """The value of ``token`` in a bucket array, or NULL: one bucket is read, whatever the number of keys."""
    bucket = F.element_at(F.col(buckets), F.pmod(F.hash(token), F.size(buckets)) + 1)
    return F.get(F.transform(F.filter(bucket, lambda e: e["k"] == token), lambda e: e["v"]), F.lit(0))


def lexicon_map_row(lexicon: DataFrame, lemma_map: DataFrame | None = None) -> DataFrame:
    """One-row static table ``(_lex, _lemma)``: hash buckets of ``word -> dims`` and ``token -> lemma``.

    The whole lexicon is one value in every task. That suits dictionaries; for lexicons that grow with the
    corpus use ``micro_batch.score_stream`` with the join scorer."""
    lex = _buckets(lexicon.groupBy("word").agg(F.collect_set("dim").alias("dims")), "word", "dims", "_lex")
    if lemma_map is None:
        return lex.withColumn("_lemma", F.array().cast("array<array<struct<k:string,v:string>>>"))
    lemmas = lemma_map.select("token", F.trim(F.lower("lemma")).alias("lemma"))
    return lex.crossJoin(F.broadcast(_buckets(lemmas, "token", "lemma", "_lemma")))  # one row each


def score_lexicon_rowwise(texts: DataFrame, lex_row: DataFrame, categories: Sequence[str] = CATEGORIES,
                          id_col: str = "id", text_col: str = "text", normalize: bool = True, sentiment: bool = False) -> DataFrame:
    """D4-D6 without a shuffle: token dims (else lemma dims) counted per row, normalised by the
    row's token count, poles merged unless ``sentiment``. Works on streaming ``texts``."""
    dims = dimensions(categories)
    j = texts.crossJoin(F.broadcast(lex_row))  # one row
    toks = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN_PATTERN), 0)
    lemma = lambda t: F.when(F.size("_lemma") > 0, _looked_up("_lemma", t))
    hits = F.transform(toks, lambda t: F.coalesce(_looked_up("_lex", t), _looked_up("_lex", F.coalesce(lemma(t), F.trim(F.lower(t)))),
                                                  F.array().cast("array<string>")))
    flat = F.flatten(hits)
    base = j.select(F.col(id_col).alias("id"), F.size(toks).cast("long").alias("n_tokens"), flat.alias("_dims"))
    def count_of(dim):
        return F.size(F.filter("_dims", lambda x: x == F.lit(dim))).cast("double").alias(dim)

    counts = [count_of(d) for d in dims]
    x = base.select("id", "n_tokens", *counts)
    if normalize:
        x = x.select("id", "n_tokens", *[F.when(F.col("n_tokens") > 0, F.col(d) / F.col("n_tokens")).otherwise(F.col(d)).alias(d)
                                        for d in dims])
    if not sentiment:
        x = x.select("id", "n_tokens", *[(F.col(f"{c}_virtue") + F.col(f"{c}_vice")).alias(c) for c in categories])
    return x
