"""Token tables and text preparation.

A text table ``(id, text)`` becomes the token table ``(id, pos, token)`` in one narrow stage
(``posexplode`` of ``regexp_extract_all``; no shuffle). Lemma, entity and tag information comes from
optional lookup tables joined on the token, broadcast only when the caller vouches for its size.
"""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame, Window, functions as F

from annoscope.functions.text import SENTENCE_PATTERN, TOKEN_PATTERN, tokens as token_array
from annoscope.plans.sizing import maybe_broadcast
from annoscope.session import written


# Strings removed by the content-token filter (compared lower-cased).
BAD_STRINGS: tuple[str, ...] = (
    "…", "'ve", "'s", "'ll", "'d", '"', "'m", "'s", "'re", "–-", "–-", "‘", "’d",
    "’ll", "’m", "’re", "’s", "’ve", "“", ",,", ",", "(", ")", ".", "”", "\n\n",
    "@realDonaldTrump", "n't", "\xad",
)

# The part-of-speech tags kept by the content-token filter.
CONTENT_TAGS: tuple[str, ...] = ("NN", "NNS", "JJ", "VB", "VBD", "VBG", "VBN", "VBP", "VBZ", "RB")


@lru_cache(maxsize=1)
def default_stop_words() -> tuple[str, ...]:
    """Spark ML's English stop-word list, read from the MLlib jar (no JVM needed, so the DuckDB
    oracle and the Spark job use the identical list)."""
    import pyspark

    roots = [os.path.join(os.path.dirname(pyspark.__file__), "jars")]
    if os.environ.get("SPARK_HOME"):
        roots.append(os.path.join(os.environ["SPARK_HOME"], "jars"))
    jars = [j for r in roots for j in glob.glob(os.path.join(r, "spark-mllib_*.jar"))]
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            for name in z.namelist():
                if name.endswith("stopwords/english.txt"):
                    words = z.read(name).decode("utf-8").split("\n")
                    return tuple(w for w in (x.strip() for x in words) if w)
    raise FileNotFoundError("Spark MLlib English stop-word list not found")


def united_stop_words(*lists: Sequence[str]) -> tuple[str, ...]:
    """Several stop-word lists as one, in order, without repeats."""
    return tuple(dict.fromkeys(w for words in lists for w in words))


def token_table(texts: DataFrame, id_col: str = "id", text_col: str = "text", lower: bool = True,
                pattern: str = TOKEN_PATTERN) -> DataFrame:
    """``(id, pos, token)``; ``pos`` is 0-based. Narrow (map-only) stage."""
    return texts.select(F.col(id_col).alias("id"),
                        F.posexplode(token_array(text_col, lower=lower, pattern=pattern)).alias("pos", "token"))


def distinct_tokens(texts: DataFrame, id_col: str = "id", text_col: str = "text", lower: bool = True,
                    pattern: str = TOKEN_PATTERN) -> DataFrame:
    """``(id, token)``, each pair once. A text's tokens are made distinct in its row, so nothing is shuffled but the ids; only
    texts whose id comes again (a null id too) meet by a shuffle."""
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    again = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
                    .select(F.col("id").alias("_id"), F.lit(True).alias("_again")), "repeated-ids")
    marked = rows.join(again, rows["id"].eqNullSafe(again["_id"]), "left")

    def tokens_of(part):
        return part.select("id", F.explode(F.array_distinct(token_array("_text", lower=lower, pattern=pattern))).alias("token"))

    return tokens_of(marked.where(F.col("_again").isNull())).unionByName(tokens_of(marked.where(F.col("_again"))).distinct())


def with_lemma(tokens: DataFrame, lemma_map: DataFrame | None, lemma_rows: int | None = None) -> DataFrame:
    """Add ``lemma`` = mapped lemma, else the token itself (lower-cased, stripped).

    ``lemma_map(token, lemma)`` is broadcast only when ``lemma_rows`` (a known bound) is given and
    below the session's broadcast threshold; otherwise Spark plans the join from statistics.
    """
    if lemma_map is None:
        return tokens.withColumn("lemma", F.trim(F.lower(F.col("token"))))
    lm = lemma_map.select(F.col("token").alias("_lt"), F.trim(F.lower(F.col("lemma"))).alias("_lemma"))
    lm = maybe_broadcast(lm, lemma_rows, row_bytes=64)
    out = tokens.join(lm, tokens["token"] == lm["_lt"], "left")
    return out.select(*tokens.columns, F.coalesce(F.col("_lemma"), F.trim(F.lower(F.col("token")))).alias("lemma"))


def content_tokens(tokens: DataFrame, stop_words: Sequence[str] | None = None, bad_strings: Sequence[str] = BAD_STRINGS,
                   keep_tags: Sequence[str] = CONTENT_TAGS, min_len: int = 3) -> DataFrame:
    """Content-token filter, in order: drop entities -> keep tags -> drop bad strings (compared
    lower-cased) -> drop stop words (case-sensitive, before lower-casing) -> strip non-letters ->
    keep length >= ``min_len`` -> lower-case. ``ent`` / ``tag`` columns are used when present.

    The stop-word and bad-string lists are literal ``IN`` sets compiled into the filter (a hash set
    in generated code), so there is no join at all. The conditions hold together, so they are tested in order of their cost:
    a token shorter than ``min_len`` is out before any list or pattern, ``ent`` and ``tag`` are computed for what is left, and the
    pattern that strips a token runs only where it has something to strip.
    """
    stop_words = default_stop_words() if stop_words is None else tuple(stop_words)
    token = F.col("token")
    df = tokens.where(F.length(token) >= min_len)
    if stop_words:
        df = df.where(~token.isin(list(stop_words)))
    df = df.where(~F.lower(token).isin([s.lower() for s in bad_strings]))
    if "tag" in df.columns and keep_tags:
        df = df.where(F.col("tag").isin(list(keep_tags)))
    if "ent" in df.columns:
        df = df.where(F.coalesce(F.col("ent"), F.lit("")) == "")
    plain = ~token.rlike(r"[^\p{L}]")
    stripped = F.when(plain, token).otherwise(F.regexp_replace(token, r"[^\p{L}]", ""))
    return df.where(plain | (F.length(stripped) >= min_len)).withColumn("token", F.lower(stripped))


def bow_tokens(tokens: DataFrame, stop_words: Sequence[str] | None = None, min_len: int = 3,
               source_col: str = "lemma") -> DataFrame:
    """C4: lemma (lower, stripped) -> drop stop words -> alphabetic only -> length >= ``min_len``."""
    stop_words = default_stop_words() if stop_words is None else tuple(stop_words)
    src = source_col if source_col in tokens.columns else "token"
    t = F.trim(F.lower(F.col(src)))
    df = tokens.withColumn("term", t).where(F.length("term") >= min_len)  # the cheapest test first
    if stop_words:
        df = df.where(~F.col("term").isin(list(stop_words)))
    return df.where(F.col("term").rlike(r"^\p{L}+$"))


def sentence_spans(texts: DataFrame, id_col: str = "id", text_col: str = "text",
                   pattern: str = SENTENCE_PATTERN) -> DataFrame:
    """``(id, sent_no, start, end, sentence)`` with half-open character spans.

    Sentences are ``posexplode``d and offsets are a running sum of sentence lengths over a window
    per document; a window partition is one document's sentences (bounded by a single text), and
    input already partitioned by the id needs no further shuffle.
    """
    df = texts.select(F.col(id_col).alias("id"),
                      F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(pattern), 0)).alias("sent_no", "sentence"))
    w = Window.partitionBy("id").orderBy("sent_no").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_len", F.length("sentence"))  # a column: callers that drop the text do not sort it
    df = df.withColumn("end", F.sum("_len").over(w).cast("int"))
    return df.select("id", "sent_no", (F.col("end") - F.col("_len")).alias("start"), "end", "sentence")


def subword_merge(pieces: DataFrame, marker: str = "Ġ", strip_left: bool = True, strip_right: bool = True,
                  id_col: str = "id", pos_col: str = "pos", token_col: str = "token",
                  score_col: str = "score") -> DataFrame:
    """Merge sub-word pieces into words; word score = mean of its pieces' scores.

    A piece starting with ``marker`` opens a new word; other pieces append to the current word
    (pieces before the first marker form a word of their own). Gaps-and-islands: the word id is a
    running count of word starts per document. Windows are per document (bounded by its length).
    ``strip_left`` / ``strip_right`` drop the first / last piece of each document (special tokens).
    """
    w_all = Window.partitionBy(id_col)
    df = pieces.select(id_col, pos_col, token_col, score_col)
    if strip_left or strip_right:
        df = df.withColumn("_min", F.min(pos_col).over(w_all)).withColumn("_max", F.max(pos_col).over(w_all))
        if strip_left:
            df = df.where(F.col(pos_col) != F.col("_min"))
        if strip_right:
            df = df.where(F.col(pos_col) != F.col("_max"))
    is_new = F.col(token_col).startswith(marker)
    piece = F.when(is_new, F.expr(f"substring({token_col}, {len(marker) + 1})")).otherwise(F.col(token_col))
    w = Window.partitionBy(id_col).orderBy(pos_col).rowsBetween(Window.unboundedPreceding, 0)
    df = df.select(id_col, pos_col, piece.alias("_piece"), F.col(score_col).alias("_score"),
                   F.sum(is_new.cast("int")).over(w).alias("word_no"))
    words = df.groupBy(id_col, "word_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col("_piece").alias("t")))),
                                 lambda s: s["t"]), "").alias("word"),
        F.avg("_score").alias("score"), F.min(pos_col).alias("first_pos"))
    return words
