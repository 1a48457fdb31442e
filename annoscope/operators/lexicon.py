"""Lexicons and lexicon scoring.

Scoring is ``token table ⋈ lexicon`` then one ``groupBy(id)`` (one shuffle by document id, with
map-side partial aggregation). The lexicon side is sized by Spark, not guessed: an inline lexicon
has exact statistics and is planned as a broadcast; a derived one is broadcast by AQE at run time
only when its materialised size is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``, else
the join stays a shuffle join. Repeated tokens are pre-aggregated per document before the join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from annoscope.operators.skew import frequent_join, heavy_join
from annoscope.plans.sizing import maybe_broadcast
from annoscope.schema import CATEGORIES, POLES, dimensions

# Old category and pole spellings mapped to the current names.
CATEGORY_ALIASES: dict[str, str] = {"harm": "care", "ingroup": "loyalty", "purity": "sanctity"}
POLE_ALIASES: dict[str, str] = {"virtue": "virtue", "vice": "vice"}


def lexicon_from_dict(spark, lex: Mapping[str, Sequence[str]]) -> DataFrame:
    """``{word: [dim, ...]}`` -> long table ``(word, dim)``."""
    rows = [(w, d) for w, dims in lex.items() for d in dict.fromkeys(dims)]
    return spark.createDataFrame(rows, "word string, dim string")


def build_lexicon(raw: DataFrame, categories: Sequence[str] = CATEGORIES,
                  aliases: Mapping[str, str] = CATEGORY_ALIASES) -> DataFrame:
    """Rows ``(word, category, sentiment)`` -> ``(word, dims array<string>)``.

    Category and sentiment are trimmed and lower-cased, old names mapped, rows outside the
    categories × poles grid dropped, dims unique and sorted per word.
    """
    cat = F.trim(F.lower(F.col("category")))
    amap = F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), F.lit(v))]) if aliases else None
    cat = F.coalesce(amap[cat], cat) if amap is not None else cat
    pole = F.trim(F.lower(F.col("sentiment")))
    df = raw.select(F.col("word"), cat.alias("_c"), pole.alias("_p"))
    df = df.where(F.col("_c").isin(list(categories)) & F.col("_p").isin(list(POLES)))
    return (df.groupBy("word").agg(F.array_sort(F.collect_set(F.concat_ws("_", "_c", "_p"))).alias("dims")))


def explode_lexicon(lex: DataFrame) -> DataFrame:
    """``(word, dims)`` -> ``(word, dim)``."""
    return lex.select("word", F.explode("dims").alias("dim")).distinct()


def parse_dic(files: DataFrame, text_col: str = "value") -> DataFrame:
    """``.dic`` dictionaries, one whole file per row -> ``(word, dims array<string>)``.

    The file is cut at its ``%`` lines inside the row (no window, no ordering across rows):
    section 1 holds ``code name`` lines, section 2 ``word... code...`` lines, where the word is every
    non-numeric field concatenated without a space. Dims have ``.`` replaced by ``_``; unknown
    codes are dropped; dims are unique per word. Codes are scoped to their own file.
    """
    parts = F.split(F.col(text_col), r"(?m)^[ \t]*%[ \t]*\r?$")
    df = files.select(F.md5(F.col(text_col)).alias("_file"), parts.alias("_parts"))
    df = df.select("_file", F.element_at("_parts", 2).alias("_codes"), F.element_at("_parts", 3).alias("_words"))
    lines = lambda c: F.filter(F.transform(F.split(F.col(c), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    codes = df.select("_file", F.explode(lines("_codes")).alias("line"))
    codes = codes.select("_file", F.split("line", r"\s+").alias("f")).select(
        "_file", F.element_at("f", 1).alias("code"), F.regexp_replace(F.element_at("f", 2), r"\.", "_").alias("dim"))
    entries = df.select("_file", F.explode(lines("_words")).alias("line"))
    entries = entries.select("_file", F.split("line", r"\s+").alias("f")).select(
        "_file", F.array_join(F.filter("f", lambda x: ~x.rlike(r"^\d+$")), "").alias("word"),
        F.filter("f", lambda x: x.rlike(r"^\d+$")).alias("codes"))
    ex = entries.select("_file", "word", F.explode("codes").alias("code"))
    out = ex.join(codes, ["_file", "code"], "inner")
    return out.groupBy("word").agg(F.array_sort(F.collect_set("dim")).alias("dims"))


def lexicon_venn(a: DataFrame, b: DataFrame, c: DataFrame, names: Sequence[str] = ("a", "b", "c")) -> DataFrame:
    """D3: sizes of the seven Venn regions of three word sets in one aggregation.

    One union with membership flags, one ``groupBy(word)`` (max flags), one ``groupBy(flags)``.
    """
    parts = []
    for i, df in enumerate((a, b, c)):
        flags = [F.lit(1 if j == i else 0).alias(f"in_{n}") for j, n in enumerate(names)]
        parts.append(df.select(F.col("word"), *flags))
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    per_word = u.groupBy("word").agg(*[F.max(f"in_{n}").alias(f"in_{n}") for n in names])
    return per_word.groupBy(*[f"in_{n}" for n in names]).agg(F.count(F.lit(1)).alias("n_words"))


def lexicon_set_ops(a: DataFrame, b: DataFrame, c: DataFrame) -> dict[str, DataFrame]:
    """The explicit set forms — words only in one set (difference of differences), in two
    sets but not the third, and in all three. ``lexicon_venn`` gives all seven sizes in one pass."""
    wa, wb, wc = (x.select("word").distinct() for x in (a, b, c))
    return {
        "only_a": wa.exceptAll(wb).exceptAll(wc), "only_b": wb.exceptAll(wa).exceptAll(wc),
        "only_c": wc.exceptAll(wa).exceptAll(wb),
        "a_b_not_c": wa.intersect(wb).exceptAll(wc), "a_c_not_b": wa.intersect(wc).exceptAll(wb),
        "b_c_not_a": wb.intersect(wc).exceptAll(wa), "all": wa.intersect(wb).intersect(wc),
    }


def score_lexicon(tokens: DataFrame, lexicon: DataFrame, categories: Sequence[str] = CATEGORIES,
                  sentiment: bool = False, normalize: bool = True, ids: DataFrame | None = None,
                  lexicon_rows: int | None = None, heavy: int | None = None) -> DataFrame:
    """Word-count scores.

    ``tokens(id, pos, token[, lemma])``; ``lexicon(word, dim)`` long form. For each token the dims
    of the token are used, else the dims of its lemma; each dim counts +1. ``normalize`` divides
    by the document's token count (when > 0). Without ``sentiment`` the poles are summed.
    ``ids`` (one row per document) keeps documents without any token; default: the token table's ids.

    ``lexicon_rows`` is a known bound on the lexicon's size (e.g. an inline lexicon): then the
    lexicon is broadcast and token rows are scored where they are, leaving one shuffle (the
    per-document aggregation, combined map-side). Without a bound, repeated tokens are first
    pre-aggregated per document and the join is sized by AQE at run time. ``heavy`` is for a lexicon above the broadcast
    limit: the lexicon rows of that many most frequent words are broadcast, the rest meets by a shuffle.
    """
    dims = dimensions(categories)
    by_tok = lexicon.select("word", "dim").groupBy("word").agg(F.collect_list("dim").alias("dims_t"))
    has_lemma = "lemma" in tokens.columns
    if lexicon_rows is not None:
        by_tok = maybe_broadcast(by_tok, lexicon_rows, row_bytes=96)
        tok = tokens.select("id", "token", *(["lemma"] if has_lemma else []), F.lit(1).cast("long").alias("tf"))
    else:
        keys = ["id", "token"] + (["lemma"] if has_lemma else [])
        tok = tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("tf"))
    if heavy:
        j = heavy_join(tok, by_tok, "token", "word", "left", heavy)
    else:
        j = tok.join(by_tok, tok["token"] == by_tok["word"], "left").drop("word")
    if has_lemma:
        by_lem = by_tok.select(F.col("word").alias("_lw"), F.col("dims_t").alias("dims_l"))
        if heavy:
            j = heavy_join(j, by_lem, "lemma", "_lw", "left", heavy)
        else:
            j = j.join(by_lem, j["lemma"] == by_lem["_lw"], "left").drop("_lw")
        hit = F.coalesce(F.col("dims_t"), F.col("dims_l"))
    else:
        hit = F.col("dims_t")
    j = j.select("id", "tf", hit.alias("dims"))
    aggs = [F.sum(F.when(F.array_contains("dims", d), F.col("tf")).otherwise(0)).cast("double").alias(d) for d in dims]
    per_doc = j.groupBy("id").agg(F.sum("tf").alias("n_tokens"), *aggs)
    if ids is not None:
        per_doc = ids.select("id").join(per_doc, "id", "left")
        per_doc = per_doc.select("id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
                                 *[F.coalesce(d, F.lit(0.0)).alias(d) for d in dims])
    if normalize:
        per_doc = per_doc.select("id", "n_tokens", *[F.when(F.col("n_tokens") > 0, F.col(d) / F.col("n_tokens"))
                                                    .otherwise(F.col(d)).alias(d) for d in dims])
    if not sentiment:
        per_doc = per_doc.select("id", "n_tokens", *[(F.col(f"{c}_virtue") + F.col(f"{c}_vice")).alias(c)
                                                    for c in categories])
    return per_doc


def score_problex(content: DataFrame, lexicon_b: DataFrame, categories: Sequence[str] = CATEGORIES,
                  sentiment: bool = False, normalize: bool = True, ids: DataFrame | None = None, heavy: int | None = None,
                  frequent: DataFrame | None = None) -> DataFrame:
    """Probability-lexicon scores over content tokens.

    ``content(id, token)`` (after C3); ``lexicon_b(word, {c}_p, {c}_sent)``. Without ``sentiment``:
    ``{c} = Σ p / max(#matched, 1)``. With ``sentiment``: each matched token adds its ``{c}_p`` to
    ``{c}_virtue`` when ``{c}_sent >= 0`` else ``{c}_vice`` (NULL sent -> vice), normalised by the
    per-dimension match count (0 -> 1). ``heavy``: as for ``score_lexicon``; ``lexicon_b`` must then have one row a word.

    ``frequent(key)`` holds words the caller knows to be frequent: their lexicon rows are broadcast and their tokens are summed per document where
    they are, only tokens of other words are shuffled (``skew.frequent_join``); for a corpus with far more words than can be broadcast.
    """
    lex = lexicon_b
    if frequent is not None:
        j = frequent_join(content.select("id", "token"), lex, "token", "word", frequent).withColumn("tf", F.lit(1).cast("long"))
    else:
        tok = content.groupBy("id", "token").agg(F.count(F.lit(1)).alias("tf"))
        j = heavy_join(tok, lex, "token", "word", "inner", heavy) if heavy else tok.join(lex, tok["token"] == lex["word"], "inner")
    if not sentiment:
        aggs = [F.sum(F.col(f"{c}_p") * F.col("tf")).alias(c) for c in categories]
        aggs.append(F.sum("tf").alias("_n"))
        per_doc = j.groupBy("id").agg(*aggs)
        cols = [(F.col(c) / F.greatest(F.col("_n"), F.lit(1)) if normalize else F.col(c)).alias(c) for c in categories]
        out_cols = list(categories)
    else:
        aggs, cols, out_cols = [], [], []
        for c in categories:
            virt = F.coalesce(F.col(f"{c}_sent") >= 0, F.lit(False))
            for pole, cond in (("virtue", virt), ("vice", ~virt)):
                d = f"{c}_{pole}"
                aggs.append(F.sum(F.when(cond, F.col(f"{c}_p") * F.col("tf")).otherwise(0.0)).alias(d))
                aggs.append(F.sum(F.when(cond, F.col("tf")).otherwise(0)).alias(f"_n_{d}"))
                cols.append((F.col(d) / F.greatest(F.col(f"_n_{d}"), F.lit(1)) if normalize else F.col(d)).alias(d))
                out_cols.append(d)
        per_doc = j.groupBy("id").agg(*aggs)
    per_doc = per_doc.select("id", *cols)
    if ids is not None:
        per_doc = ids.select("id").join(per_doc, "id", "left").select(
            "id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in out_cols])
    return per_doc
