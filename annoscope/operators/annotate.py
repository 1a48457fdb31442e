"""Annotation corpora.

Raw per-annotator rows become one row per text with per-category counts; label maps are
broadcast lookups with an unknown-label check; highlight/sentence overlap uses the binned
interval join; per-text counters are one grouped aggregation with conditional sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from annoscope.functions.predicates import none_label, tristate_label, twostate_label
from annoscope.functions.text import SENTENCE_PATTERN, TOKEN_PATTERN, normalize_text
from annoscope.operators.intervals import overlap_join
from annoscope.plans.sizing import maybe_broadcast
from annoscope.operators.text import BAD_STRINGS, default_stop_words, sentence_spans
from annoscope.schema import CATEGORIES, NONE_CATEGORY

# The highlight quality rule (45 minutes of focus; the excluded coder).
MIN_FOCUS_SECONDS = 45 * 60
EXCLUDED_CODERS: tuple[int, ...] = (549,)


def filter_highlights(hl: DataFrame, min_focus: float = MIN_FOCUS_SECONDS, excluded: Sequence[int] = EXCLUDED_CODERS,
                      min_domains: int = 2, coder_range: tuple[int, int] = (2, 15)) -> DataFrame:
    """B2 + G1 + F11: focus/coder filter, then keep highlights of documents with at least
    ``min_domains`` distinct domains and a distinct-coder count inside ``coder_range``."""
    h = hl.where((F.col("focus_duration") >= min_focus) & ~F.col("coder_id").isin(list(excluded)))
    docs = h.groupBy("document_id").agg(F.countDistinct("assigned_domain").alias("_nd"),
                                        F.countDistinct("coder_id").alias("_nc"))
    lo, hi = coder_range
    keep = docs.where((F.col("_nd") >= min_domains) & (F.col("_nc") >= lo) & (F.col("_nc") <= hi)).select("document_id")
    return h.join(keep, "document_id", "left_semi")


def normalized_articles(articles: DataFrame) -> DataFrame:
    """B1 on the article texts, hash-partitioned by document. Both consumers (highlight search and
    sentence spans) read this one exchange, so every article is normalised once."""
    return articles.select("document_id", normalize_text("text").alias("text")).repartition("document_id")


def highlight_spans(hl: DataFrame, articles_n: DataFrame) -> DataFrame:
    """B1 + B29: normalised highlight located in its (already normalised) article: first
    occurrence, code-point offsets; not found -> dropped; NULL content -> dropped."""
    a = articles_n.select("document_id", F.col("text").alias("_art"))
    h = hl.where(F.col("content").isNotNull()).select("coder_id", "document_id", "assigned_domain",
                                                      normalize_text("content").alias("_hl"))
    j = h.join(a, "document_id", "inner")
    pos = F.expr("instr(_art, _hl)")
    j = j.select("coder_id", "document_id", "assigned_domain", (pos - 1).alias("h_start"),
                 (pos - 1 + F.length("_hl")).alias("h_end"), pos.alias("_pos"))
    return j.where(F.col("_pos") > 0).drop("_pos")


def _sentences_of(articles: DataFrame) -> DataFrame:
    art = normalized_articles(articles)
    return sentence_spans(art.withColumnRenamed("document_id", "id"), pattern=SENTENCE_PATTERN).withColumnRenamed("id", "document_id")


def sentence_group_keys(hl: DataFrame, articles: DataFrame, bin_size: int = 256) -> DataFrame:
    """F9/F10/G2 without texts: for every (coder, document, domain) group and every sentence number of the
    document, the number of the group's highlights overlapping the sentence (0 = negative)."""
    groups = hl.select("coder_id", "document_id", "assigned_domain").distinct()
    sents = _sentences_of(articles).select("document_id", "sent_no", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    spans = highlight_spans(hl, normalized_articles(articles))
    hits = overlap_join(sents, spans, ["document_id"], ("s_start", "s_end"), ("h_start", "h_end"), bin_size)
    cnt = hits.groupBy("coder_id", "document_id", "assigned_domain", "sent_no").agg(F.count(F.lit(1)).alias("n_hits"))
    # A group carries the few sentences it hits, so the (group, sentence) rows are made by one join and not shuffled.
    hit = cnt.groupBy("coder_id", "document_id", "assigned_domain").agg(F.map_from_entries(F.collect_list(F.struct("sent_no", "n_hits"))).alias("_hit"))
    groups = groups.join(hit, ["coder_id", "document_id", "assigned_domain"], "left")
    out = sents.select("document_id", "sent_no").join(groups, "document_id", "inner")
    n_hits = F.coalesce(F.try_element_at("_hit", F.col("sent_no")), F.lit(0))
    return out.select("coder_id", "document_id", "assigned_domain", "sent_no", n_hits.alias("n_hits"))


def sentence_group_hits(hl: DataFrame, articles: DataFrame, bin_size: int = 256) -> DataFrame:
    """``sentence_group_keys`` with the sentence's text attached."""
    texts = _sentences_of(articles).select("document_id", "sent_no", "sentence")
    return sentence_group_keys(hl, articles, bin_size).join(texts, ["document_id", "sent_no"]) \
        .select("coder_id", "document_id", "assigned_domain", "sent_no", "sentence", "n_hits")


def _count_columns(categories: Sequence[str]) -> list:
    d, k = F.col("assigned_domain"), F.col("n_hits")
    aggs = [F.sum(F.when(d == c, k).otherwise(0)).alias(c) for c in categories]
    aggs.append(F.sum(F.when(k == 0, 1).otherwise(0)).alias(NONE_CATEGORY))
    return aggs + [F.sum(F.when(d == c, F.when(k > 0, k).otherwise(1)).otherwise(0)).alias(f"{c}_seen") for c in categories]


def sentence_counts(hits: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Per sentence *text*: ``{c}`` = overlapping highlights of domain c, ``{c}_seen`` = those
    plus one per negative group of domain c, ``none`` = negative groups."""
    return hits.groupBy("sentence").agg(*_count_columns(categories))


def document_sentence_counts(hl: DataFrame, articles: DataFrame, categories: Sequence[str] = CATEGORIES, bin_size: int = 256) -> DataFrame:
    """``sentence_counts`` of highlights and articles, by differences: a document has a fixed number of (coder, domain) groups,
    and a sentence's negative groups are those less the groups that hit it. So only sentences that are hit meet groups, and no
    (group, sentence) pair is made for the others. Articles are cut into sentences once."""
    from annoscope.plans.sizing import shared

    d = F.col("assigned_domain")
    groups = hl.select("coder_id", "document_id", "assigned_domain").distinct()
    per_doc = groups.groupBy("document_id").agg(F.count(F.lit(1)).alias("_groups"), *[F.count_if(d == c).alias(f"_groups_{c}") for c in categories])
    sents = shared(_sentences_of(articles.join(groups, "document_id", "left_semi")).select("document_id", "sent_no", "start", "end", "sentence"))
    places = sents.select("document_id", "sent_no", F.col("start").alias("s_start"), F.col("end").alias("s_end"))
    hits = overlap_join(places, highlight_spans(hl, normalized_articles(articles)), ["document_id"], ("s_start", "s_end"), ("h_start", "h_end"), bin_size)
    hits = hits.groupBy("document_id", "sent_no", "coder_id", "assigned_domain").agg(F.count(F.lit(1)).alias("n_hits"))
    hits = hits.groupBy("document_id", "sent_no").agg(
        F.count(F.lit(1)).alias("_hit"), *[F.sum(F.when(d == c, F.col("n_hits"))).alias(f"_n_{c}") for c in categories], *[F.count_if(d == c).alias(f"_hit_{c}") for c in categories])
    rows = sents.select("document_id", "sent_no", "sentence").join(per_doc, "document_id").join(hits, ["document_id", "sent_no"], "left")
    n = {c: F.coalesce(c, F.lit(0)) for c in hits.columns[2:]}
    sums = [F.sum(n[f"_n_{c}"]).alias(c) for c in categories] + [F.sum(F.col("_groups") - n["_hit"]).alias(NONE_CATEGORY)]
    sums += [F.sum(n[f"_n_{c}"] + F.col(f"_groups_{c}") - n[f"_hit_{c}"]).alias(f"{c}_seen") for c in categories]
    return rows.groupBy("sentence").agg(*sums)


def with_content_tokens(counts: DataFrame, min_tokens: int = 3, stop_words: Sequence[str] | None = None,
                        bad_strings: Sequence[str] = BAD_STRINGS, min_len: int = 3) -> DataFrame:
    """C3 + C6: add ``tokens`` (content tokens in text order) and ``length``; keep sentences with at
    least ``min_tokens`` tokens. Filtered inside the row (stop words and bad strings as hashed sets): no
    shuffle, and the work is linear in a sentence's length.
    """
    stop_words = default_stop_words() if stop_words is None else tuple(stop_words)
    bad = [b.lower() for b in bad_strings]
    toks = F.regexp_extract_all(F.col("sentence"), F.lit(TOKEN_PATTERN), F.lit(0))
    kept = F.filter(toks, lambda t: (F.length(t) >= min_len) & ~t.isin(list(stop_words)) & ~F.lower(t).isin(bad))
    letters = F.transform(kept, lambda t: F.lower(F.regexp_replace(t, r"[^\p{L}]", "")))
    out = counts.withColumn("tokens", F.filter(letters, lambda t: F.length(t) >= min_len))
    return out.withColumn("length", F.size("tokens")).where(F.col("length") >= min_tokens)


def map_labels(rows: DataFrame, label_map: DataFrame, col: str = "annotation", sep: str = ",",
               check: bool = True, map_rows: int | None = None) -> DataFrame:
    """Split a comma list of raw labels and map each to its category. An unknown raw label is
    an error, raised when its row is read: building the query runs no job, and the rows are read once.
    ``map_rows`` (a known size of the label map) lets the map be broadcast."""
    ex = rows.select("*", F.explode(F.split(F.col(col), sep)).alias("raw"))
    m = maybe_broadcast(label_map.select("raw", "category"), map_rows, row_bytes=64)
    if not check:
        return ex.join(m, "raw", "inner")
    known = m.select("raw", "category", F.lit(True).alias("_known"))
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("raw", F.lit("NULL")))).cast("string")
    out = ex.join(known, "raw", "left").withColumn("category", F.when(F.col("_known"), F.col("category")).otherwise(unknown))
    # the filter reads the column, so the check stays in plans that use none of it
    return out.where(F.col("category").isNotNull() | F.col("_known")).drop("_known")


def count_labels(mapped: DataFrame, key_cols: Sequence[str], categories: Sequence[str] = (*CATEGORIES, NONE_CATEGORY)) -> DataFrame:
    """Per key, the number of mapped labels of each category (two raw labels mapping to
    one category count twice)."""
    return mapped.groupBy(*key_cols).agg(*[F.count_if(F.col("category") == c).alias(c) for c in categories])


def labels_from_counts(counts: DataFrame, key_cols: Sequence[str], categories: Sequence[str] = CATEGORIES,
                       with_seen: bool = True) -> DataFrame:
    """Per-category labels (tri-state with ``{c}_seen`` columns, else two-state) plus
    ``none_label``."""
    cols = []
    for c in categories:
        lab = tristate_label(c, f"{c}_seen") if with_seen else twostate_label(c)
        cols.append(lab.alias(f"{c}_label"))
    cols.append(none_label(*categories).alias("none_label"))
    return counts.select(*key_cols, *cols)


def multihot_contains(df: DataFrame, col: str, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """``{c}`` = 1 if the label string contains ``c`` as a substring (NULL -> 0)."""
    return df.select("*", *[F.coalesce(F.col(col).contains(c), F.lit(False)).cast("int").alias(c) for c in categories])


def multihot_anyof(df: DataFrame, cols: Sequence[str], categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """``{c}`` = 1 if any of ``cols`` equals ``c`` (NULLs ignored)."""
    arr = F.array(*[F.col(c) for c in cols])
    return df.select("*", *[F.coalesce(F.array_contains(arr, c), F.lit(False)).cast("int").alias(c) for c in categories])


def parse_percent(col) -> "F.Column":
    """Leading integer of a percent string, / 100."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(c, r"^\s*(\d+)", 1).cast("int") / 100.0


def clean_label(col) -> "F.Column":
    """Lower-case and cut at `` (``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(c), r" ?\(.*$", "")
