"""Annotation group: highlight filter, sentence/highlight overlap, per-sentence counts, label maps
and counts, labels, multi-hot encodings, vignette parsing, corpus merge, unpivot."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoscope.functions.hashing import u01
from annoscope.functions.text import SENTENCE_PATTERN, TOKEN_PATTERN
from annoscope.operators import annotate as A
from annoscope.operators.text import BAD_STRINGS, default_stop_words
from annoscope.plans import fixtures as fx, sqlfrag as S
from annoscope.plans.catalog import social as SC
from annoscope.plans.catalog._util import rounded
from annoscope.plans.catalog.text import _sql_normalize
from annoscope.plans.registry import register
from annoscope.plans.tables import table
from annoscope.schema import CATEGORIES

ALL6 = (*CATEGORIES, "none")

# ---------------------------------------------------------------- eMFD highlights


def _filtered_hl(spark, sf):
    return A.filter_highlights(fx.highlights(spark, sf))


def _hits(spark, sf):
    return A.sentence_group_keys(_filtered_hl(spark, sf), fx.articles(spark, sf))


def _counts(spark, sf):
    return A.with_content_tokens(A.document_sentence_counts(_filtered_hl(spark, sf), fx.articles(spark, sf)))


EMFD_BASE = S.with_(S.HIGHLIGHTS, S.ARTICLES) + f""", hl0 AS (SELECT * FROM highlights WHERE focus_duration >= 2700 AND coder_id NOT IN (549)),
keep AS (SELECT document_id FROM hl0 GROUP BY document_id
         HAVING count(DISTINCT assigned_domain) >= 2 AND count(DISTINCT coder_id) BETWEEN 2 AND 15),
hl_f AS (SELECT * FROM hl0 WHERE document_id IN (SELECT document_id FROM keep)),
art AS (SELECT document_id, {_sql_normalize('text')} AS art FROM articles),
spans AS (
  SELECT coder_id, document_id, assigned_domain, p - 1 AS h_start, p - 1 + length(hln) AS h_end FROM (
    SELECT h.coder_id, h.document_id, h.assigned_domain, {_sql_normalize('h.content')} AS hln, a.art
    FROM hl_f h JOIN art a USING (document_id) WHERE h.content IS NOT NULL
  ), LATERAL (SELECT instr(art, hln) AS p) WHERE p > 0
),
sents AS (
  SELECT document_id, sent_no, "end" - len AS s_start, "end" AS s_end, sentence FROM (
    SELECT document_id, sent_no, sentence, len,
           CAST(sum(len) OVER (PARTITION BY document_id ORDER BY sent_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS "end"
    FROM (SELECT document_id, CAST(UNNEST(range(len(s))) AS INTEGER) AS sent_no, UNNEST(s) AS sentence, CAST(length(UNNEST(s)) AS INTEGER) AS len
          FROM (SELECT document_id, regexp_extract_all(art, '{SENTENCE_PATTERN}') AS s FROM art))
  )
),
groups AS (SELECT DISTINCT coder_id, document_id, assigned_domain FROM hl_f),
hits AS (
  SELECT g.coder_id, g.document_id, g.assigned_domain, s.sent_no, s.sentence, count(sp.h_start) AS n_hits
  FROM sents s JOIN groups g USING (document_id)
  LEFT JOIN spans sp ON sp.coder_id = g.coder_id AND sp.document_id = g.document_id AND sp.assigned_domain = g.assigned_domain
    AND s.s_end > s.s_start AND sp.h_end > sp.h_start AND s.s_start < sp.h_end AND sp.h_start < s.s_end
  GROUP BY ALL
),
counts AS (
  SELECT sentence, {', '.join(f"CAST(sum(CASE WHEN assigned_domain = '{c}' THEN n_hits ELSE 0 END) AS BIGINT) AS {c}" for c in CATEGORIES)},
         CAST(sum(CASE WHEN n_hits = 0 THEN 1 ELSE 0 END) AS BIGINT) AS none,
         {', '.join(f"CAST(sum(CASE WHEN assigned_domain = '{c}' THEN (CASE WHEN n_hits > 0 THEN n_hits ELSE 1 END) ELSE 0 END) AS BIGINT) AS {c}_seen" for c in CATEGORIES)}
  FROM hits GROUP BY sentence
),
ctok AS (
  SELECT *, CAST(len(tokens) AS INTEGER) AS length FROM (
    SELECT *, list_transform(list_filter(list_transform(list_filter(regexp_extract_all(sentence, '{TOKEN_PATTERN}'),
        lambda t: NOT list_contains([{', '.join(S.q(b.lower()) for b in BAD_STRINGS)}], lower(t))
                  AND NOT list_contains([{', '.join(S.q(w) for w in default_stop_words())}], t)),
        lambda t: regexp_replace(t, '[^\\p{{L}}]', '', 'g')), lambda t: length(t) >= 3), lambda t: lower(t)) AS tokens
    FROM counts
  ) WHERE len(tokens) >= 3
)
"""


@register("emfd_filter", "annotation", sql=EMFD_BASE + "SELECT coder_id, document_id, assigned_domain, content, round(focus_duration, 6) AS focus_duration FROM hl_f")
def emfd_filter(spark, sf):
    return rounded(_filtered_hl(spark, sf))


@register("emfd_overlap", "annotation", sql=EMFD_BASE + "SELECT coder_id, document_id, assigned_domain, sent_no, n_hits FROM hits")
def emfd_overlap(spark, sf):
    return _hits(spark, sf).drop("sentence")


_COUNT_COLS = ["sentence", *CATEGORIES, "none", *[f"{c}_seen" for c in CATEGORIES], "length"]


@register("emfd_counts", "annotation", sql=EMFD_BASE + "SELECT " + ", ".join(_COUNT_COLS) + ", array_to_string(tokens, ' ') AS tokens FROM ctok")
def emfd_counts(spark, sf):
    c = _counts(spark, sf)
    return c.select(*_COUNT_COLS, F.array_join("tokens", " ").alias("tokens"))


@register("label_tristate", "annotation", sql=EMFD_BASE + "SELECT sentence, " + ", ".join(
    f"CASE WHEN {c} >= 1 THEN 1 WHEN {c}_seen >= 1 THEN 0 ELSE -1 END AS {c}_label" for c in CATEGORIES)
    + f", CAST(greatest({', '.join(CATEGORIES)}) = 0 AS INTEGER) AS none_label FROM ctok")
def label_tristate(spark, sf):
    return A.labels_from_counts(_counts(spark, sf), ["sentence"])


@register("label_twostate", "annotation", sql=EMFD_BASE + "SELECT sentence, " + ", ".join(
    f"CASE WHEN {c} >= 1 THEN 1 ELSE 0 END AS {c}_label" for c in CATEGORIES)
    + f", CAST(greatest({', '.join(CATEGORIES)}) = 0 AS INTEGER) AS none_label FROM ctok")
def label_twostate(spark, sf):
    """Annotations without a seen count: present or not."""
    return A.labels_from_counts(_counts(spark, sf), ["sentence"], with_seen=False)


# ---------------------------------------------------------------- label maps and counts

_MAPPED_SQL = S.with_(S.REDDIT, S.REDDIT_MAP) + """, ex AS (SELECT doc_id, annotator, text, UNNEST(string_split(annotation, ',')) AS raw FROM reddit),
mapped AS (SELECT ex.*, m.category FROM ex JOIN reddit_map m USING (raw))
"""


@register("annot_map", "annotation", sql=_MAPPED_SQL + "SELECT doc_id, annotator, raw, category FROM mapped")
def annot_map(spark, sf):
    m = spark.createDataFrame(list(fx.REDDIT_LABEL_MAP), "raw string, category string")
    return A.map_labels(fx.reddit_annotations(spark, sf), m, map_rows=len(fx.REDDIT_LABEL_MAP)).select("doc_id", "annotator", "raw", "category")


@register("annot_counts_distinct", "annotation", sql=_MAPPED_SQL + "SELECT text, " + ", ".join(
    f"count_if(category = '{c}') AS {c}" for c in ALL6) + " FROM mapped GROUP BY text")
def annot_counts_distinct(spark, sf):
    m = spark.createDataFrame(list(fx.REDDIT_LABEL_MAP), "raw string, category string")
    return A.count_labels(A.map_labels(fx.reddit_annotations(spark, sf), m, map_rows=len(fx.REDDIT_LABEL_MAP)), ["text"])


@register("annot_counts_rows", "annotation", sql=S.with_(S.TWEETS, S.TWITTER_MAP) + """, ex AS (
  SELECT corpus, tweet_id, UNNEST(string_split(annotation, ',')) AS raw FROM tweets
), mapped AS (SELECT ex.*, m.category FROM ex JOIN twitter_map m USING (raw))
SELECT corpus, tweet_id, """ + ", ".join(f"count_if(category = '{c}') AS {c}" for c in ALL6) + " FROM mapped GROUP BY ALL")
def annot_counts_rows(spark, sf):
    m = spark.createDataFrame(list(fx.TWITTER_LABEL_MAP), "raw string, category string")
    return A.count_labels(A.map_labels(fx.tweets_flat(spark, sf), m, map_rows=len(fx.TWITTER_LABEL_MAP)), ["corpus", "tweet_id"])


# ---------------------------------------------------------------- multi-hot

def _rules(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("rot"))
    labs = F.concat_ws(",", *[F.when(u01("conv_id", "turn", F.lit(cat)) < 0.3, F.lit(cat)) for cat in CATEGORIES])
    labs = F.when(u01("conv_id", "turn", F.lit("null")) < 0.1, F.lit(None)).otherwise(labs)
    split = F.when(u01("conv_id", "turn", F.lit("split")) < 0.3, "test").otherwise("train")
    return c.select("conv_id", "turn", "rot", labs.alias("labels"), split.alias("split"))


_RULES_SQL = "rules AS (SELECT conv_id, turn, text AS rot, CASE WHEN " + S.u01("conv_id", "turn", S.q("null")) + " < 0.1 THEN NULL ELSE concat_ws(',', " + ", ".join(
    f"CASE WHEN {S.u01('conv_id', 'turn', S.q(c))} < 0.3 THEN '{c}' END" for c in CATEGORIES) + ") END AS labels, CASE WHEN " + S.u01(
    "conv_id", "turn", S.q("split")) + " < 0.3 THEN 'test' ELSE 'train' END AS split FROM conversations)"


@register("multihot_contains", "annotation", sql=S.with_(_RULES_SQL) + "SELECT conv_id, turn, " + ", ".join(
    f"CAST(coalesce(contains(labels, '{c}'), false) AS INTEGER) AS {c}" for c in CATEGORIES) + " FROM rules WHERE split = 'test'")
def multihot_contains(spark, sf):
    r = _rules(spark, sf).where(F.col("split") == "test")
    return A.multihot_contains(r, "labels").select("conv_id", "turn", *CATEGORIES)


@register("multihot_anyof", "annotation", sql=S.with_(SC.ARGS_SQL) + f""", a2 AS (SELECT arg_id, MF3 AS MF1b, MF1 AS MF2b FROM args WHERE {S.u01('arg_id', S.q('second'))} < 0.5)
SELECT a.arg_id, """ + ", ".join(
    f"CAST(coalesce(list_contains([a.MF1, a.MF2, a.MF3, b.MF1b, b.MF2b], '{c}'), false) AS INTEGER) AS {c}" for c in CATEGORIES)
    + " FROM args a JOIN a2 b ON b.arg_id = a.arg_id")
def multihot_anyof(spark, sf):
    a = SC.arguments(spark, sf)
    # the second annotator labelled about half of the arguments (inner join keeps those)
    b = a.where(u01("arg_id", F.lit("second")) < 0.5).select("arg_id", F.col("MF3").alias("MF1b"), F.col("MF1").alias("MF2b"))
    j = a.join(b, "arg_id", "inner")
    return A.multihot_anyof(j, ["MF1", "MF2", "MF3", "MF1b", "MF2b"]).select("arg_id", *CATEGORIES)


# ---------------------------------------------------------------- vignettes

# Raw foundation labels of the vignette corpus.
VIGNETTE_LABELS = ("Care (emotional)", "Care (physical)", "Fairness", "Liberty", "Loyalty", "Authority", "Sanctity (purity)")
PCT_COLS = (*CATEGORIES, "liberty", "not_wrong")


def _vignettes(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    lab = F.element_at(F.array(*[F.lit(v) for v in VIGNETTE_LABELS]),
                       (F.floor(u01("p_partkey", F.lit("vl")) * len(VIGNETTE_LABELS)) + 1).cast("int"))
    pct = [F.concat(F.floor(u01("p_partkey", F.lit(c)) * 100).cast("int").cast("string"), F.lit(" %")).alias(f"{c}_raw") for c in PCT_COLS]
    return p.select(F.col("p_partkey").alias("scenario_id"), F.col("p_name").alias("scenario"), lab.alias("foundation_raw"), *pct)


@register("vignette_prep", "annotation", sql="WITH v AS (SELECT p_partkey AS scenario_id, "
          + f"[{', '.join(S.q(v) for v in VIGNETTE_LABELS)}][CAST(floor({S.u01('p_partkey', S.q('vl'))} * {len(VIGNETTE_LABELS)}) AS INTEGER) + 1] AS foundation_raw, "
          + ", ".join(f"CAST(CAST(floor({S.u01('p_partkey', S.q(c))} * 100) AS INTEGER) AS VARCHAR) || ' %' AS {c}_raw" for c in PCT_COLS)
          + " FROM part), c AS (SELECT *, regexp_replace(lower(foundation_raw), ' ?\\(.*$', '') AS foundation FROM v)\n"
          + "SELECT scenario_id, foundation, " + ", ".join(
              f"round(CAST(regexp_extract({c}_raw, '^\\s*(\\d+)', 1) AS INTEGER) / 100.0, 6) AS {c}_pct" for c in PCT_COLS)
          + ", " + ", ".join(f"CAST(foundation = '{c}' AS INTEGER) AS {c}" for c in CATEGORIES) + " FROM c WHERE foundation <> 'liberty'")
def vignette_prep(spark, sf):
    v = _vignettes(spark, sf).withColumn("foundation", A.clean_label("foundation_raw")).where(F.col("foundation") != "liberty")
    return rounded(v.select("scenario_id", "foundation", *[A.parse_percent(f"{c}_raw").alias(f"{c}_pct") for c in PCT_COLS],
                            *[(F.col("foundation") == c).cast("int").alias(c) for c in CATEGORIES]))


# ---------------------------------------------------------------- corpus merge, row sums, unpivot

CORPUS_ORDER = ("news", "reddit", "twitter")


@register("corpus_merge", "annotation", sql="""SELECT corpus, source_id, rank_ || ':' || source_id AS id, CAST(length(text) AS INTEGER) AS n_chars, lang FROM (
  SELECT 'news' AS corpus, '0' AS rank_, CAST(doc_id AS VARCHAR) AS source_id, text, lang FROM documents
  UNION ALL SELECT 'reddit', '1', CAST(item_id AS VARCHAR), text, NULL FROM benchmark
  UNION ALL SELECT 'twitter', '2', conv_id || '-' || turn, text, NULL FROM conversations)""")
def corpus_merge(spark, sf):
    news = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "text", "lang")
    reddit = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("source_id"), "text")
    tw = table(spark, sf, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("source_id"), "text")
    parts = []
    for i, (name, df) in enumerate(zip(CORPUS_ORDER, (news, reddit, tw))):
        parts.append(df.withColumn("corpus", F.lit(name)).withColumn("id", F.concat_ws(":", F.lit(str(i)), "source_id")))
    u = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return u.select("corpus", "source_id", "id", F.length("text").alias("n_chars"), "lang")


@register("rowsum_filter", "annotation", sql=S.with_(S.POSTS) + f"""SELECT id, n_categories FROM (
  SELECT id, {' + '.join(f'CAST({c}_score >= 0.5 AS INTEGER)' for c in CATEGORIES)} AS n_categories FROM posts) WHERE n_categories = 3""")
def rowsum_filter(spark, sf):
    n = sum((F.col(f"{c}_score") >= 0.5).cast("int") for c in CATEGORIES)
    return fx.posts(spark, sf).select("id", n.alias("n_categories")).where(F.col("n_categories") == 3)


@register("unpivot_scores", "annotation", sql=S.with_(S.STANCE) + " " + " UNION ALL ".join(
    f"SELECT id, target, stance, '{c}' AS foundation, {c}_score AS score FROM stance WHERE stance <> 'NONE'" for c in CATEGORIES))
def unpivot_scores(spark, sf):
    st = fx.stance(spark, sf).where(F.col("stance") != "NONE")
    return st.unpivot(["id", "target", "stance"], [f"{c}_score" for c in CATEGORIES], "foundation", "score") \
        .withColumn("foundation", F.regexp_replace("foundation", "_score$", ""))
