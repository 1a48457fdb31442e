"""Lexicon group: load, build, .dic parse, Venn regions, three lexicon scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoscope.functions.hashing import u01
from annoscope.operators import lexicon as L, text as T
from annoscope.plans import fixtures as fx, sqlfrag as S
from annoscope.plans.catalog._util import rounded
from annoscope.plans.registry import register
from annoscope.plans.sizing import shared
from annoscope.schema import CATEGORIES, DIMENSIONS
from annoscope.session import scratch_path
from annoscope.sources import readers, sinks

# Raw category / sentiment spellings the lexicon-build fixture draws from
# (old names, odd case and spaces, and values outside the grid that must be dropped).
RAW_CATEGORY_SPELLINGS = (" Care", "harm", "AUTHORITY", "fairness ", "ingroup", "loyalty", "purity", "sanctity", "liberty")
RAW_SENTIMENT_SPELLINGS = ("virtue", "Vice ", "vice", "neutral")


#: Most frequent words whose lexicon rows are broadcast.
HEAVY = 1000


def _pick(values, *parts):
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(u01(*parts) * len(values)) + 1).cast("int"))


def _sql_pick(values, *parts):
    arr = "[" + ", ".join(S.q(v) for v in values) + "]"
    return f"{arr}[CAST(floor({S.u01(*parts)} * {len(values)}) AS INTEGER) + 1]"


# ---- lex_load: probability lexicon written as CSV and read back with an explicit schema ----

@register("lex_load", "lexicon", sql=S.with_(S.TOKENS, S.LEXICON_B) + "SELECT word, " + ", ".join(
    [f"round({c}_p, 6) AS {c}_p" for c in CATEGORIES] + [f"round({c}_sent, 6) AS {c}_sent" for c in CATEGORIES])
    + " FROM lexicon_b")
def lex_load(spark, sf):
    path = scratch_path(spark, "lexicon_b_csv")
    sinks.write_csv(fx.lexicon_b(spark, sf), path)
    return rounded(readers.read_problex_csv(spark, path))


# ---- lex_build: raw (word, category, sentiment) rows -> word -> dims ----

def _raw_lexicon_rows(spark, sf):
    vocab = fx.tokens(spark, sf).select(F.col("token").alias("word")).distinct()
    rows = vocab.select("word", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return rows.select("word", _pick(RAW_CATEGORY_SPELLINGS, "word", "k", F.lit("c")).alias("category"),
                       _pick(RAW_SENTIMENT_SPELLINGS, "word", "k", F.lit("s")).alias("sentiment"))


_LEX_BUILD_SQL = S.with_(S.TOKENS) + f""", raw AS (
  SELECT word, {_sql_pick(RAW_CATEGORY_SPELLINGS, 'word', 'k', S.q('c'))} AS category,
         {_sql_pick(RAW_SENTIMENT_SPELLINGS, 'word', 'k', S.q('s'))} AS sentiment
  FROM (SELECT DISTINCT token AS word FROM tokens) v CROSS JOIN (SELECT UNNEST([0, 1]) AS k) kk
), norm AS (
  SELECT word, CASE trim(lower(category)) {' '.join(f"WHEN {S.q(k)} THEN {S.q(v)}" for k, v in L.CATEGORY_ALIASES.items())}
                  ELSE trim(lower(category)) END AS c, trim(lower(sentiment)) AS p FROM raw
)
SELECT word, array_to_string(list_sort(list_distinct(list(c || '_' || p))), ',') AS dims
FROM norm WHERE list_contains({S.cats_list()}, c) AND p IN ('virtue', 'vice') GROUP BY word"""


@register("lex_build", "lexicon", sql=_LEX_BUILD_SQL)
def lex_build(spark, sf):
    lex = L.build_lexicon(_raw_lexicon_rows(spark, sf))
    return lex.select("word", F.array_join("dims", ",").alias("dims"))


@register("lex_json", "lexicon", sql=_LEX_BUILD_SQL)
def lex_json(spark, sf):
    """A lexicon written as JSON lines ``{"word": ..., "dims": [...]}`` and read back."""
    path = scratch_path(spark, "lexicon_json")
    sinks.write_json_lines(L.build_lexicon(_raw_lexicon_rows(spark, sf)), path)
    lex = readers.read_lexicon_jsonl(spark, path)
    return lex.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set("dim")), ",").alias("dims"))


# ---- lex_dic: .dic dictionaries written in parts, parsed back ----

DIC_CODES = tuple((str(i + 1), d.replace("_", ".")) for i, d in enumerate(DIMENSIONS))


def _dic_entries(spark, sf):
    vocab = fx.tokens(spark, sf).select(F.col("token").alias("w")).distinct().where(F.col("w").rlike(r"^\p{L}+$"))
    c1 = (F.floor(u01("w", F.lit("c1")) * len(DIC_CODES)) + 1).cast("int")
    c2 = (F.floor(u01("w", F.lit("c2")) * len(DIC_CODES)) + 1).cast("int")
    two_codes = u01("w", F.lit("two")) < 0.4
    split_word = (u01("w", F.lit("sp")) < 0.2) & (F.length("w") >= 4)
    return vocab.select("w", c1.alias("c1"), F.when(two_codes, c2).alias("c2"), split_word.alias("split"))


@register("lex_dic", "lexicon", sql=S.with_(S.TOKENS) + f""", e AS (
  SELECT w, CAST(floor({S.u01('w', S.q('c1'))} * {len(DIC_CODES)}) AS INTEGER) + 1 AS c1,
         CASE WHEN {S.u01('w', S.q('two'))} < 0.4 THEN CAST(floor({S.u01('w', S.q('c2'))} * {len(DIC_CODES)}) AS INTEGER) + 1 END AS c2
  FROM (SELECT DISTINCT token AS w FROM tokens) WHERE regexp_matches(w, '^\\p{{L}}+$')
), codes AS {S.values([(int(k), v.replace('.', '_')) for k, v in DIC_CODES], ['code', 'dim'])},
x AS (SELECT w, c1 AS code FROM e UNION ALL SELECT w, c2 FROM e WHERE c2 IS NOT NULL)
SELECT w AS word, array_to_string(list_sort(list_distinct(list(dim))), ',') AS dims
FROM x JOIN codes USING (code) GROUP BY w""")
def lex_dic(spark, sf):
    entries = _dic_entries(spark, sf)
    path = scratch_path(spark, "lexicon_dic")
    sinks.write_dic(entries, path, DIC_CODES)
    lex = L.parse_dic(readers.read_whole_texts(spark, path))
    return lex.select("word", F.array_join("dims", ",").alias("dims"))


# ---- lex_venn: seven Venn regions of three word sets ----

@register("lex_venn", "lexicon", sql=S.with_(S.TOKENS) + f""", w AS (SELECT DISTINCT token AS word FROM tokens),
sets AS (
  SELECT word, 1 AS in_a, 0 AS in_b, 0 AS in_c FROM w WHERE {S.u01('word', S.q('A'))} < 0.5
  UNION ALL SELECT word, 0, 1, 0 FROM w WHERE {S.u01('word', S.q('B'))} < 0.4
  UNION ALL SELECT word, 0, 0, 1 FROM w WHERE {S.u01('word', S.q('C'))} < 0.3
), per AS (SELECT word, max(in_a) AS in_a, max(in_b) AS in_b, max(in_c) AS in_c FROM sets GROUP BY word)
SELECT in_a, in_b, in_c, count(*) AS n_words FROM per GROUP BY in_a, in_b, in_c""")
def lex_venn(spark, sf):
    words = shared(fx.tokens(spark, sf).select(F.col("token").alias("word")).distinct())  # three filters, else pushed below the distinct
    a = words.where(u01("word", F.lit("A")) < 0.5)
    b = words.where(u01("word", F.lit("B")) < 0.4)
    c = words.where(u01("word", F.lit("C")) < 0.3)
    return L.lexicon_venn(a, b, c)


# ---- score_lexicon: word counts with lemma fallback ----

def _dim_sum(d):
    return f"sum(CASE WHEN list_contains(dims, {S.q(d)}) THEN 1 ELSE 0 END)"


# CTE list (without WITH) shared with the method-comparison query; ``lexscores`` is the result.
SCORE_LEX_CTES = ",\n".join([S.TOKENS, S.LEMMA_MAP, S.LEXICON_A]) + f""", tl AS (
  SELECT t.id, t.token, coalesce(trim(lower(m.lemma)), trim(lower(t.token))) AS lemma
  FROM tokens t LEFT JOIN lemma_map m ON m.token = t.token
), lx AS (SELECT word, list(dim) AS dims FROM lexicon_a GROUP BY word),
hits AS (SELECT tl.id, coalesce(a.dims, b.dims) AS dims FROM tl LEFT JOIN lx a ON a.word = tl.token LEFT JOIN lx b ON b.word = tl.lemma),
per AS (SELECT id, count(*) AS n_tokens, {', '.join(f'{_dim_sum(d)} AS {d}' for d in DIMENSIONS)} FROM hits GROUP BY id),
lexscores AS (
  SELECT d.doc_id AS id, coalesce(p.n_tokens, 0) AS n_tokens,
    {', '.join(f"round(CASE WHEN coalesce(p.n_tokens, 0) > 0 THEN p.{c}_virtue / p.n_tokens + p.{c}_vice / p.n_tokens ELSE coalesce(p.{c}_virtue + p.{c}_vice, 0) END, 6) AS {c}" for c in CATEGORIES)}
  FROM documents d LEFT JOIN per p ON p.id = d.doc_id
)"""
_SCORE_LEX_SQL = "WITH " + SCORE_LEX_CTES + "\nSELECT * FROM lexscores"


def lexicon_scores(spark, sf):
    tok = T.with_lemma(T.token_table(fx.texts(spark, sf)), fx.lemma_map(spark), lemma_rows=len(fx.LEMMA_ROWS))
    ids = fx.texts(spark, sf).select("id")
    return rounded(L.score_lexicon(tok, fx.lexicon_a(spark), ids=ids, lexicon_rows=len(fx.LEXICON_A_ROWS)))


@register("score_lexicon", "lexicon", sql=_SCORE_LEX_SQL)
def score_lexicon(spark, sf):
    return lexicon_scores(spark, sf)


@register("score_lexicon_heavy", "lexicon", sql=_SCORE_LEX_SQL)
def score_lexicon_heavy(spark, sf):
    """As ``score_lexicon``, with the join for lexicons above the broadcast limit."""
    tok = T.with_lemma(T.token_table(fx.texts(spark, sf)), fx.lemma_map(spark), lemma_rows=len(fx.LEMMA_ROWS))
    return rounded(L.score_lexicon(tok, fx.lexicon_a(spark), ids=fx.texts(spark, sf).select("id"), heavy=HEAVY))


# ---- score_problex / score_problex_sent ----

_CONTENT_CTE = f"""content AS (
  SELECT id, lower(t2) AS token FROM (
    SELECT id, regexp_replace(token, '[^\\p{{L}}]', '', 'g') AS t2 FROM tokens_cased
    WHERE NOT list_contains([{', '.join(S.q(w.lower()) for w in T.BAD_STRINGS)}], lower(token))
      AND NOT list_contains([{', '.join(S.q(w) for w in T.default_stop_words())}], token)
  ) WHERE length(t2) >= 3
)"""

_PROBLEX_SQL = S.with_(S.TOKENS, S.TOKENS_CASED, S.LEXICON_B, _CONTENT_CTE) + f""", per AS (
  SELECT c.id, count(*) AS n, {', '.join(f'sum(l.{c}_p) AS {c}' for c in CATEGORIES)}
  FROM content c JOIN lexicon_b l ON l.word = c.token GROUP BY c.id
)
SELECT d.doc_id AS id, {', '.join(f'round(coalesce(p.{c} / greatest(p.n, 1), 0), 6) AS {c}' for c in CATEGORIES)}
FROM documents d LEFT JOIN per p ON p.id = d.doc_id"""


def _content(spark, sf):
    return T.content_tokens(T.token_table(fx.texts(spark, sf), lower=False))


@register("score_problex", "lexicon", sql=_PROBLEX_SQL)
def score_problex(spark, sf):
    words = fx.vocabulary(spark, sf)
    return rounded(L.score_problex(_content(spark, sf), fx.lexicon_b(spark, sf, words), ids=fx.texts(spark, sf).select("id"),
                                   frequent=fx.frequent_words(words)))


@register("score_problex_heavy", "lexicon", sql=_PROBLEX_SQL)
def score_problex_heavy(spark, sf):
    """As ``score_problex``, with the join for lexicons above the broadcast limit."""
    return rounded(L.score_problex(_content(spark, sf), fx.lexicon_b(spark, sf), ids=fx.texts(spark, sf).select("id"), heavy=HEAVY))


def _sent_cols():
    out = []
    for c in CATEGORIES:
        for pole, cond in (("virtue", f"coalesce(l.{c}_sent >= 0, false)"), ("vice", f"NOT coalesce(l.{c}_sent >= 0, false)")):
            out.append((f"{c}_{pole}", f"sum(CASE WHEN {cond} THEN l.{c}_p ELSE 0 END)", f"sum(CASE WHEN {cond} THEN 1 ELSE 0 END)"))
    return out


_PROBLEX_SENT_SQL = S.with_(S.TOKENS, S.TOKENS_CASED, S.LEXICON_B, _CONTENT_CTE) + f""", per AS (
  SELECT c.id, {', '.join(f'{s} AS {d}, {n} AS n_{d}' for d, s, n in _sent_cols())}
  FROM content c JOIN lexicon_b l ON l.word = c.token GROUP BY c.id
)
SELECT d.doc_id AS id, {', '.join(f'round(coalesce(p.{d} / greatest(p.n_{d}, 1), 0), 6) AS {d}' for d, _s, _n in _sent_cols())}
FROM documents d LEFT JOIN per p ON p.id = d.doc_id"""


@register("score_problex_sent", "lexicon", sql=_PROBLEX_SENT_SQL)
def score_problex_sent(spark, sf):
    words = fx.vocabulary(spark, sf)
    return rounded(L.score_problex(_content(spark, sf), fx.lexicon_b(spark, sf, words), sentiment=True,
                                   ids=fx.texts(spark, sf).select("id"), frequent=fx.frequent_words(words)))
