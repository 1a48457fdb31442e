"""Text group: normalisation, token tables, sentences, sub-word merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoscope.functions.text import NORMALIZE_RULES, normalize_text
from annoscope.functions.hashing import u01_below
from annoscope.operators import text as T
from annoscope.plans import fixtures as fx, sqlfrag as S
from annoscope.plans.catalog._util import rounded
from annoscope.plans.registry import register
from annoscope.plans.tables import table


def _sql_normalize(expr: str) -> str:
    out = expr
    for pat, rep in NORMALIZE_RULES:
        out = f"regexp_replace({out}, {S.q(pat)}, {S.q(rep)}, 'g')"
    return out


def _stop_list_sql() -> str:
    return "[" + ", ".join(S.q(w) for w in T.default_stop_words()) + "]"


def _bad_list_sql() -> str:
    return "[" + ", ".join(S.q(w.lower()) for w in T.BAD_STRINGS) + "]"


@register("text_normalize", "text", sql=f"SELECT doc_id AS id, {_sql_normalize('text')} AS text FROM documents")
def text_normalize(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), normalize_text("text").alias("text"))


@register("tok_basic", "text", sql=S.with_(S.TOKENS) + "SELECT id, pos, token FROM tokens")
def tok_basic(spark, sf):
    return T.token_table(fx.texts(spark, sf))


_LEMMA_SQL = S.with_(S.TOKENS, S.LEMMA_MAP) + """SELECT t.id, t.pos, t.token,
  coalesce(trim(lower(m.lemma)), trim(lower(t.token))) AS lemma
FROM tokens t LEFT JOIN lemma_map m ON m.token = t.token"""


@register("tok_lemma", "text", sql=_LEMMA_SQL)
def tok_lemma(spark, sf):
    return T.with_lemma(T.token_table(fx.texts(spark, sf)), fx.lemma_map(spark), lemma_rows=len(fx.LEMMA_ROWS))


_CONTENT_SQL = S.with_(S.TOKENS_CASED) + f"""SELECT id, pos, lower(t2) AS token FROM (
  SELECT id, pos, regexp_replace(token, '[^\\p{{L}}]', '', 'g') AS t2 FROM tokens_cased
  WHERE NOT list_contains({_bad_list_sql()}, lower(token)) AND NOT list_contains({_stop_list_sql()}, token)
) WHERE length(t2) >= 3"""


@register("tok_content", "text", sql=_CONTENT_SQL)
def tok_content(spark, sf):
    cased = T.token_table(fx.texts(spark, sf), lower=False)
    return T.content_tokens(cased).select("id", "pos", "token")


# Words that a caller adds to the default stop words (C5 unites several lists).
EXTRA_STOP_WORDS = (("une", "est", "que"), ("und", "der", "die", "que"))


@register("tok_content_tagged", "text", sql=S.with_(S.TOKENS_CASED) + f""", tagged AS (
  SELECT *, CASE WHEN {S.u01('id', 'pos', S.q('ent'))} < 0.1 THEN 'PERSON' END AS ent,
         CASE WHEN {S.u01('id', 'pos', S.q('tag'))} < 0.6 THEN 'NN' ELSE 'DT' END AS tag FROM tokens_cased
)
SELECT id, pos, lower(t2) AS token FROM (
  SELECT id, pos, regexp_replace(token, '[^\\p{{L}}]', '', 'g') AS t2 FROM tagged
  WHERE ent IS NULL AND tag = 'NN' AND NOT list_contains({_bad_list_sql()}, lower(token)) AND NOT list_contains({_stop_list_sql()}, token)
    AND NOT list_contains([{', '.join(S.q(w) for ws in EXTRA_STOP_WORDS for w in ws)}], token)
) WHERE length(t2) >= 3""")
def tok_content_tagged(spark, sf):
    """Content tokens of a table with entity and tag columns, without the words of three united stop lists."""
    cased = T.token_table(fx.texts(spark, sf), lower=False)
    tagged = cased.withColumn("ent", F.when(u01_below(0.1, "id", "pos", F.lit("ent")), "PERSON")) \
        .withColumn("tag", F.when(u01_below(0.6, "id", "pos", F.lit("tag")), "NN").otherwise("DT"))
    stop = T.united_stop_words(T.default_stop_words(), *EXTRA_STOP_WORDS)
    return T.content_tokens(tagged, stop_words=stop).select("id", "pos", "token")


_BOW_SQL = S.with_(S.TOKENS, S.LEMMA_MAP) + f"""SELECT id, pos, term FROM (
  SELECT t.id, t.pos, trim(lower(coalesce(trim(lower(m.lemma)), trim(lower(t.token))))) AS term
  FROM tokens t LEFT JOIN lemma_map m ON m.token = t.token
) WHERE NOT list_contains({_stop_list_sql()}, term) AND regexp_matches(term, '^\\p{{L}}+$') AND length(term) >= 3"""


@register("tok_bow", "text", sql=_BOW_SQL)
def tok_bow(spark, sf):
    tok = T.with_lemma(T.token_table(fx.texts(spark, sf)), fx.lemma_map(spark), lemma_rows=len(fx.LEMMA_ROWS))
    return T.bow_tokens(tok).select("id", "pos", "term")


@register("sent_spans", "text", sql=S.with_(S.SENTENCES) + 'SELECT id, sent_no, start, "end", sentence FROM sentences')
def sent_spans(spark, sf):
    return fx.sentences(spark, sf)


_SUBWORD_SQL = S.with_(S.TOKENS, S.SUBWORD) + """,
kept AS (
  SELECT * FROM (SELECT *, min(pos) OVER (PARTITION BY id) AS mn, max(pos) OVER (PARTITION BY id) AS mx FROM pieces)
  WHERE pos <> mn AND pos <> mx
),
marked AS (
  SELECT id, pos, score,
         CASE WHEN starts_with(token, 'Ġ') THEN substring(token, 2) ELSE token END AS piece,
         CAST(sum(CASE WHEN starts_with(token, 'Ġ') THEN 1 ELSE 0 END)
              OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS word_no
  FROM kept
)
SELECT id, word_no, string_agg(piece, '' ORDER BY pos) AS word, round(avg(score), 6) AS score, min(pos) AS first_pos
FROM marked GROUP BY id, word_no"""


@register("subword_merge", "text", sql=_SUBWORD_SQL)
def subword_merge(spark, sf):
    return rounded(T.subword_merge(fx.subword_pieces(spark, sf)))
