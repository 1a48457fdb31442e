"""DuckDB twins of the fixtures (for the oracle SQL). Same rules as ``fixtures.py``."""

from __future__ import annotations

from annoscope.functions.text import SENTENCE_PATTERN, TOKEN_PATTERN
from annoscope.plans import fixtures as fx
from annoscope.schema import CATEGORIES


def q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def u01(*parts: str) -> str:
    """parts are SQL expressions; they are cast to VARCHAR and concatenated."""
    cat = " || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(('0x' || substr(md5({cat}), 1, 8))::BIGINT / 4294967296.0)"


def cats_list() -> str:
    return "[" + ", ".join(q(c) for c in CATEGORIES) + "]"


def values(rows, cols) -> str:
    body = ", ".join("(" + ", ".join(q(v) if (v is None or isinstance(v, str)) else str(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(cols)}))"


TOKENS = f"""tokens AS (
  SELECT doc_id AS id, CAST(UNNEST(range(len(toks))) AS INTEGER) AS pos, UNNEST(toks) AS token
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '{TOKEN_PATTERN}') AS toks FROM documents)
)"""

TOKENS_CASED = f"""tokens_cased AS (
  SELECT doc_id AS id, CAST(UNNEST(range(len(toks))) AS INTEGER) AS pos, UNNEST(toks) AS token
  FROM (SELECT doc_id, regexp_extract_all(text, '{TOKEN_PATTERN}') AS toks FROM documents)
)"""

LEMMA_MAP = f"lemma_map AS {values(fx.LEMMA_ROWS, ['token', 'lemma'])}"
LEXICON_A = f"lexicon_a AS {values(fx.LEXICON_A_ROWS, ['word', 'dim'])}"

LEXICON_B = "lexicon_b AS (\n  SELECT word, " + ", ".join(
    [f"{u01('word', q(c))} AS {c}_p" for c in CATEGORIES]
    + [f"2 * {u01('word', q(c), q('s'))} - 1 AS {c}_sent" for c in CATEGORIES]
) + f"\n  FROM (SELECT DISTINCT token AS word FROM tokens)\n)"

WORD_VECTORS = f"""word_vectors AS (
  SELECT v.token, e.embedding AS vec
  FROM (SELECT token, CAST(floor({u01('token')} * (SELECT max(vec_id) + 1 FROM embeddings)) AS BIGINT) AS vec_id
        FROM (SELECT DISTINCT token FROM tokens) WHERE {u01('token', q('oov'))} >= 0.3) v
  JOIN embeddings e ON e.vec_id = v.vec_id
)"""

SENTENCES = f"""sentences AS (
  SELECT id, sent_no, "end" - len AS start, "end", sentence FROM (
    SELECT id, sent_no, sentence, len,
           CAST(sum(len) OVER (PARTITION BY id ORDER BY sent_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS "end"
    FROM (SELECT doc_id AS id, CAST(UNNEST(range(len(s))) AS INTEGER) AS sent_no, UNNEST(s) AS sentence,
                 CAST(length(UNNEST(s)) AS INTEGER) AS len
          FROM (SELECT doc_id, regexp_extract_all(text, '{SENTENCE_PATTERN}') AS s FROM documents))
  )
)"""


def cat_at(expr_u01: str) -> str:
    return f"{cats_list()}[CAST(floor({expr_u01} * {len(CATEGORIES)}) AS INTEGER) + 1]"


HIGHLIGHTS = f"""highlights AS (
  SELECT c.coder_id, CAST(d.doc_id AS VARCHAR) AS document_id,
         {cat_at(u01('d.doc_id', 'c.coder_id'))} AS assigned_domain,
         substring(d.text, 1 + CAST(floor({u01('d.doc_id', 'c.coder_id', q('p'))} * d.n_chars) AS INTEGER), 40) AS content,
         1800.0 + 2400.0 * {u01('d.doc_id', 'c.coder_id', q('d'))} AS focus_duration
  FROM documents d CROSS JOIN (SELECT UNNEST([{', '.join(str(c) for c in fx.HIGHLIGHT_CODERS)}]) AS coder_id) c
)"""

ARTICLES = "articles AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, text FROM documents)"


def _names_list(pairs) -> str:
    return "[" + ", ".join(q(k) for k, _ in pairs) + "]"


_RN = len(fx.REDDIT_LABEL_MAP)
REDDIT = f"""reddit AS (
  SELECT d.doc_id, a.annotator, d.text,
         CASE WHEN {u01('d.doc_id', 'a.annotator', q('k'))} < 0.3
              THEN {_names_list(fx.REDDIT_LABEL_MAP)}[CAST(floor({u01('d.doc_id', 'a.annotator', q('a'))} * {_RN}) AS INTEGER) + 1]
                   || ',' || {_names_list(fx.REDDIT_LABEL_MAP)}[CAST(floor({u01('d.doc_id', 'a.annotator', q('b'))} * {_RN}) AS INTEGER) + 1]
              ELSE {_names_list(fx.REDDIT_LABEL_MAP)}[CAST(floor({u01('d.doc_id', 'a.annotator', q('a'))} * {_RN}) AS INTEGER) + 1] END AS annotation
  FROM documents d CROSS JOIN (SELECT UNNEST([0, 1, 2]) AS annotator) a
)"""

REDDIT_MAP = f"reddit_map AS {values(fx.REDDIT_LABEL_MAP, ['raw', 'category'])}"

SCORED = "scored AS (\n  SELECT l.doc_id AS id, d.lang AS corpus, l.quality AS y, " + ", ".join(
    f"round(0.7 * {u01('l.doc_id', q(c))} + 0.3 * l.quality, 2) AS {c}_score" for c in CATEGORIES
) + "\n  FROM labels l JOIN documents d ON d.doc_id = l.doc_id\n)"

SCORED_LONG = "scored_long AS (\n" + "\n  UNION ALL\n".join(
    f"  SELECT id, corpus, {q(c)} AS category, y AS y_true, {c}_score AS y_score FROM scored" for c in CATEGORIES
) + "\n)"

TRISTATE = f"""tristate AS (
  SELECT l.doc_id AS id, c.category,
         CASE WHEN {u01('l.doc_id', 'c.category', q('seen'))} < 0.2 THEN -1 ELSE l.quality END AS label
  FROM labels l CROSS JOIN (SELECT UNNEST({cats_list()}) AS category) c
)"""

POSTS = "posts AS (\n  SELECT p_partkey AS id, CAST(TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(p_partkey % 1000 AS INTEGER)) AS TIMESTAMP) AS created,\n" \
        f"         CAST(TIMESTAMP '1995-01-01 00:00:00' + to_days(CAST(p_partkey % 1000 AS INTEGER)) + to_days(CASE WHEN p_partkey % 10 = 0 THEN 600 ELSE {fx.POST_WINDOW_DAYS + 1} END) AS TIMESTAMP) AS retrieved_on, p_retailprice AS score,\n" \
        "         't' || CAST(p_partkey % 7 AS VARCHAR) AS topic_1, 't' || CAST(CAST(floor(p_partkey / 7) AS BIGINT) % 7 AS VARCHAR) AS topic_2,\n         " + \
        ", ".join(f"{u01(q('p'), 'p_partkey', q(c))} AS {c}_score" for c in CATEGORIES) + "\n  FROM part\n)"


def _case(expr: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = {q(k)} THEN {q(v)}" for k, v in pairs) + " END"


COMMENTS = f"""comments AS (
  SELECT *, {', '.join(f"{u01(q('c'), 'id', q(c))} AS {c}_score" for c in CATEGORIES)}
  FROM (
    SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                     CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d')) AS id,
           l_partkey AS parent_id, l_shipdate AS created, l_extendedprice AS score,
           {_case("l_returnflag || l_linestatus", fx.COMMENT_LABELS)} AS label
    FROM lineitem
  )
)"""

STANCE = f"""stance AS (
  SELECT o_orderkey AS id, o_orderpriority AS target, {_case('o_orderstatus', fx.STANCE_MAP)} AS stance,
         {', '.join(f"round({u01('o_orderkey', q(c))}, 2) AS {c}_score" for c in CATEGORIES)}
  FROM orders
)"""

URL_PAGES = f"""url_pages AS (
  SELECT page_id, CASE WHEN {u01('page_id')} < 0.6 THEN url || '/' ||
           CAST(2000 + CAST(floor({u01('page_id', q('y'))} * 20) AS INTEGER) AS VARCHAR) || '/' ||
           CAST(1 + CAST(floor({u01('page_id', q('m'))} * 12) AS INTEGER) AS VARCHAR) || '/' ||
           CAST(1 + CAST(floor({u01('page_id', q('d'))} * 28) AS INTEGER) AS VARCHAR) || '/'
         ELSE url END AS url
  FROM pages
)"""

SUBWORD = f"""pieces AS (
  SELECT id, pos, CASE WHEN {u01('id', 'pos')} < 0.6 THEN 'Ġ' || token ELSE token END AS token,
         {u01('id', 'pos', q('s'))} AS score
  FROM tokens
)"""

ML_FEATURES = """ml_features AS (
  SELECT vec_id AS id, embedding AS vec, CAST(label < 5 AS INTEGER) AS y,
         CAST((('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 10) + 1 AS INTEGER) AS fold
  FROM embeddings
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


SCORED_FOLDS = SCORED + ",\n" + SCORED_LONG + """,
scored_folds AS (
  SELECT id, corpus, category,
         CAST((('0x' || substr(md5(CAST(id AS VARCHAR) || 'fold'), 1, 8))::BIGINT % 11) AS INTEGER) AS fold,
         y_true, y_score
  FROM scored_long
)"""


def _pb(g):
    return ("PARTITION BY " + ", ".join(g)) if g else ""


def _gsel(g, alias=None):
    if not g:
        return ""
    return ", ".join(f"{alias}.{c}" if alias else c for c in g) + ", "


def ranked_ctes(src: str, g, name: str = "rc", y: str = "y_true", s: str = "y_score", desc: bool = True) -> str:
    """Distinct-score counts with running tps/fps, vertex index k and group totals P, N, K."""
    order = "DESC" if desc else "ASC"
    gb = (", ".join(g) + ", ") if g else ""
    return f"""{name}_cnt AS (
  SELECT {gb}CAST({s} AS DOUBLE) AS score, CAST(sum({y}) AS BIGINT) AS pos, CAST(sum(1 - {y}) AS BIGINT) AS neg
  FROM {src} WHERE {y} IS NOT NULL AND {s} IS NOT NULL GROUP BY {gb}CAST({s} AS DOUBLE)
), {name} AS (
  SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tps, CAST(sum(neg) OVER w AS BIGINT) AS fps,
         CAST(row_number() OVER w AS BIGINT) AS k,
         CAST(sum(pos) OVER ({_pb(g)}) AS BIGINT) AS n_pos, CAST(sum(neg) OVER ({_pb(g)}) AS BIGINT) AS n_neg,
         CAST(count(*) OVER ({_pb(g)}) AS BIGINT) AS n_scores
  FROM {name}_cnt WINDOW w AS ({_pb(g)} ORDER BY score {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)"""


def roc_ctes(src: str, g, name: str = "roc") -> str:
    return ranked_ctes(src, g, f"{name}_rc") + f""", {name}_nx AS (
  SELECT *, lead(pos) OVER ({_pb(g)} ORDER BY k) AS pos_next, lead(neg) OVER ({_pb(g)} ORDER BY k) AS neg_next
  FROM {name}_rc WHERE n_pos > 0 AND n_neg > 0
), {name}_kept AS (
  SELECT * FROM {name}_nx WHERE n_scores <= 2 OR k = 1 OR k = n_scores OR pos_next <> pos OR neg_next <> neg
), {name} AS (
  SELECT {_gsel(g)}k, score AS threshold, fps, tps, fps / n_neg AS fpr, tps / n_pos AS tpr FROM {name}_kept
  UNION ALL
  SELECT {_gsel(g)}CAST(0 AS BIGINT) AS k, 'inf'::DOUBLE AS threshold, CAST(0 AS BIGINT) AS fps, CAST(0 AS BIGINT) AS tps,
         0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr FROM {name}_kept WHERE k = 1
)"""


def pr_ctes(src: str, g, name: str = "pr") -> str:
    return ranked_ctes(src, g, f"{name}_rc") + f""", {name}_full AS (
  SELECT {_gsel(g)}min(k) AS kfull FROM {name}_rc WHERE tps = n_pos AND n_pos > 0 {('GROUP BY ' + ', '.join(g)) if g else ''}
), {name} AS (
  SELECT {_gsel(g, 'r')}r.k, r.score AS threshold, r.tps / r.n_pos AS recall, r.tps / (r.tps + r.fps) AS precision
  FROM {name}_rc r JOIN {name}_full f ON {' AND '.join(f'f.{c} = r.{c}' for c in g) if g else 'TRUE'}
  WHERE r.k <= f.kfull
  UNION ALL
  SELECT {_gsel(g)}CAST(0 AS BIGINT), NULL::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE FROM {name}_rc WHERE k = 1 AND n_pos > 0
)"""


def interp_ctes(vert: str, g, x: str, y: str, name: str, n: int = 100, force=None) -> str:
    """NumPy-interp semantics: segment from the last vertex (k order) with x <= grid point."""
    step = repr(1.0 / (n - 1))
    fi = ""
    val = "v"
    if force is not None:
        val = f"CASE WHEN i = {force[0]} THEN {float(force[1])!r}::DOUBLE ELSE v END"
    jg = " AND ".join([f"s.{c} = gr.{c}" for c in g] + ["TRUE"])
    return f"""{name}_v AS (
  SELECT {_gsel(g)}k, {x} AS x, {y} AS y, lead({x}) OVER ({_pb(g)} ORDER BY k) AS x_next,
         lead({y}) OVER ({_pb(g)} ORDER BY k) AS y_next
  FROM {vert}
), {name}_seg AS (SELECT * FROM {name}_v WHERE x_next IS NULL OR x_next > x),
{name}_grid AS (
  SELECT DISTINCT {_gsel(g)}CAST(UNNEST(range({n})) AS INTEGER) AS i FROM {vert}
), {name}_hit AS (
  SELECT {_gsel(g, 'gr')}gr.i, gr.i * {step}::DOUBLE AS grid,
         arg_max(CASE WHEN s.x_next IS NULL THEN s.y ELSE s.y + (gr.i * {step}::DOUBLE - s.x) * (s.y_next - s.y) / (s.x_next - s.x) END, s.k) AS v
  FROM {name}_grid gr JOIN {name}_seg s ON {jg}
   AND gr.i * {step}::DOUBLE >= s.x AND (s.x_next IS NULL OR gr.i * {step}::DOUBLE < s.x_next)
  GROUP BY {_gsel(g, 'gr')}gr.i
), {name} AS (SELECT {_gsel(g)}i, grid, {val} AS value FROM {name}_hit)"""


_TN = len(fx.TWITTER_LABEL_MAP)
TWEETS = f"""tweets AS (
  SELECT 'c' || CAST(c.conv_id % 3 AS VARCHAR) AS corpus, CAST(c.conv_id AS VARCHAR) || '-' || CAST(c.turn AS VARCHAR) AS tweet_id,
         c.text AS tweet_text, a.annotator,
         CASE WHEN {u01('c.conv_id', 'c.turn', 'a.annotator', q('k'))} < 0.3
              THEN {_names_list(fx.TWITTER_LABEL_MAP)}[CAST(floor({u01('c.conv_id', 'c.turn', 'a.annotator', q('a'))} * {_TN}) AS INTEGER) + 1]
                   || ',' || {_names_list(fx.TWITTER_LABEL_MAP)}[CAST(floor({u01('c.conv_id', 'c.turn', 'a.annotator', q('b'))} * {_TN}) AS INTEGER) + 1]
              ELSE {_names_list(fx.TWITTER_LABEL_MAP)}[CAST(floor({u01('c.conv_id', 'c.turn', 'a.annotator', q('a'))} * {_TN}) AS INTEGER) + 1] END AS annotation
  FROM conversations c CROSS JOIN (SELECT UNNEST([0, 1]) AS annotator) a
)"""
TWITTER_MAP = f"twitter_map AS {values(fx.TWITTER_LABEL_MAP, ['raw', 'category'])}"
