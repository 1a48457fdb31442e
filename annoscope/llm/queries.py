"""Registered queries of the training-data operators: thin digests over the operators' results.

``QUERIES`` maps a name to its Spark builder; ``SQL`` has the DuckDB SQL where one can express the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---- 5: substring dedup ----
@_query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.substring_dedup import remove_repeats

    done = remove_repeats(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


SQL["op5_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13
), g AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 12], ' ')) AS h FROM p
), f AS (
  SELECT h, min(doc_id) AS least FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT g.doc_id, g.i + k.j AS i
  FROM g JOIN f ON g.h = f.h AND f.least < g.doc_id, (SELECT unnest(range(0, 13)) AS j) k
), r AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
), k AS (
  SELECT w.doc_id, w.ws, coalesce(r.gone, []) AS gone FROM w LEFT JOIN r ON w.doc_id = r.doc_id
), s AS (
  SELECT doc_id, ws, gone, list_filter(ws, lambda x, i: NOT list_contains(gone, i)) AS kept FROM k
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256
FROM s
"""


# ---- 8: mixing sources to target weights ----
@_query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.mixing import curriculum, digest

    out = digest(curriculum(_read(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken", *[F.round(c, 9).alias(c) for c in ("first_position", "last_position")])


def _inverse_sql(share: str) -> str:
    """The time at which a source's schedule has used up this share of its weight, by the source's slot."""
    from annoscope.llm.mixing import SCHEDULES, integral

    cases = []
    for slot, knots in enumerate(SCHEDULES):
        done, parts = 0.0, []
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            area, slope, need = (t1 - t0) * (w0 + w1) / 2, (w1 - w0) / (t1 - t0), f"({share} * {integral(knots)}::DOUBLE)"
            a = f"greatest({need} - {done}::DOUBLE, 0.0::DOUBLE)"
            root = f"({w0}::DOUBLE + sqrt(greatest({w0 * w0}::DOUBLE + {2 * slope}::DOUBLE * {a}, 0.0::DOUBLE)))"
            parts.append(f"WHEN {need} <= {done + area}::DOUBLE THEN least({t0}::DOUBLE + CASE WHEN {root} > 0 THEN 2 * {a} / {root} ELSE 0.0::DOUBLE END, {t1}::DOUBLE)")
            done += area
        cases.append(f"WHEN {slot} THEN CASE {' '.join(parts)} ELSE 1.0::DOUBLE END")
    return f"CASE slot {' '.join(cases)} END"


SQL["op8_source_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' ' || md5(coalesce(text, ''))) AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS n, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS slot,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER o AS k,
         (sum(n) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
           / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * n / w, source ASC NULLS LAST)
), t AS (
  SELECT source, slot, n, CASE WHEN level IS NULL THEN 2.0::DOUBLE * n ELSE least(2.0::DOUBLE * n, level * w) END AS target
  FROM (SELECT *, (SELECT min_by(rate, k) FROM r WHERE rate * w <= 2.0::DOUBLE * n) AS level FROM r)
), p AS (
  SELECT d.doc_id, d.size, t.slot, CAST(t.n AS BIGINT) AS source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS demand,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS begins
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(one + two AS BIGINT) AS taken,
       round(CASE WHEN one > 0 THEN first ELSE CASE WHEN two > 0 THEN second END END, 9) AS first_position,
       round(CASE WHEN two > 0 THEN second ELSE CASE WHEN one > 0 THEN first END END, 9) AS last_position
FROM (
  SELECT *, greatest(least(size, demand - begins), 0) AS one, greatest(least(size, demand - begins - source_size), 0) AS two,
         @FIRST AS first, @SECOND AS second
  FROM p
)
""".replace("@FIRST", _inverse_sql("(CAST(begins AS DOUBLE) / nullif(target, 0))")).replace("@SECOND", _inverse_sql("(CAST(begins + source_size AS DOUBLE) / nullif(target, 0))"))


# ---- 4: MinHash near-dedup ----
@_query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.near_dedup import near_duplicates

    classes = near_duplicates(_read(spark, sf_dir, "documents"))
    return classes.withColumn("kept", (F.col("doc_id") == F.col("class_id")).cast("int"))


# ---- 1: benchmark decontamination ----
@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.decontaminate import find_leaks

    return find_leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


# ---- 2: quality classifier ----
@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.quality import classify

    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


# ---- 10: personal data ----
#: The key of the registered query and of the pipeline; a deployment gives its own.
PII_KEY = "annoscope-demo-key"


@_query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.pii import pseudonymise

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, PII_KEY, found="replaced")
    return out.select("doc_id", "text", F.coalesce(F.size("replaced"), F.lit(0)).alias("n_replaced"))


# ---- 3: document fingerprints ----
@_query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.fingerprint import compared

    return compared(_read(spark, sf_dir, "documents"))


# ---- 6: token counts ----
@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.token_count import count_tokens

    return count_tokens(_read(spark, sf_dir, "documents"))


# ---- 9: URL filter ----
@_query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.url_filter import judge

    return judge(_read(spark, sf_dir, "pages")).drop("score")


def _url_sql() -> str:
    from annoscope.llm.url_filter import ALPHABET, BEFORE, CUTS, ORDERS, OTHER, RANGE, RULES, SYMBOLS, UNIT, WEIGHT

    parts = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    upper, lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

    def fits(name: str) -> str:
        h, _, rest = name.partition("/")
        return f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{rest}')"

    longest = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = " ".join(f"WHEN {fits(n)} THEN '{n}'" for n, _ in longest)
    verdict = " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in RULES)
    code = lambda k: (f"CASE WHEN i <= {k} THEN {BEFORE} WHEN strpos('{ALPHABET}', substr(t, i - {k}, 1)) > 0 "  # noqa: E731
                      f"THEN strpos('{ALPHABET}', substr(t, i - {k}, 1)) - 1 ELSE {OTHER} END")
    run = " + ".join(f"({code(o)}) * {SYMBOLS ** o}::BIGINT" for o in range(ORDERS))
    models = []
    for o in range(1, ORDERS + 1):
        models.append(f"n{o} AS MATERIALIZED (SELECT run % {SYMBOLS ** o} AS run, sum(a) AS a, sum(b) AS b FROM n GROUP BY 1)")
        models.append(f"x{o} AS (SELECT run // {SYMBOLS} AS context, sum(a) AS a, sum(b) AS b FROM n{o} GROUP BY 1)")
        less = f"JOIN p{o - 1} l ON l.run = n.run % {SYMBOLS ** (o - 1)}" if o > 1 else ""
        p = lambda c: f"l.{c}" if o > 1 else f"1.0::DOUBLE / {SYMBOLS}"
        chance = lambda c: f"(n.{c}::DOUBLE + {WEIGHT}::DOUBLE * ({p('p' + c)})) / (x.{c}::DOUBLE + {WEIGHT}::DOUBLE) AS p{c}"
        models.append(f"p{o} AS MATERIALIZED (SELECT n.run, {chance('a')}, {chance('b')} FROM n{o} n JOIN x{o} x ON x.context = n.run // {SYMBOLS} {less})")
    models = ", ".join(models)
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, translate(coalesce(url, ''), {upper}, {lower}) AS t,
         translate(coalesce(regexp_extract(url, {parts}, 1), ''), {upper}, {lower}) AS host, coalesce(regexp_extract(url, {parts}, 2), '') AS path,
         substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 1) IN ('0', '1', '2') AS apart
  FROM pages
), d AS (
  SELECT *, CASE {rule} END AS rule FROM p
), v AS (
  SELECT *, CASE rule {verdict} END AS told FROM d
), e AS MATERIALIZED (
  SELECT r, {run} AS run FROM (SELECT r, t, unnest(range(1, length(t) + 1)) AS i FROM v)
), n AS MATERIALIZED (
  SELECT run, count(*) FILTER (told = 'allow' AND NOT apart) AS a, count(*) FILTER (told = 'block' AND NOT apart) AS b FROM e JOIN v USING (r) GROUP BY run
), {models}, q AS (
  SELECT r, sum(CAST(floor((ln(pa) - ln(pb)) / {UNIT}::DOUBLE + 0.5::DOUBLE) AS BIGINT))::DOUBLE * {UNIT}::DOUBLE / count(*) AS score
  FROM e JOIN p{ORDERS} USING (run) GROUP BY r
), w AS MATERIALIZED (
  SELECT v.*, coalesce(q.score, 0.0) AS score FROM v LEFT JOIN q USING (r)
), h AS (
  SELECT least(greatest(CAST(floor((score + {RANGE}) / {2 * RANGE / CUTS}::DOUBLE) AS INTEGER), 0), {CUTS - 1}) AS cell,
         count(*) FILTER (told = 'allow') AS good, count(*) FILTER (told = 'block') AS bad
  FROM w WHERE told IS NOT NULL AND apart GROUP BY 1
), g AS (
  SELECT i, coalesce(sum(h.good) FILTER (h.cell < i), 0) / nullif((SELECT sum(good) FROM h), 0)::DOUBLE
            + coalesce(sum(h.bad) FILTER (h.cell >= i), 0) / nullif((SELECT sum(bad) FROM h), 0)::DOUBLE AS err
  FROM (SELECT unnest(range(0, {CUTS})) AS i), h GROUP BY i
), b AS (
  SELECT list(i ORDER BY i) AS least FROM g WHERE err = (SELECT min(err) FROM g)
), l AS (
  SELECT coalesce(-{RANGE}::DOUBLE + least[len(least) // 2 + 1] * {2 * RANGE / CUTS}::DOUBLE, 0.0) AS level FROM b
)
SELECT page_id, host, path, rule, coalesce(told, CASE WHEN score >= coalesce((SELECT level FROM l), 0.0) THEN 'allow' ELSE 'block' END) AS verdict
FROM w
"""


SQL["op9_url_filter"] = _url_sql()


# ---- 7: toxicity ----
@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.toxicity import detect

    found = detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


# ---- 13: embedding whitening ----
@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.whitening import whiten

    return whiten(_read(spark, sf_dir, "embeddings"))


# ---- 12: HTML extraction ----
@_query
def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.html_text import main_text

    return main_text(_read(spark, sf_dir, "pages"))


# ---- 11: cross-tokenizer alignment ----
@_query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from annoscope.llm.alignment import align

    return align(_read(spark, sf_dir, "documents"))
