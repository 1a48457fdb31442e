"""Profile group: corpus statistics, positive rates, histograms, box and density summaries,
URL dates, snowflake ids and in-row top-n marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from annoscope.functions.ids import TWITTER_EPOCH_MS, epoch_millis, snowflake_date, snowflake_decode, snowflake_encode, url_date
from annoscope.functions.predicates import top_n_mask
from annoscope.functions.text import TOKEN_PATTERN
from annoscope.operators import profile as P
from annoscope.plans import fixtures as fx, sqlfrag as S
from annoscope.plans.catalog._util import rounded
from annoscope.plans.catalog.stats import STANCE_SQL, stance_long
from annoscope.plans.registry import register
from annoscope.plans.tables import table


def _doc_tokens(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("id"), F.col("lang").alias("corpus"),
                    F.size(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN_PATTERN), 0)).alias("n_tokens"))


_DOC_TOK_SQL = f"WITH dt AS (SELECT doc_id AS id, lang AS corpus, len(regexp_extract_all(lower(text), '{TOKEN_PATTERN}')) AS n_tokens FROM documents)\n"


@register("corpus_profile", "profile", sql=_DOC_TOK_SQL + """SELECT corpus, count(n_tokens) AS count, round(avg(n_tokens), 6) AS mean,
  round(stddev_samp(n_tokens), 6) AS std, CAST(min(n_tokens) AS DOUBLE) AS min, round(quantile_cont(n_tokens, 0.25), 6) AS q25,
  round(quantile_cont(n_tokens, 0.5), 6) AS q50, round(quantile_cont(n_tokens, 0.75), 6) AS q75, CAST(max(n_tokens) AS DOUBLE) AS max
FROM dt GROUP BY corpus""")
def corpus_profile(spark, sf):
    return rounded(P.describe(_doc_tokens(spark, sf), ["corpus"], "n_tokens"))


@register("corpus_profile_ci", "profile")
def corpus_profile_ci(spark, sf):
    return rounded(P.mean_ci(_doc_tokens(spark, sf), ["corpus"], "n_tokens"))


@register("corpus_pos_rate", "profile", sql=S.with_(S.TRISTATE) + """, j AS (SELECT t.*, d.lang AS corpus FROM tristate t JOIN documents d ON d.doc_id = t.id)
SELECT category, corpus, round(avg(greatest(label, 0)), 6) AS pos_rate FROM j GROUP BY category, corpus
UNION ALL SELECT category, 'all', round(avg(greatest(label, 0)), 6) FROM j GROUP BY category""")
def corpus_pos_rate(spark, sf):
    t = fx.tristate_labels(spark, sf)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("corpus"))
    return rounded(P.positive_rate(t.join(d, "id"), ["category", "corpus"], total_col="corpus"))


@register("histogram", "profile", sql=S.with_(S.SCORED, S.SCORED_LONG) + """, h AS (
  SELECT category, CAST(least(floor(y_score * 50), 49) AS INTEGER) AS bin, count(*) AS n FROM scored_long GROUP BY ALL
) SELECT h.category, bin, n, round(n / t.tot, 6) AS prob FROM h JOIN (SELECT category, count(*) AS tot FROM scored_long GROUP BY category) t USING (category)""")
def histogram(spark, sf):
    return rounded(P.histogram(fx.scored_long(spark, sf), ["category"], "y_score", 50))


@register("box_stats", "profile", sql=STANCE_SQL + """, q AS (
  SELECT target, category, stance, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS median, quantile_cont(score, 0.75) AS q3
  FROM sl GROUP BY ALL
)
SELECT q.target, q.category, q.stance, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  round(min(CASE WHEN score >= q1 - 1.5 * (q3 - q1) THEN score END), 6) AS whisker_lo,
  round(max(CASE WHEN score <= q3 + 1.5 * (q3 - q1) THEN score END), 6) AS whisker_hi,
  count_if(score < q1 - 1.5 * (q3 - q1) OR score > q3 + 1.5 * (q3 - q1)) AS n_outliers, count(*) AS n
FROM sl JOIN q USING (target, category, stance) GROUP BY ALL""")
def box_stats(spark, sf):
    return rounded(P.box_stats(stance_long(spark, sf), ["target", "category", "stance"], "score"))


@register("kde_grid", "profile", sql=S.with_(S.SCORED_FOLDS) + """, st AS (
  SELECT category, y_true, count(y_score) AS n, pow(count(y_score), -0.2) * stddev_samp(y_score) AS bw FROM scored_folds GROUP BY ALL
), c AS (SELECT category, y_true, y_score AS v, count(*) AS cnt FROM scored_folds GROUP BY ALL),
g AS (SELECT UNNEST(range(101)) AS i)
SELECT c.category, c.y_true, CAST(g.i AS INTEGER) AS i, round(0.0::DOUBLE + g.i * 0.01::DOUBLE, 6) AS x,
  round(sum(cnt * exp(-pow(0.0::DOUBLE + g.i * 0.01::DOUBLE - v, 2) / (2 * pow(st.bw, 2)))) / (st.n * st.bw * sqrt(2 * pi())), 6) AS density
FROM c JOIN st USING (category, y_true) CROSS JOIN g GROUP BY c.category, c.y_true, g.i, st.n, st.bw""")
def kde_grid(spark, sf):
    return rounded(P.kde_grid(fx.scored_folds(spark, sf), ["category", "y_true"], "y_score", n_grid=101))


@register("url_date", "profile", sql=S.with_(S.URL_PAGES) + """SELECT page_id,
  CASE WHEN regexp_matches(url, '/(\\d{4})/(\\d{1,2})/(\\d{1,2})/') THEN
    try_cast(make_date(CAST(regexp_extract(url, '/(\\d{4})/(\\d{1,2})/(\\d{1,2})/', 1) AS INTEGER),
                       CAST(regexp_extract(url, '/(\\d{4})/(\\d{1,2})/(\\d{1,2})/', 2) AS INTEGER),
                       CAST(regexp_extract(url, '/(\\d{4})/(\\d{1,2})/(\\d{1,2})/', 3) AS INTEGER)) AS DATE) END AS date
FROM url_pages""")
def url_date_q(spark, sf):
    p = fx.url_pages(spark, sf)
    return p.select("page_id", url_date("url").alias("date"))


@register("url_date_coverage", "profile", sql=S.with_(S.URL_PAGES) + """, d AS (SELECT page_id,
  CASE WHEN regexp_matches(url, '/(\\d{4})/(\\d{1,2})/(\\d{1,2})/') THEN
    make_date(CAST(regexp_extract(url, '/(\\d{4})/(\\d{1,2})/(\\d{1,2})/', 1) AS INTEGER),
              CAST(regexp_extract(url, '/(\\d{4})/(\\d{1,2})/(\\d{1,2})/', 2) AS INTEGER),
              CAST(regexp_extract(url, '/(\\d{4})/(\\d{1,2})/(\\d{1,2})/', 3) AS INTEGER)) END AS date FROM url_pages)
SELECT count(*) AS n_pages, round(avg(CAST(date IS NOT NULL AS INTEGER)), 6) AS share_dated, min(date) AS min_date, max(date) AS max_date FROM d""")
def url_date_coverage(spark, sf):
    d = fx.url_pages(spark, sf).select(url_date("url").alias("date"))
    return rounded(d.agg(F.count(F.lit(1)).alias("n_pages"), F.avg(F.col("date").isNotNull().cast("int")).alias("share_dated"),
                         F.min("date").alias("min_date"), F.max("date").alias("max_date")))


def _sf_inputs(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id")
    return e.select("event_id", epoch_millis("ts").alias("ts_ms"), F.pmod("user_id", F.lit(32)).alias("dc"),
                    F.pmod("event_id", F.lit(32)).alias("worker"), F.pmod("event_id", F.lit(4096)).alias("seq"))


_SF_SQL = f"""WITH e AS (SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms, user_id % 32 AS dc, event_id % 32 AS worker, event_id % 4096 AS seq FROM events),
enc AS (SELECT *, ((ts_ms - {TWITTER_EPOCH_MS}) << 22) | (dc << 17) | (worker << 12) | seq AS sid FROM e)
"""


@register("snowflake_encode", "profile", sql=_SF_SQL + "SELECT event_id, sid FROM enc")
def snowflake_encode_q(spark, sf):
    x = _sf_inputs(spark, sf)
    return x.select("event_id", snowflake_encode("ts_ms", "dc", "worker", "seq").alias("sid"))


@register("snowflake_decode", "profile", sql=_SF_SQL + f"""SELECT event_id, (sid >> 22) + {TWITTER_EPOCH_MS} AS ts_ms, (sid >> 17) & 31 AS datacenter,
  (sid >> 12) & 31 AS worker, sid & 4095 AS sequence,
  CAST(DATE '1970-01-01' + CAST(floor(((sid >> 22) + {TWITTER_EPOCH_MS}) / 86400000) AS INTEGER) AS DATE) AS date,
  CAST(((sid >> 22) + {TWITTER_EPOCH_MS}) = ts_ms AND ((sid >> 17) & 31) = dc AND ((sid >> 12) & 31) = worker AND (sid & 4095) = seq AS INTEGER) AS roundtrip_ok
FROM enc""")
def snowflake_decode_q(spark, sf):
    x = _sf_inputs(spark, sf)
    enc = x.withColumn("sid", snowflake_encode("ts_ms", "dc", "worker", "seq"))
    d = enc.select("*", snowflake_decode("sid").alias("d"), snowflake_date("sid").alias("date"))
    ok = ((F.col("d.ts_ms") == F.col("ts_ms")) & (F.col("d.datacenter") == F.col("dc")) & (F.col("d.worker") == F.col("worker"))
          & (F.col("d.sequence") == F.col("seq"))).cast("int")
    return d.select("event_id", F.col("d.ts_ms").alias("ts_ms"), F.col("d.datacenter").alias("datacenter"),
                    F.col("d.worker").alias("worker"), F.col("d.sequence").alias("sequence"), "date", ok.alias("roundtrip_ok"))


@register("topn_in_array", "profile", sql="""WITH m AS (SELECT vec_id, list_transform(embedding,
    lambda v: CAST(v >= list_sort(embedding, 'DESC')[least(len(embedding), 10)] AS INTEGER)) AS mask FROM embeddings)
SELECT vec_id, CAST(list_sum(mask) AS INTEGER) AS n_marked, array_to_string(mask, '') AS mask FROM m""")
def topn_in_array(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", top_n_mask("embedding", 10).alias("m"))
    return e.select("vec_id", F.aggregate("m", F.lit(0), lambda a, b: a + b).alias("n_marked"),
                    F.array_join(F.transform("m", lambda x: x.cast("string")), "").alias("mask"))
