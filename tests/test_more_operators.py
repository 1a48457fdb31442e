import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from annoscope.operators import curves as C, profile as P, social as SO, text as T
from annoscope.sources import readers, sinks


def _ts(days):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=days)


def test_window_join_keeps_earlier_and_drops_late(spark):
    posts = spark.createDataFrame([(1, _ts(0), _ts(10))], "id long, created timestamp_ntz, retrieved_on timestamp_ntz")
    comments = spark.createDataFrame([
        ("a", 1, _ts(-1), 5.0, "YTA"), ("b", 1, _ts(0.5), 7.0, "NTA"), ("c", 1, _ts(2), 9.0, "NTA"),
        ("d", 1, _ts(0.2), 7.0, "INFO"), ("e", 2, _ts(0.1), 1.0, "YTA")],
        "id string, parent_id long, created timestamp_ntz, score double, label string")
    wc = SO.window_comments(posts, comments, "INTERVAL 1 DAYS")
    assert sorted(r.id for r in wc.collect()) == ["a", "b"]


def test_top_comment_tie_smallest_id(spark):
    c = spark.createDataFrame([(1, "z", 5.0, "YTA"), (1, "b", 5.0, "NTA"), (1, "a", 1.0, "ESH")],
                              "post_id long, id string, score double, label string")
    r = SO.top_comment(c).first()
    assert (r.verdict_id, r.verdict, r.verdict_score) == ("b", "NTA", 5.0)


def test_single_class_group_has_no_roc(spark):
    df = spark.createDataFrame([("a", 1, 0.2), ("a", 1, 0.4), ("b", 0, 0.1), ("b", 1, 0.3)], "g string, y_true int, y_score double")
    groups = {r.g for r in C.roc_vertices(df, ["g"]).collect()}
    assert groups == {"b"}


def test_sentence_spans_cover_text(spark):
    text = "First one. Second!  Third?\\nNo end"
    df = spark.createDataFrame([(1, text)], "id long, text string")
    rows = sorted(T.sentence_spans(df).collect(), key=lambda r: r.sent_no)
    assert "".join(r.sentence for r in rows) == text
    assert all(text[r.start:r.end] == r.sentence for r in rows)


def test_subword_merge_pieces_before_first_marker(spark):
    pieces = spark.createDataFrame([(1, 0, "<s>", 0.0), (1, 1, "un", 1.0), (1, 2, "Ġhello", 2.0), (1, 3, "wor", 4.0),
                                    (1, 4, "Ġx", 5.0), (1, 5, "</s>", 9.0)], "id long, pos int, token string, score double")
    got = sorted((r.word_no, r.word, r.score) for r in T.subword_merge(pieces).collect())
    assert got == [(0, "un", 1.0), (1, "hellowor", 3.0), (2, "x", 5.0)]


def test_kde_matches_numpy(spark):
    vals = [0.1, 0.2, 0.2, 0.5, 0.9]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    got = P.kde_grid(df, ["g"], "v", n_grid=11).toPandas().sort_values("i")
    x = np.asarray(vals)
    bw = len(x) ** (-0.2) * x.std(ddof=1)
    grid = np.linspace(0, 1, 11)
    exp = np.exp(-((grid[:, None] - x[None, :]) ** 2) / (2 * bw ** 2)).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert np.allclose(got.density.values, exp)


def test_box_stats_and_histogram(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in vals], "g string, v double")
    b = P.box_stats(df, ["g"], "v").first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    assert (b.q1, b.median, b.q3) == (q1, med, q3) and b.whisker_hi == 4.0 and b.n_outliers == 1
    h = P.histogram(spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "v double"), [], "v", 50).collect()
    assert sorted((r.bin, r.n) for r in h) == [(0, 1), (25, 1), (49, 1)]


def test_positive_rate_rollup(spark):
    df = spark.createDataFrame([("care", "en", 1), ("care", "en", -1), ("care", "de", 0), ("care", "de", 1)],
                               "category string, corpus string, label int")
    got = {r.corpus: r.pos_rate for r in P.positive_rate(df, ["category", "corpus"], total_col="corpus").collect()}
    assert got == {"en": 0.5, "de": 0.5, "all": 0.5}


def test_latin1_tsv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "café crème"), (2, "naïve\tsplit")], "id long, t string")
    path = str(tmp_path / "tsv")
    sinks.write_csv(df, path, sep="\t", encoding="ISO-8859-1")
    back = readers.read_tsv(spark, path, "id long, t string", encoding="ISO-8859-1")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "café crème"), (2, "naïve\tsplit")]


def test_lexicon_json_map(spark, tmp_path):
    p = tmp_path / "lex.json"
    p.write_text('{"kind": ["care_virtue"], "cruel": ["care_vice", "care_virtue"]}')
    got = sorted(tuple(r) for r in readers.read_lexicon_json(spark, str(p)).collect())
    assert got == [("cruel", "care_vice"), ("cruel", "care_virtue"), ("kind", "care_virtue")]


def test_concepts_zero_vector_for_unknown_category(spark):
    from annoscope.operators import vectors as V
    seeds = spark.createDataFrame([("care", "kind"), ("care", "warm"), ("loyalty", "zzz")], "category string, word string")
    vecs = spark.createDataFrame([("kind", [3.0, 0.0]), ("warm", [0.0, 4.0])], "token string, vec array<float>")
    got = {(r.category, r.pos): r.value for r in V.concept_vectors(seeds, vecs, dim=2).collect()}
    assert math.isclose(got[("care", 0)], 0.6) and math.isclose(got[("care", 1)], 0.8)
    assert got[("loyalty", 0)] == 0.0 and got[("loyalty", 1)] == 0.0
    assert [r.category for r in V.missing_concepts(seeds, vecs).collect()] == ["loyalty"]


def test_tfidf_smooth_idf_and_l2(spark):
    from annoscope.operators import vectors as V
    docs = {1: ["a", "a", "b"], 2: ["b", "c"], 3: ["a", "c", "c"]}
    terms = spark.createDataFrame([(i, t) for i, ts in docs.items() for t in ts], "id long, term string")
    tf = V.term_counts(terms)
    n = spark.createDataFrame([(3,)], "n long")
    n_fit = spark.createDataFrame([(2,)], "n long")
    got = {(r.id, r.term): r.value for r in V.tfidf_from_counts(tf, n, n_fit, F.col("id") <= 2, min_df=1, max_df=1.0).collect()}
    # fit set = docs 1, 2: df_fit a=1, b=2, c=1 ; idf = ln((1+2)/(1+df)) + 1
    idf = {"a": math.log(3 / 2) + 1, "b": math.log(3 / 3) + 1, "c": math.log(3 / 2) + 1}
    for i, ts in docs.items():
        w = {t: ts.count(t) * idf[t] for t in set(ts)}
        norm = math.sqrt(sum(v * v for v in w.values()))
        for t, v in w.items():
            assert math.isclose(got[(i, t)], v / norm)


def test_document_frequency_reads_the_columns_that_the_counts_have(spark):
    """So that both readers of the counts share one exchange; the numbers stay plain document counts."""
    from annoscope.operators import vectors as V

    tf = V.term_counts(spark.createDataFrame([(i, t) for i in range(6) for t in ("a", "a", "b")[: 1 + i % 3]], "id long, term string"))
    assert {r.term: r.df for r in V.document_frequency(tf, 6, min_df=1, max_df=1.0).collect()} == {"a": 6, "b": 2}
    plan = V.bag_of_words(tf, V.document_frequency(tf, 6, min_df=1, max_df=1.0))._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line.split("Aggregate", 1)[1] for line in plan.splitlines() if "Aggregate [id" in line]
    assert len(aggregates) == 2 and all("count" in a for a in aggregates)


def test_the_venn_regions_read_the_words_once(spark, monkeypatch):
    from annoscope.plans.catalog import lexicon as LC

    from conftest import SF_SMALL

    given = []
    monkeypatch.setattr(LC.L, "lexicon_venn", lambda a, b, c: given.extend((a, b, c)) or a)
    LC.lex_venn(spark, SF_SMALL)
    for df in given:  # a scan and a filter: no tokenising below the filter
        assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
