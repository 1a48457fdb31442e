import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from annoscope.operators import annotate as A, calibrate as K, lexicon as L, split as SP, text as T
from annoscope.operators.intervals import overlap_join
from annoscope.streaming import rowwise as RW


def test_score_lexicon_lemma_fallback_and_empty_doc(spark):
    texts = spark.createDataFrame([(1, "The cats are here"), (2, "")], "id long, text string")
    lex = spark.createDataFrame([("the", "authority_virtue"), ("be", "care_vice"), ("cats", "care_virtue")], "word string, dim string")
    lemma = spark.createDataFrame([("are", "be")], "token string, lemma string")
    tok = T.with_lemma(T.token_table(texts), lemma, lemma_rows=1)
    r = {x.id: x for x in L.score_lexicon(tok, lex, ids=texts.select("id")).collect()}
    assert r[1].n_tokens == 4 and math.isclose(r[1].authority, 0.25) and math.isclose(r[1].care, 0.5)
    assert r[2].n_tokens == 0 and r[2].care == 0.0
    # the row-wise (streaming-safe) scorer gives the same numbers
    rw = {x.id: x for x in RW.score_lexicon_rowwise(texts, RW.lexicon_map_row(lex, lemma)).collect()}
    assert math.isclose(rw[1].care, 0.5) and rw[2].care == 0.0


def test_parse_dic_multiword_and_codes(spark):
    dic = "%\n1\tcare.virtue\n2\tcare.vice\n%\nkind 1\nhard hearted 2 1\nodd 9\n"
    files = spark.createDataFrame([(dic,)], "value string")
    got = {r.word: r.dims for r in L.parse_dic(files).collect()}
    assert got == {"kind": ["care_virtue"], "hardhearted": ["care_vice", "care_virtue"]}


def test_build_lexicon_aliases_and_grid(spark):
    raw = spark.createDataFrame([("w", " Harm", "vice "), ("w", "purity", "virtue"), ("x", "liberty", "vice")],
                                "word string, category string, sentiment string")
    got = {r.word: r.dims for r in L.build_lexicon(raw).collect()}
    assert got == {"w": ["care_vice", "sanctity_virtue"]}


def test_set_ops_match_venn_regions(spark):
    a = spark.createDataFrame([(w,) for w in "abcdx"], "word string")
    b = spark.createDataFrame([(w,) for w in "cdefx"], "word string")
    c = spark.createDataFrame([(w,) for w in "dfghx"], "word string")
    ops = {k: sorted(r.word for r in v.collect()) for k, v in L.lexicon_set_ops(a, b, c).items()}
    assert ops["all"] == ["d", "x"] and ops["only_a"] == ["a", "b"] and ops["b_c_not_a"] == ["f"]
    regions = {(r.in_a, r.in_b, r.in_c): r.n_words for r in L.lexicon_venn(a, b, c).collect()}
    assert regions[(1, 1, 1)] == len(ops["all"]) and regions[(1, 0, 0)] == len(ops["only_a"])
    assert regions[(1, 1, 0)] == len(ops["a_b_not_c"]) and regions[(0, 0, 1)] == len(ops["only_c"])


def test_venn_regions_sum_to_union(spark):
    a = spark.createDataFrame([(w,) for w in "abcd"], "word string")
    b = spark.createDataFrame([(w,) for w in "cdef"], "word string")
    c = spark.createDataFrame([(w,) for w in "dfgh"], "word string")
    v = L.lexicon_venn(a, b, c).collect()
    assert sum(r.n_words for r in v) == 8
    assert {(r.in_a, r.in_b, r.in_c): r.n_words for r in v}[(1, 1, 1)] == 1


def test_overlap_join_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    left = pd.DataFrame({"k": rng.integers(0, 3, 60), "ls": rng.integers(0, 2000, 60)})
    left["le"] = left["ls"] + rng.integers(0, 300, 60)
    right = pd.DataFrame({"k": rng.integers(0, 3, 40), "rs": rng.integers(0, 2000, 40)})
    right["re"] = right["rs"] + rng.integers(0, 50, 40)
    left["lid"], right["rid"] = range(60), range(40)
    got = overlap_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], ("ls", "le"), ("rs", "re"), bin_size=64)
    got = sorted((r.lid, r.rid) for r in got.collect())
    m = left.merge(right, on="k")
    m = m[(m["le"] > m["ls"]) & (m["re"] > m["rs"]) & (m["ls"] < m["re"]) & (m["rs"] < m["le"])]
    assert got == sorted(zip(m.lid, m.rid))


def test_highlights_absent_null_and_negative_group(spark):
    art = spark.createDataFrame([("d1", None, "One thing. Two things here. Three.")], "document_id string, url string, text string")
    hl = spark.createDataFrame([(1, "d1", "care", "Two things", 3000.0), (1, "d1", "care", "absent text", 3000.0),
                                (2, "d1", "loyalty", None, 3000.0)],
                               "coder_id int, document_id string, assigned_domain string, content string, focus_duration double")
    hits = A.sentence_group_hits(hl, art).collect()
    by = {(r.coder_id, r.sent_no): r.n_hits for r in hits}
    assert by[(1, 1)] == 1 and by[(1, 0)] == 0 and by[(2, 1)] == 0
    counts = {r.sentence.strip(): r for r in A.sentence_counts(spark.createDataFrame(hits)).collect()}
    two = counts["Two things here."]
    assert two.care == 1 and two.care_seen == 1 and two.loyalty_seen == 1 and two.none == 1


def test_unknown_label_raises(spark):
    rows = spark.createDataFrame([("t", "Care,Bogus")], "text string, annotation string")
    m = spark.createDataFrame([("Care", "care")], "raw string, category string")
    for use in (lambda d: d.collect(), lambda d: d.count()):
        try:
            use(A.map_labels(rows, m))
        except Exception as e:  # noqa: BLE001 (Spark's own error class)
            assert "unknown label: Bogus" in str(e)
        else:
            raise AssertionError("unknown label accepted")
    assert [r.category for r in A.map_labels(rows, m, check=False).collect()] == ["care"]


def test_labels_are_checked_without_a_job_before_the_query(spark):
    rows = spark.createDataFrame([("t", "Care,Care"), ("u", None)], "text string, annotation string")
    m = spark.createDataFrame([("Care", "care")], "raw string, category string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("labels", "labels")
    out = A.map_labels(rows, m)
    assert not tracker.getJobIdsForGroup("labels")
    assert [r.category for r in out.collect()] == ["care", "care"]
    spark.sparkContext.setJobGroup("other", "other")


def test_counts_by_difference_equal_the_counts_over_all_pairs(spark):
    import random
    rnd = random.Random(6)
    texts = {str(k): " ".join(f"S{k} w{rnd.randrange(9)} end{j}." for j in range(8)) for k in range(6)}
    art = spark.createDataFrame([(k, None, t) for k, t in texts.items()], "document_id string, url string, text string")
    hl = [(rnd.randrange(3), k, rnd.choice(["care", "loyalty", "sanctity"]), t[a:a + rnd.randrange(1, 40)], 9e3)
          for k, t in texts.items() if k != "5" for a in [rnd.randrange(len(t)) for _ in range(7)]] + [(1, "0", "care", "not in it", 9e3)]
    hl = spark.createDataFrame(hl, "coder_id int, document_id string, assigned_domain string, content string, focus_duration double")
    want = sorted(A.sentence_counts(A.sentence_group_hits(hl, art)).collect())
    got = A.document_sentence_counts(hl, art)
    assert sorted(tuple(r[c] for c in want[0].__fields__) for r in got.collect()) == [tuple(r) for r in want]


def test_density_matches_the_plain_sum_also_outside_the_grid(spark):
    import numpy as np
    from annoscope.operators.profile import kde_grid
    rng = np.random.default_rng(3)
    groups = {"a": rng.random(400), "b": rng.normal(0.5, 0.01, 300), "far": np.r_[rng.normal(5, 0.1, 50), 0.5], None: rng.random(30)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("one", 0.3), ("flat", 0.2), ("flat", 0.2), ("a", None), ("none", None)]
    got = kde_grid(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()
    assert {r["k"] for r in got} == {*groups, "one", "flat"} and len(got) == 101 * 6
    for k, xs in groups.items():
        bw = len(xs) ** -0.2 * xs.std(ddof=1)
        dens = {r["i"]: r["density"] for r in got if r["k"] == k}
        want = [np.exp(-((i / 100 - xs) ** 2) / (2 * bw**2)).sum() / (len(xs) * bw * np.sqrt(2 * np.pi)) for i in range(101)]
        assert np.allclose([dens[i] for i in range(101)], want, atol=3e-9 / bw)
    assert all(r["density"] is None for r in got if r["k"] in ("one", "flat"))


def test_folds_partition_labelled_rows(spark):
    rows = [(i, "care", (1 if i % 4 == 0 else 0) if i % 10 else -1) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, category string, label int")
    out = SP.stratified_kfold(SP.stratified_split(df), k=10).toPandas()
    lab = out[out.label >= 0]
    assert (out[out.label < 0].fold == -1).all() and (out[out.label < 0].train == -1).all()
    assert set(lab.fold) <= set(range(0, 11)) and (lab[lab.train == 0].fold == 0).all()
    for y, part in lab.groupby("label"):
        assert part.train.eq(0).sum() == round(0.1 * len(part))
    again = SP.stratified_kfold(SP.stratified_split(df), k=10).toPandas()
    assert out.sort_values("id").fold.tolist() == again.sort_values("id").fold.tolist()


def test_prior_shift_inverse(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(1, 10)], "p double").withColumn("r", F.lit(3.0))
    r = df.select("p", K.prior_inverse(K.prior_calibrate("p", "r"), "r").alias("back")).collect()
    assert all(abs(x.p - x.back) < 1e-12 for x in r)


def test_platt_fit_is_stationary(spark):
    rng = np.random.default_rng(0)
    s = rng.uniform(0, 1, 200)
    y = (rng.uniform(0, 1, 200) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "y_true": y, "y_score": s}))
    p = K.platt_fit(df, ["g"]).first()
    npos, nneg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (npos + 1) / (npos + 2), 1 / (nneg + 2))
    f = 1 / (1 + np.exp(p.a * s + p.b))
    # gradient of the cross-entropy with smoothed targets w.r.t. (a, b) vanishes at the optimum
    grad_a, grad_b = np.sum((t - f) * s), np.sum(t - f)
    assert abs(grad_a) < 1e-4 and abs(grad_b) < 1e-4


def test_isotonic_is_monotone(spark):
    rng = np.random.default_rng(1)
    s = rng.uniform(0, 1, 100)
    y = (rng.uniform(0, 1, 100) < s).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "y_true": y, "y_score": s}))
    out = K.isotonic_fit_apply(df, ["g"]).toPandas().sort_values("y_score")
    assert (np.diff(out.calibrated.values) >= -1e-12).all()
