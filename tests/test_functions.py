import datetime as dt
import math

import duckdb
from pyspark.sql import functions as F

from annoscope.functions import (
    binarize, interval_overlap, normalize_text, significance_stars, snowflake_date, snowflake_decode,
    snowflake_encode, top_n_mask, u01, url_date,
)
from annoscope.functions.dist import chi2_sf, norm_sf, t_ppf, t_sf
from annoscope.plans import sqlfrag as S


def test_u01_matches_duckdb(spark):
    rows = spark.createDataFrame([("abc",), ("x1",), ("",)], "s string").select("s", u01("s").alias("u")).collect()
    for r in rows:
        d = duckdb.connect().execute(f"SELECT {S.u01(S.q(r.s))}").fetchall()[0][0]
        assert abs(d - r.u) < 1e-15 and 0 <= r.u < 1


def test_normalize_text_rules(spark):
    src = 'He said "hi"  there . . . and… “ok” it’s co­op'
    out = spark.createDataFrame([(src,)], "t string").select(normalize_text("t").alias("n")).first().n
    assert out == "He said 'hi' there ... and... 'ok' it's coop"


def test_snowflake_roundtrip(spark):
    df = spark.createDataFrame([(1704067200123, 3, 17, 4095), (1288834974657, 0, 0, 0)], "ms long, dc long, w long, seq long")
    r = df.select(snowflake_decode(snowflake_encode("ms", "dc", "w", "seq")).alias("d"),
                  snowflake_date(snowflake_encode("ms", "dc", "w", "seq")).alias("day")).collect()
    assert tuple(r[0].d) == (1704067200123, 3, 17, 4095)
    assert r[0].day == dt.date(2024, 1, 1)
    assert tuple(r[1].d) == (1288834974657, 0, 0, 0)


def test_url_date_first_match_and_invalid(spark):
    df = spark.createDataFrame([("http://x/2019/3/7/a/2020/1/1/",), ("http://x/2019/13/40/",), ("http://x/none",)], "u string")
    got = [r.d for r in df.select(url_date("u").alias("d")).collect()]
    assert got == [dt.date(2019, 3, 7), None, None]


def test_interval_overlap_half_open_and_empty(spark):
    df = spark.createDataFrame([(0, 5, 5, 9), (0, 5, 4, 9), (3, 3, 0, 9), (2, 8, 3, 4)], "a int, b int, c int, d int")
    got = [r.o for r in df.select(interval_overlap("a", "b", "c", "d").alias("o")).collect()]
    assert got == [False, True, False, True]


def test_binarize_and_stars(spark):
    df = spark.createDataFrame([(0.5, 0.0009), (0.4, 0.04), (0.6, 0.2)], "s double, p double")
    r = df.select(binarize("s", 0.5).alias("ge"), binarize("s", 0.5, strict=True).alias("gt"),
                  significance_stars("p").alias("st")).collect()
    assert [(x.ge, x.gt, x.st) for x in r] == [(1, 0, "***"), (0, 0, "*"), (1, 1, "-")]


def test_top_n_mask_ties(spark):
    df = spark.createDataFrame([([5.0, 1.0, 3.0, 3.0],)], "a array<double>")
    assert df.select(top_n_mask("a", 2).alias("m")).first().m == [1, 0, 1, 1]


def test_distribution_functions():
    assert abs(t_ppf(0.975, 9) - 2.262157162798239) < 1e-9
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(2 * norm_sf(1.959963984540054) - 0.05) < 1e-12
    assert abs(t_sf(0.0, 5) - 0.5) < 1e-12
    # t with many degrees of freedom approaches the normal
    assert abs(t_sf(1.96, 1e6) - norm_sf(1.96)) < 1e-5
    assert math.isnan(t_sf(float("nan"), 3))
