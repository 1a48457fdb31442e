"""Distributed pooled violators against a plain pass over each group, over several slices."""

import random

import pytest

from annoscope.operators import isotonic as I
from annoscope.operators.calibrate import isotonic_fit_apply


def plain(points):
    """[(x, total, weight)] -> {x: fitted}."""
    pools = []
    for x, t, w in sorted(points):
        pools.append([[x], t, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            xs, t, w = pools.pop()
            pools[-1] = [pools[-1][0] + xs, pools[-1][1] + t, pools[-1][2] + w]
    return {x: t / w for xs, t, w in pools for x in xs}


def shape(kind, n, rnd):
    """Rising, falling, noisy, and stepped means."""
    for i in range(n):
        w = rnd.randrange(1, 5)
        base = {"up": i / n, "down": 1 - i / n, "noise": rnd.random(), "saw": (i % 17) / 17 * 0.5 + i / n / 2}[kind]
        yield (float(i), float(round(base * w, 3)), float(w))


@pytest.mark.parametrize("slices", [1, 3, 12])
def test_fits_match_a_plain_pass(spark, slices):
    rnd = random.Random(slices)
    groups = {k: list(shape(k, n, rnd)) for k, n in (("up", 60), ("down", 200), ("noise", 300), ("saw", 90))} | {None: [(1.0, 1.0, 2.0)]}
    rows = [(k, *p) for k, ps in groups.items() for p in ps]
    rnd.shuffle(rows)
    got = I.fitted_values(spark.createDataFrame(rows, "g string, x double, t double, w double"), ["g"], "x", "t", "w", "fit", partitions=slices).collect()
    assert len(got) == len(rows)
    for k, ps in groups.items():
        assert {r["x"]: r["fit"] for r in got if r["g"] == k} == pytest.approx(plain(ps))


def test_labels_ties_nulls_clashing_names_and_empty_tables(spark):
    rows = [("a", i % 7 / 7.0, i % 3 % 2, "x", 1) for i in range(50)] + [("a", None, 1, "x", 1), (None, 0.5, 1, "x", 1), (None, 0.5, 0, "x", 1), ("b", 0.1, None, "x", 1)]
    df = spark.createDataFrame(rows, "corpus string, y_score double, y_true int, value string, gid int")
    got = isotonic_fit_apply(df, ["corpus"]).collect()
    assert len(got) == len(rows)
    want = plain([(s, sum(r[2] for r in rows[:50] if r[1] == s), sum(r[1] == s for r in rows[:50])) for s in {r[1] for r in rows[:50]}])
    assert all(r["calibrated"] == pytest.approx(want[r["y_score"]]) for r in got if r["corpus"] == "a" and r["y_score"] is not None)
    assert [r["calibrated"] for r in got if r["corpus"] is None] == [0.5, 0.5]
    assert [r["calibrated"] for r in got if r["y_score"] is None or r["corpus"] == "b"] == [None, None]
    assert isotonic_fit_apply(df.limit(0), ["corpus"]).collect() == []
    whole = isotonic_fit_apply(df.where("corpus = 'a' AND y_score IS NOT NULL"), []).collect()
    assert all(r["calibrated"] == pytest.approx(want[r["y_score"]]) for r in whole) and len(whole) == 50
