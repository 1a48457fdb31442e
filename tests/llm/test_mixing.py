import hashlib
import random
import re

import pytest

from annoscope.llm.mixing import SCHEDULES, curriculum, digest, integral

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def level(sizes, weights, budget=1.5, cap=2.0):
    """Targets by resharing the excess until none is above its cap."""
    left, open_, out = budget * sum(sizes), set(range(len(sizes))), {}
    while open_:
        rate = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if rate * weights[i] > cap * sizes[i]}
        if not over:
            return {**out, **{i: rate * weights[i] for i in open_}}
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
        open_ -= over
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    out = [(i, " \n".join(["w"] * rnd.randrange(0, 60)), "s%d" % min(rnd.randrange(12), 7)) for i in range(500)]
    return out + [(500, None, "s1"), (501, "", "s2"), (502, "a b c", None), (None, "x y", "s3"), (503, "z " * 3000, "é"), (499, "p q", "s1")]


def test_targets_offsets_and_positions(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = [r.asDict() for r in curriculum(docs).collect()]
    sources = sorted({s for _, _, s in rows if s is not None}) + [None]
    sizes = [sum(len(WORD.findall(t or "")) for _, t, s in rows if s == x) for x in sources]
    want = level(sizes, [integral(SCHEDULES[i % 3]) for i in range(len(sources))])
    for i, s in enumerate(sources):
        mine = [r for r in got if r["source"] == s]
        assert mine[0]["target"] == pytest.approx(want[i]) and mine[0]["source_size"] == sizes[i]
        assert abs(sum(r["take"] for r in mine) - want[i]) <= 0.5001
        placed = sorted((r["copy"], r["offset"], r["position"]) for r in mine if r["take"])
        assert [p for _, _, p in placed] == sorted(p for _, _, p in placed)
        order = sorted((hashlib.md5(f"{'' if d is None else d} {hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), d is not None, d or 0, len(WORD.findall(t or "")))
                       for d, t, x in rows if x == s)
        at, offsets = 0, []
        for *_, n in order:
            offsets.append(at)
            at += n
        assert sorted({(r["offset"], r["size"]) for r in mine if r["size"]}) == sorted((o, k[-1]) for o, k in zip(offsets, order) if k[-1])
    positions = [r["position"] for r in got if r["position"] is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    per = [r.asDict() for r in digest(curriculum(docs)).collect()]
    assert len(per) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in per)


def test_density_follows_the_schedule(spark):
    docs = spark.createDataFrame([(i, "w", "a") for i in range(4000)], "doc_id long, text string, source string")
    falling = curriculum(docs, schedules=[((0.0, 4.0), (1.0, 2.0))], budget=1.0).collect()
    early = sum(r["position"] < 0.5 for r in falling)
    assert abs(early / 4000 - 3.5 / 6) < 0.01


def test_empty_clashing_and_bad_schedules(spark):
    assert curriculum(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []
    docs = spark.createDataFrame([(1, "a", "s", 5, 0.5), (2, None, None, 6, 0.1)], "doc_id long, text string, source string, size int, target double")
    assert sorted((r["doc_id"], r["taken"]) for r in digest(curriculum(docs)).collect()) == [(1, 2), (2, 0)]
    with pytest.raises(ValueError):
        curriculum(docs, schedules=[((0.0, 0.0), (1.0, 0.0))])


def test_repeated_rows_without_words_keep_a_row_each(spark):
    rows = [(1, "", "s"), (1, None, "s"), (1, "", "s"), (None, "", "s"), (None, None, "s"), (2, "a b", "s"), (2, "a b", "s"), (1, "", "t"), (3, "c", "t")]
    got = digest(curriculum(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), budget=1.0)).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == sorted((i or 0, len((t or "").split())) for i, t, _ in rows)
