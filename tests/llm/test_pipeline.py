import random
import re

import pytest

import corpus_pipeline as cp
from annoscope.llm import pii
from tests.llm.test_near_dedup import brute as near_classes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(11)
    path = str(tmp_path_factory.mktemp("pipeline"))
    word = lambda: "".join(rnd.choice(["th", "er", "on", "é", "an", "ing", "st"]) for _ in range(rnd.randrange(1, 4)))
    bench = [(i, " ".join(word() for _ in range(25))) for i in range(6)]
    rows, labels = [], []
    for i in range(260):
        ws = [word() for _ in range(rnd.randrange(20, 90))]
        good = rnd.random() < 0.8
        if good and rnd.random() < 0.15:
            ws += bench[rnd.randrange(6)][1].split()
        if good and rnd.random() < 0.2:
            ws.insert(3, f"mail.{i % 9}@host.example.com")
        if not good:
            ws = [w + "***" for w in ws]
        rows.append((i, " ".join(ws), "en", "s%d" % (i % 5)))
        labels.append((i, int(good), 0))
    for k in range(30):  # near copies with one word changed
        ws = rows[k * 3][1].split()
        ws[5] = "changed"
        rows.append((300 + k, " ".join(ws), "en", "s0"))
    rows += [(400, None, None, None), (401, "", "en", "s1"), (402, "one", "de", None), (None, "no id here at all", "en", "s2"), (403, "w " * 20_000, "en", "s3")]
    rows += [(10, rows[10][1], "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(bench)


def test_each_stage_does_its_work_on_what_is_left(spark, folder):
    path, bench = folder
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "mix"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    key = lambda r: (str(r["doc_id"]), str(r["text"]))
    at = {"start": sorted(docs.collect(), key=key)}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, path)
        if name != "mix":
            assert out.columns == docs.columns and out.schema["text"].dataType == docs.schema["text"].dataType
        docs = spark.createDataFrame(out.collect(), out.schema)
        at[name] = sorted(docs.collect(), key=key)
    good = lambda r: "***" not in (r["text"] or "")
    assert all(good(r) for r in at["quality"]) and sum(good(r) and (r["text"] or "").count(" ") > 15 for r in at["start"]) - len(at["quality"]) <= 5
    with_id = [(r["doc_id"], r["text"]) for r in at["quality"] if r["doc_id"] is not None]
    root = near_classes(sorted(set(with_id), key=str))
    left = [r for r in at["quality"] if r["doc_id"] is None or root[r["doc_id"]] == r["doc_id"]]
    left = [r for i, r in enumerate(left) if not i or r != left[i - 1]]  # of equal rows one stays
    assert at["near_dedup"] == left and len(left) < len(at["quality"])
    assert at["decontaminate"] == [r for r in left if not any(b in (r["text"] or "") for b in bench.values())] and len(at["decontaminate"]) < len(left)
    mail = re.compile(r"mail\.\d@host\.example\.com")
    assert len(at["pii"]) == len(at["decontaminate"]) and not any(mail.search(r["text"] or "") for r in at["pii"])
    for a, b in zip(sorted(at["decontaminate"], key=lambda r: str(r["doc_id"])), sorted(at["pii"], key=lambda r: str(r["doc_id"]))):
        if not mail.search(a["text"] or ""):
            assert a == b
        assert b["n_chars"] == (None if b["text"] is None else len(b["text"]))
    taken = sum(r["mix_take"] for r in at["mix"])
    size = sum(len(WORD.findall(r["text"] or "")) for r in at["pii"])
    assert abs(taken - 1.5 * size) <= 4 and all(0 < r["mix_take"] <= len(WORD.findall(r["text"])) for r in at["mix"])
    assert {(r["doc_id"], r["text"]) for r in at["mix"]} <= {(r["doc_id"], r["text"]) for r in at["pii"]}


def test_run_equals_the_stages_and_orders_by_position(spark, folder):
    path, _ = folder
    out = cp.run(spark, path).collect()
    positions = [r["mix_position"] for r in out]
    assert positions == sorted(positions) and out and cp.ORACLE_SQL is None
    assert not any(re.search(pii.PATTERNS["email"], r["text"]) and "@host." in r["text"] for r in out)


def test_empty_tables(spark, tmp_path):
    empty = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int",
             "benchmark": "item_id long, text string"}
    for name, schema in empty.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
