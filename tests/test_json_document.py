"""One-document JSON files against json.load, in many byte ranges."""

import json
import random
import tracemalloc

import pyarrow as pa
import pytest

from annoscope.sources import json_document, readers
from annoscope.sources.json_document import read_json_document


@pytest.fixture()
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.execution.arrow.maxRecordsPerBatch")
    old = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("173", "1", "3")):
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


NASTY = ['a "quoted" }{][, text', "back\\slash\\", '\\"', "línea\nnueva ☃ 😀", "", "}}}", "{", "x" * 700, "\\\\\"}, {"]


def corpora(rnd):
    def tweet(i):
        return {"tweet_id": str(i), "tweet_text": rnd.choice(NASTY), "annotations": [{"annotator": f"a{k}", "annotation": rnd.choice(["care", "non-moral", "harm,care"])} for k in range(rnd.randrange(4))]}
    return [({"Corpus": n, "Tweets": [tweet(i) for i in range(k)]} if n != "B" else {"Tweets": [tweet(i) for i in range(k)], "Note": {"x": [1, {"y": 2}]}, "Corpus": n})
            for n, k in (("A", 40), ("B", 9), ("empty", 0), ("D", 1))]


@pytest.mark.parametrize("indent", [None, 2])
def test_corpora_read_in_many_ranges(spark, tmp_path, small_ranges, indent):
    doc = corpora(random.Random(3))
    path = tmp_path / "mftc.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=indent is None) + "\n")
    assert spark.read.option("lineSep", "}").text(str(path)).rdd.getNumPartitions() > 3
    got = sorted(tuple(r[c] for c in ("corpus", "tweet_id", "tweet_text", "annotator_no", "annotator", "annotation")) for r in readers.read_corpora_json(spark, str(path)).collect())
    assert got == sorted((c["Corpus"], t["tweet_id"], t["tweet_text"], k, a["annotator"], a["annotation"]) for c in doc for t in c["Tweets"] for k, a in enumerate(t["annotations"]))


@pytest.mark.parametrize("indent", [None, 4])
def test_objects_read_in_many_ranges(spark, tmp_path, small_ranges, indent):
    rnd = random.Random(5)
    frames = {f"id {i} \"}}": {"text": rnd.choice(NASTY), "author-label": i % 2, "issue": "tax"} for i in range(60)}
    lexicon = {f"w{i}{rnd.choice(NASTY[:4])}": [f"d{k}" for k in range(rnd.randrange(1, 4))] for i in range(80)}
    for name, value in (("frames", frames), ("lexicon", lexicon)):
        (tmp_path / name).write_text(json.dumps(value, indent=indent))
    got = readers.read_map_json(spark, {"care": str(tmp_path / "frames")}, one_object_per_line=False).collect()
    assert sorted((r["id"], r["text"], r["party"], r["category"]) for r in got) == sorted(
        (k, v["text"], "democratic" if v["author-label"] == 1 else "republican", "care") for k, v in frames.items())
    words = readers.read_lexicon_json(spark, str(tmp_path / "lexicon")).collect()
    assert sorted((r["word"], r["dim"]) for r in words) == sorted((w, d) for w, ds in lexicon.items() for d in ds)


def test_scalars_several_files_empty_values_and_broken_files(spark, tmp_path, small_ranges):
    folder = tmp_path / "many"
    folder.mkdir()
    values = {"a": [1, "two, {", None, [3, [4]], {"k": "}"}], "b": [], "c": ["x" * 500, True], "d": 7}
    for name, value in values.items():
        (folder / name).write_text("  " + json.dumps(value, indent=1) + "\n\n")
    rows = read_json_document(spark, str(folder)).records.collect()
    got = {n: [json.loads(r["value"]) for r in sorted(rows, key=lambda r: r["number"]) if r["file"].endswith("/" + n)] for n in values}
    assert got == {n: v if isinstance(v, list) else [] for n, v in values.items()}
    for k, text in enumerate(('[1, 2', '{"a": "open}', '[1]]')):
        bad = tmp_path / f"bad{k}"
        bad.write_text(text)
        with pytest.raises(ValueError):
            read_json_document(spark, str(bad))


def test_memory_of_a_batch_does_not_grow_with_its_text():
    """A batch of 4 MB of members, cut as a task gets it: its scan takes arrays for a part of the text at a time."""
    values = ["{"] + [f'"{i}": {{"text": "{"word " * 80}", "author-label": 1' for i in range(10_000)] + [""]
    values[1] = values[0] + values[1]
    values = [values[1], *["," + v for v in values[2:-1]], ""]
    n, size = len(values), sum(len(v) + 1 for v in values)
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * n), pa.array([0] * n, pa.int64()), pa.array([size] * n, pa.int64()), pa.array(values)],
                                       ["file", "block", "file_size", "value"])
    for run in (json_document._states, json_document._pieces({("f", 0): (0, 0, 0)}, 1)):
        tracemalloc.start()
        rows = sum(b.num_rows for b in run(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert rows in (1, *range(10_000, 10_200)) and peak < 10 * size, (rows, peak / size)
