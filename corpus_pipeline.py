"""The corpus pipeline: five stages from raw documents to a training order.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read back as the next one's docs. All but the last return the columns of ``docs``, less the rows they reject:

1. quality: documents that the classifier rejects go.
2. near_dedup: one row of each near-duplicate class stays, that with the smallest id. Rows are compared, not ids: no row goes
   because another one carries its id, and copies without an id go like all others.
3. decontaminate: documents that hold a benchmark item go.
4. pii: personal data and secrets become surrogates; no row goes.
5. mix: the documents in training order, range-sorted by position, with ``mix_copy``, ``mix_take`` (words to train on
   from this copy) and ``mix_position``; a document may come twice, be cut or be left out. Columns of these names
   that the documents already have are replaced.

The run cannot be expressed in SQL (a fitted classifier, sampled signatures), so ``ORACLE_SQL`` is None and
the stages are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from annoscope.llm import decontaminate, mixing, near_dedup, pii, quality
from annoscope.session import written as saved

PII_KEY = "annoscope-demo-key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaked(docs, _table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(docs, PII_KEY)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    names = {"copy": "mix_copy", "take": "mix_take", "position": "mix_position"}
    docs = docs.drop(*names.values())
    placed = mixing.curriculum(docs, keep=docs.columns).where("take > 0")
    return placed.select("kept.*", *[F.col(a).alias(b) for a, b in names.items()])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("pii", replace_personal_data),
    ("mix", mix_sources),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; each stage's result is written to the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
