"""Packed hash exchange between blocks of documents.

Corpus-wide questions about word windows ("in how many documents is it?", "does a smaller document
have it?") need every window of the corpus to meet its equals. One shuffled row per window would
be several times the size of the corpus. Here documents are dealt to blocks of a few megabytes, each
block sends its distinct window hashes as packed arrays to hash parts, and a part answers each block
with a packed array in the same order. A hash that is in a third of all documents is sent at most
once by a block, so it never fills a task.

Blocks and parts grow in number with the corpus; their size stays the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from annoscope.llm import _text as tx

BLOCK_BYTES = 4 << 20
PART_ENTRIES = 2_000_000
LEAST_PARTS = 64  # enough parallelism for small corpora; each block sends one row to each part
CHUNK, PART = "_block", "_part"


@dataclass(frozen=True)
class Layout:
    blocks: int
    parts: int
    tasks: int
    rows: int

    @property
    def part_bits(self) -> int:
        return self.parts.bit_length() - 1


def layout(docs: DataFrame, text: str = "text") -> Layout:
    """Numbers of blocks, hash parts (a power of two) and shuffle tasks for these documents."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    size = int(row["b"] or 0)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    blocks = max(2 * tasks, -(-size // BLOCK_BYTES))
    wanted = max(min(tasks, LEAST_PARTS), -(-(size // 5) // PART_ENTRIES))
    parts = 1 << max(0, (wanted - 1).bit_length())
    return Layout(blocks=blocks, parts=parts, tasks=max(tasks, blocks // 8), rows=int(row["n"]))


def dealt(docs: DataFrame, lay: Layout, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, text, block), shuffled once by block; every later step of the query reuses that shuffle. Blocks are
    dealt by the rows' own numbers, so rows with one id, or without, spread like all others. The number holds within one
    query, whose steps read one and the same shuffle."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return (rows.withColumn(CHUNK, F.pmod(F.xxhash64("row"), F.lit(lay.blocks)).cast("int"))
            .repartition(lay.tasks, CHUNK))


def part_of(keys: np.ndarray, lay: Layout) -> np.ndarray:
    """The part of each 64-bit hash: its top bits."""
    bits = lay.part_bits
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def cut(sorted_keys: np.ndarray, lay: Layout) -> np.ndarray:
    """Where each part begins in an ascending array of hashes (length parts + 1)."""
    return np.searchsorted(part_of(sorted_keys, lay), np.arange(lay.parts + 1))


def answers(parts: list[int], payloads: list[bytes], bounds: np.ndarray, dtype) -> np.ndarray:
    """The parts' answers, put together in the order of the block's sorted hashes; a part that did not
    answer gives zeros."""
    out = np.zeros(int(bounds[-1]), dtype=dtype)
    for p, b in zip(parts, payloads, strict=True):
        out[bounds[p]:bounds[p + 1]] = np.frombuffer(b, dtype)
    return out


def task(fn, *given):
    """``fn`` with its first arguments bound, as a plain function of one Arrow table."""
    def run(table):
        out = fn(*given, table)
        tx.release()
        return out
    return run


def task2(fn, *given):
    """As ``task``, for a function of two Arrow tables (a cogroup)."""
    def run(left, right):
        out = fn(*given, left, right)
        tx.release()
        return out
    return run
