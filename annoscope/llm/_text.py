"""Vectorised text primitives over Arrow string buffers (used inside ``mapInArrow`` tasks).

Texts stay in their Arrow UTF-8 buffer; words are found with byte tables and hashed with a
polynomial over random byte values, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SLICE_BYTES = 1 << 20
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only

#: The contract's word separators: space and the control characters 0x09-0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n (grown by doubling, kept for the worker's life)."""
    while len(_powers[0]) < n:
        m = len(_powers[0])
        for k, b in enumerate((int(_BASE), int(_BASE_INV))):
            _powers[k] = np.concatenate([_powers[k], _powers[k] * U64(pow(b, m, 1 << 64))])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result can be used."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    h ^= h >> U64(32)
    return h


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers for later tasks, and what an idle
    worker holds counts against the executor."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(table: pa.Table | pa.RecordBatch, text: str = "text", most: int = _SLICE_BYTES) -> Iterator[pa.Table]:
    """The rows in runs of about ``most`` text bytes, so that working arrays stay small. A text is
    never cut: a longer one is a run of its own."""
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    if table.num_rows == 0:
        return
    table = table.combine_chunks()
    _, offsets = utf8(table.column(text))
    at = 0
    while at < table.num_rows:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), table.num_rows)
        yield table.slice(at, to - at)
        at = to
    release()


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte spans of all words, and per text the index of its first word
    (length texts + 1). Words are maximal runs of bytes that are not in ``gap``."""
    inside = ~gap[data] if gap.dtype == bool else gap[data] == 0
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes in every task."""
    if len(start) == 0:
        return np.zeros(0, U64)
    up, down = _power_tables(len(data) + 1)
    total = np.empty(len(data) + 1, dtype=U64)
    total[0] = 0
    np.cumsum(_BYTE_VALUE[data] * up[:len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start])


def doc_of(first: np.ndarray) -> np.ndarray:
    """The text's index of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valid) of the k consecutive words that start at each word; valid is False where they
    would leave the text."""
    n = len(words)
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    valid = room >= k
    h = np.zeros(n, dtype=U64)
    for j in range(min(k, n)):
        h *= _BASE
        h[:n - j] += words[j:]
    return mix(h), valid


def segment_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if len(sorted_keys) == 0:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray, groups: np.ndarray, sep: int = 0x20) -> pa.Array:
    """One string per group: the byte spans ``start..end`` joined by ``sep``. ``groups`` has the index
    of each group's first span (length groups + 1)."""
    size = end - start + 1  # each span brings one separator; the last of a group is cut below
    at = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    out = data[np.minimum(index, max(len(data) - 1, 0))] if len(data) else np.zeros(0, np.uint8)
    out[at[1:] - 1] = sep
    counts = np.diff(groups)
    some = counts > 0
    last = at[groups[1:][some]] - 1  # the final separator of each non-empty group
    keep = np.ones(len(out), dtype=bool)
    keep[last] = False
    out = out[keep]
    lengths = (at[groups[1:]] - at[groups[:-1]]) - some
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(out)))
