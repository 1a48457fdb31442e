"""Substring dedup by fixed-block anchors.

Non-overlapping reference blocks of ``block`` words of every document are indexed; every rolling
window of ``block`` words probes that index. Two occurrences of the same ``window`` words always meet
in a probe, because ``window >= 2 * block - 1`` words hold a whole reference block. Around the hits the
windows of ``window`` words are compared by hash, and runs of adjacent repeated windows form the maximal
exact repeats. A word is removed if a repeat covers it whose window also starts in a document
with a smaller id.

Both steps use the packed exchange (``_exchange``): a block of documents sends its distinct hashes,
so neither a passage shared by a third of all documents nor a large group of copies is ever
gathered in one task, and no pairs of documents are formed.

Defined cases: a null or empty text has no words and keeps the empty text; texts shorter than
``window`` words keep everything; rows with the same id are never removed in favour of each
other; a null id counts as larger than any other. Windows are compared by a 64-bit hash after the
anchor filter (another 64-bit hash, of which 30 bits and the part's bits are sent).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from annoscope.llm import _exchange as ex
from annoscope.llm import _text as tx

WINDOW, BLOCK = 13, 7
_LAST = np.iinfo(np.int64).max
_SENT = f"{ex.PART} int, {ex.CHUNK} int, keys binary, ids binary"
_ANSWER = f"{ex.CHUNK} int, {ex.PART} int, step int, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


class _Block:
    """The words of a block of documents, and the distinct hashes of its probes."""

    def __init__(self, table: pa.Table, lay: ex.Layout, window: int, block: int):
        self.lay, self.window, self.block = lay, window, block
        self.ids = table.column("doc_id").cast(pa.int64())
        ids = self.ids.fill_null(_LAST).to_numpy()
        spans, words, first, base, datas, shift = [], [], [0], 0, [], 0
        for part in tx.slices(table):
            data, offsets = tx.utf8(part.column("text"))
            start, end, f = tx.word_spans(data, offsets)
            words.append(tx.span_hashes(data, start, end))
            spans.append((start + shift, end + shift))
            first.extend((f[1:] + base).tolist())
            base, shift = base + len(start), shift + len(data)
            datas.append(data)
        self.data = np.concatenate(datas) if datas else np.zeros(0, np.uint8)
        self.start = np.concatenate([s for s, _ in spans]) if spans else np.zeros(0, np.int64)
        self.end = np.concatenate([e for _, e in spans]) if spans else np.zeros(0, np.int64)
        self.words = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.first = np.array(first, dtype=np.int64)
        self.doc = tx.doc_of(self.first)
        self.word_id = ids[self.doc] if len(self.doc) else np.zeros(0, np.int64)
        grams, valid = tx.gram_hashes(self.words, self.first, block)
        long_enough = np.repeat(np.diff(self.first) >= window, np.diff(self.first))
        self.probe_at = np.flatnonzero(valid & long_enough)
        keys = grams[self.probe_at] >> np.uint64(34 - lay.part_bits) << np.uint64(34 - lay.part_bits)
        order = np.argsort(keys)
        self.probe_at, self.probe_keys = self.probe_at[order], keys[order]
        self.probe_first = tx.segment_starts(self.probe_keys)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct probe hashes (ascending), is it a reference block here, is it in two documents here."""
        if not len(self.probe_first):
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
        aligned = (self.probe_at - self.first[self.doc[self.probe_at]]) % self.block == 0
        ids = self.word_id[self.probe_at]
        several = np.maximum.reduceat(ids, self.probe_first) != np.minimum.reduceat(ids, self.probe_first)
        return self.probe_keys[self.probe_first], np.logical_or.reduceat(aligned, self.probe_first), several

    def candidates(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows around hits: their positions ordered by hash, hashes, first of each distinct hash."""
        size = np.diff(np.append(self.probe_first, len(self.probe_at)))
        at = np.zeros(len(self.words) + self.window, dtype=np.int64)
        at[self.probe_at[np.repeat(hit, size)]] = 1
        seen = np.concatenate([[0], np.cumsum(at)])
        n = len(self.words)
        near = seen[np.arange(n) + self.window - self.block + 1] - seen[:n] > 0
        keys, valid = tx.gram_hashes(self.words, self.first, self.window)
        where = np.flatnonzero(near & valid)
        keys = keys[where]
        order = np.argsort(keys)
        return where[order], keys[order], tx.segment_starts(keys[order])


def _send_anchors(lay: ex.Layout, window: int, block: int, table: pa.Table) -> pa.Table:
    b = _Block(table, lay, window, block)
    keys, is_block, several = b.anchors()
    packed = ((keys << np.uint64(lay.part_bits) >> np.uint64(34)).astype(np.uint32) << np.uint32(2)
              | is_block.astype(np.uint32) << np.uint32(1) | several.astype(np.uint32))
    bounds = ex.cut(keys, lay)
    return _sent(table, lay, [packed[i:j].tobytes() for i, j in zip(bounds, bounds[1:])], None)


def _sent(table: pa.Table, lay: ex.Layout, keys: list[bytes], ids: list[bytes] | None) -> pa.Table:
    parts = [p for p, k in enumerate(keys) if k]
    chunk = table.column(ex.CHUNK)[0].as_py() if table.num_rows else 0
    return pa.table({ex.PART: pa.array(parts, pa.int32()), ex.CHUNK: pa.array([chunk] * len(parts), pa.int32()),
                     "keys": pa.array([keys[p] for p in parts], pa.binary()),
                     "ids": pa.array([ids[p] if ids else None for p in parts], pa.binary())})


def _answer(step: int, table: pa.Table, sizes: list[int], flags: np.ndarray) -> pa.Table:
    """One packed answer for each sender; senders without a set flag get none."""
    at = np.concatenate([[0], np.cumsum(sizes)])
    rows = [i for i in range(len(sizes)) if flags[at[i]:at[i + 1]].any()]
    chunks, parts = table.column(ex.CHUNK).to_pylist(), table.column(ex.PART).to_pylist()
    return pa.table({ex.CHUNK: pa.array([chunks[i] for i in rows], pa.int32()),
                     ex.PART: pa.array([parts[i] for i in rows], pa.int32()),
                     "step": pa.array([step] * len(rows), pa.int32()),
                     "bits": pa.array([np.packbits(flags[at[i]:at[i + 1]]).tobytes() for i in rows], pa.binary())})


def _match_anchors(table: pa.Table) -> pa.Table:
    """Which sent hashes are a reference block somewhere and stand in two documents."""
    payloads = table.column("keys").to_pylist()
    packed = np.frombuffer(b"".join(payloads), np.uint32)
    order = np.argsort(packed >> np.uint32(2))
    ranked = packed[order]
    first = tx.segment_starts(ranked >> np.uint32(2))
    size = np.diff(np.append(first, len(ranked)))
    some = np.bitwise_or.reduceat(ranked, first) if len(first) else ranked
    good = ((some & np.uint32(2)) > 0) & (((some & np.uint32(1)) > 0) | (size > 1))
    flags = np.zeros(len(packed), dtype=bool)
    flags[order] = np.repeat(good, size)
    return _answer(1, table, [len(p) // 4 for p in payloads], flags)


def _smaller_elsewhere(lay: ex.Layout, table: pa.Table) -> pa.Table:
    """Which sent windows start in a document with a smaller id than the sender's smallest."""
    if table.num_rows and table.column(ex.PART)[0].as_py() >= lay.parts:
        return pa.table({ex.CHUNK: table.column(ex.CHUNK), ex.PART: pa.array([int.from_bytes(p, "little") for p in table.column("ids").to_pylist()], pa.int32()),
                         "step": pa.array([1] * table.num_rows, pa.int32()), "bits": table.column("keys")})
    payloads = table.column("keys").to_pylist()
    keys = np.frombuffer(b"".join(payloads), np.uint64)
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
    order = np.argsort(keys)
    first = tx.segment_starts(keys[order])
    least = np.minimum.reduceat(ids[order], first) if len(first) else ids
    flags = np.zeros(len(keys), dtype=bool)
    flags[order] = np.repeat(least, np.diff(np.append(first, len(keys)))) < ids[order]
    return _answer(2, table, [len(p) // 8 for p in payloads], flags)


def _bits(answer: pa.Table, step: int, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(int(bounds[-1]), dtype=bool)
    rows = zip(*(answer.column(c).to_pylist() for c in ("step", ex.PART, "bits")))
    for s, p, bits in rows:
        if s == step:
            out[bounds[p]:bounds[p + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(bounds[p + 1] - bounds[p]))
    return out


def _send_windows(lay: ex.Layout, window: int, block: int, table: pa.Table, answer: pa.Table) -> pa.Table:
    if not table.num_rows or not answer.num_rows:
        return _sent(table, lay, [], None)
    b = _Block(table, lay, window, block)
    where, keys, first = b.candidates(_bits(answer, 1, ex.cut(b.anchors()[0], lay)))
    if not len(first):
        return _sent(table, lay, [], None)
    keys, least = keys[first], np.minimum.reduceat(b.word_id[where], first)
    bounds = ex.cut(keys, lay)
    cuts = list(zip(bounds, bounds[1:]))
    sent = _sent(table, lay, [keys[i:j].tobytes() for i, j in cuts], [least[i:j].tobytes() for i, j in cuts])
    return pa.concat_tables([sent, _forwarded(table, lay, answer)])


def _forwarded(table: pa.Table, lay: ex.Layout, answer: pa.Table) -> pa.Table:
    """The first answers, sent on to the last step by way of extra parts that only echo them."""
    chunk, n = table.column(ex.CHUNK)[0].as_py(), answer.num_rows
    return pa.table({ex.PART: pa.array([lay.parts + chunk % lay.parts] * n, pa.int32()), ex.CHUNK: pa.array([chunk] * n, pa.int32()),
                     "keys": answer.column("bits").combine_chunks().cast(pa.binary()),
                     "ids": pa.array([p.to_bytes(4, "little") for p in answer.column(ex.PART).to_pylist()], pa.binary())})


def _remove(lay: ex.Layout, window: int, block: int, table: pa.Table, answer: pa.Table) -> pa.Table:
    b = _Block(table, lay, window, block)
    n = len(b.words)
    covered = np.zeros(n, dtype=bool)
    if n and answer.num_rows:
        where, keys, first = b.candidates(_bits(answer, 1, ex.cut(b.anchors()[0], lay)))
        if len(first):
            size = np.diff(np.append(first, len(where)))
            elsewhere = _bits(answer, 2, ex.cut(keys[first], lay))
            least = np.minimum.reduceat(b.word_id[where], first)
            gone = np.repeat(elsewhere, size) | (np.repeat(least, size) < b.word_id[where])
            edge = np.zeros(n + window + 1, dtype=np.int64)
            edge[where[gone]] += 1
            edge[where[gone] + window] -= 1
            covered = np.cumsum(edge)[:n] > 0
    before = np.concatenate([[0], np.cumsum(covered)])
    removed = before[b.first[1:]] - before[b.first[:-1]]
    kept = np.flatnonzero(~covered)
    text = tx.gather(b.data, b.start[kept], b.end[kept], np.searchsorted(kept, b.first))
    return pa.table({"doc_id": b.ids, "n_words": pa.array(np.diff(b.first), pa.int64()),
                     "n_removed": pa.array(removed, pa.int64()), "kept_text": text.cast(pa.string()),
                     "removed": _spans(covered, b)})


def _spans(covered: np.ndarray, b: _Block) -> pa.Array:
    """The removed word ranges of each document, as positions in the document."""
    edge = np.zeros(len(covered) + 1, dtype=bool)
    edge[b.first] = True
    left = np.concatenate([[False], covered[:-1]]) if len(covered) else covered
    right = np.concatenate([covered[1:], [False]]) if len(covered) else covered
    start = np.flatnonzero(covered & (~left | edge[:-1]))
    end = np.flatnonzero(covered & (~right | edge[1:])) + 1
    base = b.first[b.doc[start]] if len(start) else start
    values = pa.StructArray.from_arrays([pa.array(start - base, pa.int64()), pa.array(end - base, pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(start, b.first), pa.int32()), values)


def remove_repeats(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, doc_id: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """One row per document: words, removed words, the kept text (words joined by one space) and the removed
    word ranges, where each range is a maximal run of words covered by repeats."""
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole reference block: window >= 2 * block - 1")
    lay = ex.layout(docs, text)
    dealt = ex.dealt(docs, lay, doc_id, text)
    by_block = dealt.groupBy(ex.CHUNK)
    first = (by_block.applyInArrow(ex.task(_send_anchors, lay, window, block), _SENT)
             .groupBy(ex.PART).applyInArrow(ex.task(_match_anchors), _ANSWER))
    second = (by_block.cogroup(first.groupBy(ex.CHUNK))
              .applyInArrow(ex.task2(_send_windows, lay, window, block), _SENT)
              .groupBy(ex.PART).applyInArrow(ex.task(_smaller_elsewhere, lay), _ANSWER))
    return by_block.cogroup(second.groupBy(ex.CHUNK)).applyInArrow(
        ex.task2(_remove, lay, window, block), RESULT)


__all__ = ["remove_repeats", "WINDOW", "BLOCK"]
