"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

An item of m characters lies in a text with at most k = ``edit_rate`` * m edits only if a band of k + 1 diagonals
holds m + 1 - q * (k + 1) or more common q-grams (q-gram lemma). For every text position whose q-gram is
one of the items', the hits are counted per (text, item, band); bands of 2 * (k + 1) diagonals overlap by half, so
each range of k + 1 diagonals lies whole in one. Regions that reach the lemma's bound are verified by a
banded alignment of the whole item (free ends in the text, unit costs).

Texts and items are compared in lower case, with runs of white space and controls as one space.
Items longer than ``segment`` characters are searched as overlapping segments. Besides, every item longer than ``passage``
characters is searched as windows of that length at half its length apart, the last one flush with the item's end, with
``passage_rate`` edits a character: a text that copies only a part of an item holds one of them if the copied part has
at least 1.5 * ``passage`` characters and few edits. Overlapping windows and segments found are one passage; its edits
are those of its worst window. What lies in a found whole item is not reported again. The items are a stated query set: they are indexed in blocks of bounded size, and
each block scans all documents; documents are never shuffled.

Defined cases: null and empty texts hold no item; null items and items of fewer than ``q`` characters
match nothing; equal items are all reported; rows that repeat an id are scanned each for itself; ids may be
null; where k leaves no q-gram by the lemma, k is lowered until one is left.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from annoscope.llm import _text as tx

Q, EDIT_RATE, SEGMENT = 8, 0.1, 400
PASSAGE, PASSAGE_RATE = 80, 0.025
_GRAMS_A_CHAR = 4  # a character of an item is in up to two segments and two windows
ITEM_BLOCK_CHARS = 4_000_000
_FILTER_BITS = 22
_POSTINGS = 1 << 20  # postings expanded at a time
_BASE = 0x9E3779B97F4A7C15
RESULT = "doc_id long, item_id long, begin long, end long, edits int"


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised code points, where each came from in its text, offsets of the texts)."""
    data, offsets = tx.utf8(pc.utf8_lower(text))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    begins = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(begins)])[offsets]
    gap = (points <= 0x20) | ((points >= 0x7F) & (points <= 0xA0)) | ((points >= 0x2000) & (points <= 0x200B)) | (points == 0x3000)
    keep = np.ones(len(points), dtype=bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[at[:-1][at[:-1] < len(points)]] = True
    points = np.where(gap, np.uint32(0x20), points)[keep]
    moved = np.concatenate([[0], np.cumsum(keep)])[at]
    source = np.flatnonzero(keep) - np.repeat(at[:-1], np.diff(moved))
    return points, source, moved


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q code points from each position (by doubling)."""
    h, width, total, done = points.astype(np.uint64) + np.uint64(1), 1, None, 0
    left = q
    while left:
        if left & 1:
            part = h[done:] if done else h
            if total is None:
                total = part
            else:
                n = min(len(total), len(part))
                total = total[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + part[:n]
            done += width
        left >>= 1
        if left:
            n = max(len(h) - width, 0)
            h = h[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + h[width:]
            width *= 2
    return tx.mix(total[:max(len(points) - q + 1, 0)])


@dataclass
class Index:
    """The q-grams of a block of items: filter table, sorted hashes, and the (piece, offset) of each."""

    q: int
    ids: list
    owner: np.ndarray
    partial: np.ndarray
    points: np.ndarray
    starts: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    seen: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    piece: np.ndarray
    offset: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.starts)


def index(items: Iterable[tuple], q: int = Q, edit_rate: float = EDIT_RATE, segment: int = SEGMENT,
          passage: int = PASSAGE, passage_rate: float = PASSAGE_RATE) -> Index:
    ids, owner, pieces, partial, window_owner, windows = [], [], [], [], [], []
    passage = max(passage, q)
    for item_id, text in items:
        points, _, _ = code_points(pa.array([text or ""], pa.string()))
        points = points[1:] if len(points) and points[0] == 0x20 else points
        points = points[:-1] if len(points) and points[-1] == 0x20 else points
        if len(points) < q:
            continue
        cuts = [0] if len(points) <= segment else [*range(0, len(points) - segment, segment // 2), len(points) - segment]
        for c in cuts:
            pieces.append(points[c:c + segment] if len(points) > segment else points)
            owner.append(len(ids))
            partial.append(len(points) > segment)
        if len(points) > passage:
            cuts = [*range(0, len(points) - passage, passage // 2), len(points) - passage]
            windows += [points[c:c + passage] for c in cuts]
            window_owner += [len(ids)] * len(cuts)
        ids.append(item_id)
    rate = np.repeat([edit_rate, passage_rate], [len(pieces), len(windows)])
    owner, partial, pieces = owner + window_owner, partial + [True] * len(windows), pieces + windows
    length = np.array([len(p) for p in pieces], dtype=np.int64)
    edits = np.minimum((length * rate).astype(np.int64), (length - q) // q)
    starts = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    grams = [_grams(p, q) for p in pieces]
    keys = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    piece = np.repeat(np.arange(len(pieces)), [len(g) for g in grams]) if grams else np.zeros(0, np.int64)
    offset = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    keys, piece, offset = keys[order], piece[order], offset[order]
    first = tx.segment_starts(keys)
    seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
    seen[keys >> np.uint64(64 - _FILTER_BITS)] = True
    return Index(q, ids, np.array(owner, np.int64), np.array(partial, bool), np.concatenate(pieces) if pieces else np.zeros(0, np.uint32), starts, edits,
                 length + 1 - q * (edits + 1), seen, keys[first], np.append(first, len(keys)), piece, offset)


def _regions(ix: Index, points: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, piece, lowest diagonal in the text) of the bands that reach the lemma's bound."""
    none = np.zeros(0, np.int64)
    grams = _grams(points, ix.q)
    at = np.flatnonzero(ix.seen[grams >> np.uint64(64 - _FILTER_BITS)])
    where = np.minimum(np.searchsorted(ix.keys, grams[at]), len(ix.keys) - 1)
    real = ix.keys[where] == grams[at]
    at, where = at[real], where[real]
    text = np.searchsorted(moved, at, "right") - 1
    inside = at + ix.q <= moved[text + 1]
    at, where, text = at[inside], where[inside], text[inside]
    if not len(at):
        return none, none, none
    # Postings are expanded and added up in runs of positions. What lies behind a run cannot grow any more: its bands are
    # judged and forgotten, so a phrase that many items share costs memory for the stretch of one piece only.
    lengths, widths, pieces = ix.lengths, ix.edits + 1, len(ix.edits)
    top = int(np.diff(moved).max()) + int(lengths.max()) + 2
    total = np.concatenate([[0], np.cumsum(ix.first[where + 1] - ix.first[where])])
    key, size, good, i = none, none, [], 0
    while i < len(at):
        j = max(int(np.searchsorted(total, total[i] + _POSTINGS, "right")) - 1, i + 1)
        count = total[i + 1:j + 1] - total[i:j]
        entry = np.repeat(ix.first[where[i:j]] - (total[i:j] - total[i]), count) + np.arange(total[j] - total[i])
        piece = ix.piece[entry]
        # the band is never negative: the diagonal is moved by the piece's length
        band = (np.repeat(at[i:j] - moved[text[i:j]], count) - ix.offset[entry] + lengths[piece]) // widths[piece]
        fresh = np.sort((np.repeat(text[i:j], count) * pieces + piece) * top + band)
        first = tx.segment_starts(fresh)
        key, size = _added(key, size, fresh[first], np.diff(np.append(first, len(fresh))))
        i = j
        pair, band = key // top, key % top
        t, piece = pair // pieces, pair % pieces
        # A doubled band is two neighbouring single ones; its count is kept at the lower one.
        after = np.zeros(len(key), np.int64)
        after[:-1] = np.where(key[1:] == key[:-1] + 1, size[1:], 0)
        done = moved[t] + (band + 2) * widths[piece] <= (at[i] if i < len(at) else np.iinfo(np.int64).max)
        found = done & (size + after >= ix.bound[piece])
        good.append((t[found], piece[found], (band * widths[piece] - lengths[piece])[found]))
        key, size = key[~done], size[~done]
    return tuple(np.concatenate(c) for c in zip(*good))


def _added(key: np.ndarray, size: np.ndarray, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts by ascending key, with those of ``more``."""
    if not len(key):
        return more, counts
    key, size = np.concatenate([key, more]), np.concatenate([size, counts])
    order = np.argsort(key, kind="stable")
    first = tx.segment_starts(key[order])
    return key[order][first], np.add.reduceat(size[order], first)


def _align(ix: Index, points: np.ndarray, begin: np.ndarray, end: np.ndarray, piece: np.ndarray, low: np.ndarray):
    """Least edits of each whole piece in its region's band, with the matched range of the text; -1 edits where
    they exceed the piece's budget."""
    n, edits, length = len(piece), ix.edits[piece], ix.lengths[piece]
    left = low - edits  # the band's diagonals, widened by the edits
    width, longest = int(edits.max()) * 4 + 3, int(length.max())
    unit = np.int32(1 << max(width.bit_length(), 1))  # a cell holds edits * unit + the diagonal it started on
    far = np.int32(1 << 30)
    j = left[:, None] + np.arange(longest + width)
    inside = (j >= 0) & (j < (end - begin)[:, None])
    region = np.where(inside, points[np.clip(j + begin[:, None], 0, max(len(points) - 1, 0))], np.uint32(0xFFFFFFFF))
    item = ix.points[np.minimum(ix.starts[piece][:, None] + np.arange(longest), len(ix.points) - 1)]
    delta = np.arange(width, dtype=np.int32)
    ramp = delta * unit
    blocked = delta > (4 * edits + 2)[:, None]
    cost = np.where(blocked, far, np.broadcast_to(delta, (n, width)))
    live = np.arange(n)
    out = np.full((n, 3), -1, np.int64)
    for i in range(longest):
        step = cost + unit * (region[:, i:i + width] != item[:, i, None])
        np.minimum(step[:, :-1], cost[:, 1:] + unit, out=step[:, :-1])
        cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
        cost[blocked] = far
        over = np.flatnonzero(length[live] == i + 1)
        if len(over):
            to = np.argmin(cost[over], axis=1)
            best, who = cost[over, to].astype(np.int64), live[over]
            out[who] = np.stack([best // unit, left[who] + best % unit, left[who] + i + 1 + to], axis=1)
        if i % 16 == 15:  # a region whose every cell is over budget cannot come back
            keep = (cost.min(axis=1) // unit <= edits[live]) & (length[live] > i + 1)
            if not keep.any():
                break
            if not keep.all():
                live, cost, region, item, blocked = live[keep], cost[keep], region[keep], item[keep], blocked[keep]
    distance = np.where(out[:, 0] <= edits, out[:, 0], -1)
    return distance, np.maximum(out[:, 1], 0), np.minimum(out[:, 2], end - begin)


def _search(ix: Index, table: pa.Table) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, begin, end, edits) of the verified regions of a table's texts; of overlapping regions of a whole
    item in a text, the one with the fewest edits, and overlapping parts of an item as one."""
    if not len(ix.keys):
        return
    base, found = 0, []
    for part in tx.slices(table):
        points, source, moved = code_points(part.column("text").combine_chunks())
        text, piece, low = _regions(ix, points, moved)
        for i in range(0, len(text), 512):
            t, p, lo = text[i:i + 512], piece[i:i + 512], low[i:i + 512]
            edits, begin, end = _align(ix, points, moved[t], moved[t + 1], p, lo)
            good = (edits >= 0) & (end > begin)
            t, p, edits, begin, end = t[good], p[good], edits[good], begin[good], end[good]
            found.extend(zip((t + base).tolist(), ix.owner[p].tolist(), ix.partial[p].tolist(), edits.tolist(), source[moved[t] + begin].tolist(),
                             (source[moved[t] + end - 1] + 1).tolist()))
        base += part.num_rows
    found.sort()
    for (row, item), hits in groupby(found, key=lambda f: f[:2]):
        whole, parts = [], []
        for _, _, partial, edits, begin, end in hits:
            if any(end > b and begin < e for b, e, _ in whole):
                continue
            (parts if partial else whole).append((begin, end, edits))
        passages = []
        for begin, end, edits in sorted(parts):
            if passages and begin < passages[-1][1]:
                first, last, most = passages.pop()
                begin, end, edits = first, max(last, end), max(most, edits)
            passages.append((begin, end, edits))
        for span in whole + passages:
            yield row, item, *span


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple]]:
    """The items, in blocks of bounded size."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    size = int(rows.agg(F.sum(F.length("t"))).first()[0] or 0)
    n = max(1, -(-size * _GRAMS_A_CHAR // block_chars))
    if n == 1:
        yield [(r["i"], r["t"]) for r in rows.collect()]
        return
    for b in range(n):
        yield [(r["i"], r["t"]) for r in rows.where(F.pmod(F.xxhash64("t", "i"), F.lit(n)) == b).collect()]


def _indexes(docs: DataFrame, benchmark: DataFrame, q: int, edit_rate: float, segment: int, item_id: str, item_text: str, block_chars: int):
    for items in _blocks(benchmark, item_id, item_text, block_chars):
        yield docs.sparkSession.sparkContext.broadcast(index(sorted(items, key=str), q, edit_rate, segment))


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, segment: int = SEGMENT,
               doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
               block_chars: int = ITEM_BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, begin, end, edits): where an item stands in a document, in characters of its text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for ix in _indexes(docs, benchmark, q, edit_rate, segment, item_id, item_text, block_chars):
        part = rows.mapInArrow(_leaks(ix), RESULT)
        out = part if out is None else out.unionByName(part)
    return out


def _leaks(ix):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_search(ix.value, pa.Table.from_batches([batch])))
            ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([ix.value.ids[f[1]] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.int64()) for k in (2, 3)),
                 pa.array([f[4] for f in found], pa.int32())], ["doc_id", "item_id", "begin", "end", "edits"])
    return run


def drop_leaked(docs: DataFrame, benchmark: DataFrame, q: int = Q, edit_rate: float = EDIT_RATE, segment: int = SEGMENT,
                text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = ITEM_BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no item is found."""
    out = docs
    for ix in _indexes(docs, benchmark, q, edit_rate, segment, item_id, item_text, block_chars):
        out = out.mapInArrow(_clean(ix, text), docs.schema)
    return out


def _clean(ix, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[[f[0] for f in _search(ix.value, pa.table({"text": batch.column(text)}))]] = False
            yield batch.filter(pa.array(keep))
    return run
