"""Document fingerprints from closed syncmers.

A k-mer of characters is an anchor if its smallest s-mer (by hash) is its first or its last one. That depends
on the k-mer alone, so an anchor survives any edit outside it. The fingerprint keeps the ``size`` anchors with the
smallest hashes, each with its position: a bottom-k sketch of the anchors that can be matched by position.
The likeness of two fingerprints estimates the share of anchors in common (Dice): of the smallest anchors of both
together, those in both count if they can be put in the same order in both texts (longest increasing run of positions).

Fingerprint: base64 of big-endian 8-byte numbers in ascending order, 40 bits of hash and 24 of position.

Defined cases: a null or empty text has the empty fingerprint, which is like itself (1) and unlike all others (0);
a text of fewer than k characters has one anchor, its whole; texts are read whole; equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from annoscope.llm import _text as tx

K, S, SIZE = 16, 6, 64
_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POSITION = (1 << 24) - 1


def _rolled(points: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` code points from each position (positions too near the end give garbage)."""
    parts, h, size = [], points, 1
    while True:
        if width & size:
            parts.append((size, h))
        if size * 2 > width:
            break
        h = h * np.uint64(pow(_BASE, size, 1 << 64)) + np.concatenate([h[size:], h[:size]])
        size *= 2
    total, done = None, 0
    for size, h in parts:
        moved = np.concatenate([h[done:], h[:done]]) if done else h
        total = moved if total is None else total * np.uint64(pow(_BASE, size, 1 << 64)) + moved
        done += size
    return tx.mix(total)


def _window_least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each position on."""
    size = 1
    while size * 2 <= width:
        h = np.minimum(h, np.concatenate([h[size:], h[:size]]))
        size *= 2
    rest = width - size
    return np.minimum(h, np.concatenate([h[rest:], h[:rest]])) if rest else h


def anchors(points: np.ndarray, moved: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, 40-bit hash) of all anchors of texts that lie end to end in ``points``."""
    text = np.repeat(np.arange(len(moved) - 1), np.diff(moved))
    place = np.arange(len(points)) - moved[text]
    inner = _rolled(points, s)
    least = _window_least(inner, k - s + 1)
    last = np.concatenate([inner[k - s:], inner[:k - s]])
    length = np.diff(moved)
    chosen = ((least == inner) | (least == last)) & (place + k <= length[text])
    at = np.flatnonzero(chosen)
    names = _rolled(points, k)[at]
    short = np.flatnonzero((length > 0) & (length < k))
    whole = [tx.mix(np.array([sum(int(p) * pow(_BASE, i, 1 << 64) for i, p in enumerate(points[moved[t]:moved[t + 1]], 1)) % (1 << 64)],
                             dtype=np.uint64))[0] for t in short]
    text, place = np.concatenate([text[at], short]), np.concatenate([place[at], np.zeros(len(short), np.int64)])
    return text, place, np.concatenate([names, np.array(whole, dtype=np.uint64)]) >> np.uint64(24)


def _smallest(text: np.ndarray, place: np.ndarray, name: np.ndarray, texts: int, size: int) -> list[np.ndarray]:
    """Per text its ``size`` smallest distinct anchors, as numbers hash << 24 | position of the first."""
    key = text.astype(np.uint64) << np.uint64(40) | name
    order = np.argsort(key, kind="stable")
    order = order[tx.segment_starts(key[order])]
    owner = text[order]
    first = np.searchsorted(owner, np.arange(texts + 1))
    rank = np.arange(len(order)) - first[owner]
    keep = order[rank < size]
    value = name[keep] << np.uint64(24) | np.minimum(place[keep], _POSITION).astype(np.uint64)
    return np.split(value, np.searchsorted(text[keep], np.arange(1, texts)))


def fingerprints(texts: list[str], k: int = K, s: int = S, size: int = SIZE) -> list[np.ndarray]:
    """The fingerprint of each text as an ascending array of numbers."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, total = at, 0
        while to < len(texts) and (to == at or total + len(texts[to]) <= _SLICE):
            total += len(texts[to])
            to += 1
        run = texts[at:to]
        points = np.frombuffer("".join(run).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        moved = np.concatenate([[0], np.cumsum([len(t) for t in run])]).astype(np.int64)
        if total:
            text, place, name = anchors(points, moved, k, s)
            count = np.bincount(text, minlength=len(run))
            # Hashes are uniform, so a text's smallest are below this level; where they are not, all of it is sorted.
            level = np.minimum(2.0**40, 2.0**40 * (2 * size + 32) / np.maximum(count, 1))
            low = name < level[text]
            found = _smallest(text[low], place[low], name[low], len(run), size)
            again = [i for i in range(len(run)) if len(found[i]) < size and not (low[text == i]).all()] if len(run) < 64 else \
                np.flatnonzero((np.array([len(f) for f in found]) < size) & (np.bincount(text, ~low, len(run)) > 0)).tolist()
            for i in again:
                mine = text == i
                found[i] = _smallest(np.zeros(int(mine.sum()), np.int64), place[mine], name[mine], 1, size)[0]
            out.extend(found)
        else:
            out.extend(np.zeros(0, np.uint64) for _ in run)
        at = to
    return out


def encoded(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype(">u8").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """0 to 1: the estimated share of anchors that two texts have in common, in the same order."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    shift = np.uint64(24)
    na, nb = a >> shift, b >> shift
    union = np.union1d(na, nb)[:size]
    both, ia, ib = np.intersect1d(na, nb, assume_unique=True, return_indices=True)
    small = both <= union[-1]
    pa_, pb_ = (a[ia[small]] & np.uint64(_POSITION)).tolist(), (b[ib[small]] & np.uint64(_POSITION)).tolist()
    run: list[int] = []
    for _, p in sorted(zip(pa_, pb_)):
        i = bisect_left(run, p)
        run[i:i + 1] = [p]
    j = len(run) / len(union)
    return 2 * j / (1 + j)


# ---- each document, its edited text and the next document ----
def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of characters replaced by the first as many of ``following``."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n] if n else text


_RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
           "near_next double")


def _compare(k: int, s: int, size: int):
    def pairs(rows: list[tuple], prints: list[np.ndarray]) -> pa.RecordBatch:
        """Rows (id, group, mark, text); each but the last is compared to the one after it, if of the same group."""
        use = [i for i in range(len(rows) - 1) if rows[i][1] == rows[i + 1][1] and not rows[i][2]]
        new = [edited(rows[i][3], rows[i + 1][3]) for i in use]
        other = fingerprints(new, k, s, size)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][0] for i in use], pa.int64()), pa.array([len(rows[i][3]) for i in use], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in new], pa.string()),
            pa.array([encoded(prints[i]) for i in use], pa.string()), pa.array([encoded(p) for p in other], pa.string()),
            pa.array([likeness(prints[i], p, size) for i, p in zip(use, other)], pa.float64()),
            pa.array([likeness(prints[i], prints[i + 1], size) for i in use], pa.float64()),
        ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        prints: list[np.ndarray] = []
        for batch in batches:
            for part in tx.slices(batch, most=4 << 20):
                new = list(zip(*(part.column(c).to_pylist() for c in ("doc_id", "group", "mark", "text"))))
                new = [(i, g, m, t or "") for i, g, m, t in new]
                rows, prints = rows[-1:] + new, prints[-1:] + fingerprints([r[3] for r in new], k, s, size)
                yield pairs(rows, prints)
    return run


def _group(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most ``key`` (binary search)."""
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        right = (acc["lo"] < acc["hi"]) & (F.element_at(array, F.least(middle + 1, F.lit(len(bounds)))) <= key)
        return F.struct(F.when(right, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(F.least(middle, acc["hi"])).alias("hi"))

    return F.aggregate(steps, state, step)["lo"] if bounds else F.lit(0)


def compared(docs: DataFrame, k: int = K, s: int = S, size: int = SIZE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_chars, fingerprint, the SHA-256 and fingerprint of its edited text (its last quarter replaced by
    the beginning of the next document by ascending id, after the last the first), and the likeness of its
    fingerprint to the edited text's and to the next document's. Null ids come first; rows that repeat an id follow
    each other by text.

    Texts are dealt once, by ranges of ids, and sorted in their task; each range also gets a marked copy
    of the first document of the next one."""
    spark = docs.sparkSession
    first = -(1 << 63)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                       F.coalesce(F.col(doc_id).cast("long"), F.lit(first)).alias("key"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    ranges = 4 * tasks
    cuts = rows.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    rows = rows.withColumn("group", _group(F.col("key"), sorted(set(cuts))))
    heads = sorted((r["group"], r["key"]) for r in rows.groupBy("group").agg(F.min("key").alias("key")).collect())  # a row for each range
    wanted = spark.createDataFrame([(h[1], heads[i - 1][0]) for i, h in enumerate(heads)], "key long, _to int")
    marked = (rows.join(F.broadcast(wanted), "key").groupBy("_to").agg(F.min("text").alias("text"))
              .select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit((1 << 63) - 1).alias("key"), F.col("_to").alias("group"), F.lit(True).alias("mark")))
    every = rows.select("doc_id", "text", "key", "group", F.lit(False).alias("mark")).unionByName(marked)
    dealt = every.repartition(tasks, "group").sortWithinPartitions("group", "mark", "key", "text")
    return dealt.select("doc_id", "group", "mark", "text").mapInArrow(_compare(k, s, size), _RESULT)
