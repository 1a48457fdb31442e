"""Near-duplicate classes: improved consistent weighted sampling (ICWS) over TF-IDF word shingles.

1. Documents are dealt to blocks (``_exchange``); the parts count in how many documents each shingle is, over the whole
   corpus. A shingle weighs tf * idf with idf = 1 + s * ln((N + 1) / (df + 1)) / ln(N + 1).
   The strength s is small (0.25): a full idf would make the text that a large group of copies shares
   worthless against each copy's own edits, and so tear up just the largest groups.
2. ICWS draws ``bands * rows`` consistent samples from each weighted shingle set (two sets draw the same
   sample with a probability of their weighted Jaccard similarity). The draw's random numbers come
   from fixed tables indexed by bits of the shingle's hash.
   Only documents whose weight lies to at least ``similarity`` in shingles of two or more documents are signed:
   others cannot be similar to any.
3. Equal texts are collapsed. In each band, documents with the same key meet the leader of the bucket, not each
   other. Pairs are verified by the exact weighted Jaccard similarity of the two shingle sets. The
   few members that are not similar to their leader then meet those members to which they can still
   be similar by the triangle inequality, so no bucket is capped and no link that joins two classes is lost.
4. Classes are the connected components of the links, by alternating large-star and small-star rounds.

Words are runs of letters, digits and bytes above ASCII, lower-cased. Rows are compared, not ids: each has a number of its own, so rows
without an id and rows that repeat one with another text are documents like all others. Defined cases: a null text, or
one without words, is a class of its own; a text of fewer than ``shingle`` words is one shingle. ``near_duplicates``
answers by id: an id has the smallest class of its rows, a class the smallest of its ids (null if none of its rows has
one). ``keep_one`` keeps one row of each class, that with the smallest id (rows without one last, then by the text's
digest), and of rows equal in id and text any one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from annoscope.llm import _exchange as ex
from annoscope.llm import _text as tx
from annoscope.session import written as saved

SHINGLE, SIMILARITY, BANDS, ROWS, IDF_STRENGTH = 5, 0.8, 14, 4, 0.25
_TABLE_BITS = 14
_MEMBERS = 64  # documents of a leader that are verified in one group
_FAR_BLOCK, _NEAR_BLOCK = 64, 256  # members of a bucket that meet in one task

#: Bytes that do not belong to a word: everything in ASCII but letters and digits.
GAP = np.ones(256, dtype=bool)
GAP[[*b"0123456789", *b"abcdefghijklmnopqrstuvwxyz", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)]] = False

_SENT = f"{ex.PART} int, {ex.CHUNK} int, keys binary, counts binary"
_ANSWER = f"{ex.CHUNK} int, {ex.PART} int, at binary, counts binary"
_SIGNED = "doc_id long, leader long, id long, digest string, text_key binary, keys array<long>, vector binary"


def shingle_counts(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count), ordered by document and hash, of a table's texts."""
    docs, keys, base = [], [], 0
    for part in tx.slices(table):
        text = pc.utf8_lower(part.column("text"))
        data, offsets = tx.utf8(text)
        start, end, first = tx.word_spans(data, offsets, GAP)
        words = tx.span_hashes(data, start, end)
        grams, valid = tx.gram_hashes(words, first, k)
        n = np.diff(first)
        short = np.flatnonzero((n > 0) & (n < k))
        at = np.flatnonzero(valid)
        whole = [_whole(words[first[i]:first[i + 1]]) for i in short]
        docs.append(np.concatenate([tx.doc_of(first)[at], short]) + base)
        keys.append(np.concatenate([grams[at], np.array(whole, dtype=np.uint64)]))
        base += len(n)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    doc, key = doc[order], key[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    return doc[first], key[first], np.diff(np.append(first, len(doc)))


def _whole(words: np.ndarray) -> np.uint64:
    h, _ = tx.gram_hashes(words, np.array([0, len(words)]), len(words))
    return h[0]


# ---- document frequencies ----
def _send_shingles(lay: ex.Layout, k: int, table: pa.Table) -> pa.Table:
    _, key, _ = shingle_counts(table, k)
    keys, counts = np.unique(key, return_counts=True)
    bounds = ex.cut(keys, lay)
    packed = (keys << np.uint64(lay.part_bits) >> np.uint64(32)).astype(np.uint32)
    counts = np.minimum(counts, np.iinfo(np.uint32).max).astype(np.uint32)
    parts = [p for p in range(lay.parts) if bounds[p] < bounds[p + 1]]
    chunk = table.column(ex.CHUNK)[0].as_py() if table.num_rows else 0
    several = [np.flatnonzero(counts[bounds[p]:bounds[p + 1]] > 1).astype(np.uint32) for p in parts]
    return pa.table({ex.PART: pa.array(parts, pa.int32()), ex.CHUNK: pa.array([chunk] * len(parts), pa.int32()),
                     "keys": pa.array([packed[bounds[p]:bounds[p + 1]].tobytes() for p in parts], pa.binary()),
                     "counts": pa.array([np.concatenate([s, counts[bounds[p]:bounds[p + 1]][s]]).tobytes()
                                         for p, s in zip(parts, several)], pa.binary())})


def _count(table: pa.Table) -> pa.Table:
    """For each sender, which of its shingles are in more documents than it knows, and in how many."""
    keys = [np.frombuffer(b, np.uint32) for b in table.column("keys").to_pylist()]
    counts = np.ones(sum(map(len, keys)), np.uint32)
    at = 0
    for k, b in zip(keys, table.column("counts").to_pylist()):
        c = np.frombuffer(b, np.uint32)
        counts[at + c[:len(c) // 2].astype(np.int64)] = c[len(c) // 2:]
        at += len(k)
    ranked = np.concatenate(keys).astype(np.uint64) << np.uint64(32) | np.arange(len(counts), dtype=np.uint64)
    ranked.sort()
    first = tx.segment_starts(ranked >> np.uint64(32))
    order = (ranked & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    total = np.empty(len(counts), np.int64)
    total[order] = np.repeat(np.add.reduceat(counts[order].astype(np.int64), first), np.diff(np.append(first, len(order))))
    at, rows = 0, []
    chunks, parts = table.column(ex.CHUNK).to_pylist(), table.column(ex.PART).to_pylist()
    for i, k in enumerate(keys):
        t = total[at:at + len(k)]
        more = np.flatnonzero(t > 1)
        at += len(k)
        if len(more):
            rows.append((chunks[i], parts[i], more.astype(np.uint32).tobytes(), np.minimum(t[more], 2**32 - 1).astype(np.uint32).tobytes()))
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table({ex.CHUNK: pa.array(cols[0], pa.int32()), ex.PART: pa.array(cols[1], pa.int32()),
                     "at": pa.array(cols[2], pa.binary()), "counts": pa.array(cols[3], pa.binary())})


# ---- signatures ----
def _draws(samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per sample: multiplier, and tables of 1/r, r and ln c for r, c ~ Gamma(2, 1), beta ~ U(0, 1) as (r, ln c, beta)."""
    rng = np.random.default_rng(4242)
    mult = rng.integers(1, 2**63, samples, dtype=np.int64).astype(np.uint64) | np.uint64(1)
    size = (samples, 1 << _TABLE_BITS)
    return mult, rng.gamma(2.0, 1.0, size).astype(np.float32), np.log(rng.gamma(2.0, 1.0, size)).astype(np.float32), rng.random(size, np.float32)


_tables: dict[int, tuple] = {}


def signatures(key: np.ndarray, weight: np.ndarray, first: np.ndarray, samples: int) -> np.ndarray:
    """ICWS samples (documents x samples, 32-bit identities of the drawn (shingle, t)) of weighted sets.

    For each element: t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1); the least ln a is drawn."""
    if samples not in _tables:
        _tables.clear()
        _tables[samples] = _draws(samples)
    mult, r_t, c_t, b_t = _tables[samples]
    out = np.empty((len(first), samples), dtype=np.uint32)
    log_w = np.log(weight).astype(np.float32)
    low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    shift = np.uint64(64 - _TABLE_BITS)
    for s in range(samples):
        at = (key * mult[s]) >> shift
        r, beta = r_t[s][at], b_t[s][at]
        t = np.floor(log_w / r + beta)
        log_a = c_t[s][at] - r * (t - beta + np.float32(1))
        bits = log_a.view(np.uint32)
        rank = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        name = low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
        out[:, s] = np.minimum.reduceat(rank << np.uint64(32) | name, first) & np.uint64(0xFFFFFFFF)
    return out


def _sign(lay: ex.Layout, k: int, similarity: float, bands: int, rows: int, strength: float, table: pa.Table, answer: pa.Table) -> pa.Table:
    doc, key, tf = shingle_counts(table, k)
    keys, inverse = np.unique(key, return_inverse=True)
    bounds, df = ex.cut(keys, lay), np.ones(len(keys), np.int64)
    for p, at, n in zip(*(answer.column(c).to_pylist() for c in (ex.PART, "at", "counts"))):
        df[bounds[p] + np.frombuffer(at, np.uint32)] = np.frombuffer(n, np.uint32)
    top = np.log(lay.rows + 1.0) or 1.0
    weight = (tf * (1 + strength * (top - np.log(df + 1.0)) / top)[inverse]).astype(np.float32)
    first = tx.segment_starts(doc)
    end = np.append(first, len(doc))
    # A document that is similar to another shares at least that part of its weight with another one.
    if len(first):
        shared = np.add.reduceat(np.where(df[inverse] > 1, weight, np.float32(0)), first)
        some = np.flatnonzero(shared >= (similarity - 1e-4) * np.add.reduceat(weight, first))
    else:
        some = first
    # From here on documents go by the number of their row.
    id_of = table.column("row").to_numpy()[doc[first[some]]] if len(some) else np.zeros(0, np.int64)
    # Equal sets are told by two sums over their hashes and counts; the smallest number here stands for them.
    text_key = np.zeros((len(some), 2), np.uint64)
    if len(some):
        text_key[:, 0] = np.add.reduceat(tx.mix(key + tf.astype(np.uint64)), first)[some]
        text_key[:, 1] = np.bitwise_xor.reduceat(tx.mix((key ^ np.uint64(0x5DEECE66D)) * tf.astype(np.uint64)), first)[some]
    order = np.lexsort((id_of, text_key[:, 1], text_key[:, 0]))
    some, id_of, text_key = some[order], id_of[order], text_key[order]
    new = np.ones(len(some), dtype=bool)
    new[1:] = (text_key[1:] != text_key[:-1]).any(axis=1)
    leader = id_of[new][np.cumsum(new) - 1] if len(some) else id_of
    sole = some[new]
    pick = np.concatenate([np.arange(end[i], end[i + 1]) for i in sole]) if len(sole) else np.zeros(0, np.int64)
    size = end[sole + 1] - end[sole] if len(sole) else np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(sole) else np.zeros(0, np.int64)
    drawn = signatures(key[pick], weight[pick], starts, bands * rows) if len(sole) else np.zeros((0, bands * rows), np.uint32)
    band = np.zeros((len(sole), bands), np.uint64)
    for j in range(rows):
        band = band * np.uint64(0x9E3779B97F4A7C15) + drawn[:, j::rows].astype(np.uint64)
    band = tx.mix(band).view(np.int64)
    vectors = [_packed(key[end[i]:end[i + 1]], weight[end[i]:end[i + 1]]) for i in sole]
    at = np.cumsum(new) - 1

    def of_leader(values: list, kind: pa.DataType) -> pa.Array:
        return pa.array([values[at[i]] if new[i] else None for i in range(len(some))], kind)

    rows = table.select(["doc_id", "text"]).take(pa.array(doc[first[some]] if len(some) else some, pa.int64()))
    digest = [hashlib.md5(t.encode()).hexdigest() for t in rows.column("text").to_pylist()]
    return pa.table({"doc_id": pa.array(id_of, pa.int64()), "leader": pa.array(leader, pa.int64()),
                     "id": rows.column("doc_id").cast(pa.int64()), "digest": pa.array(digest, pa.string()),
                     "text_key": of_leader([x.tobytes() for x in text_key[new]], pa.binary()),
                     "keys": of_leader(list(band), pa.list_(pa.int64())),
                     "vector": of_leader(vectors, pa.binary())})


def _packed(key: np.ndarray, weight: np.ndarray) -> bytes:
    """A weighted set for verification: 32-bit shingle names in ascending order, then their weights."""
    name = (key >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(name, kind="stable")
    return name[order].tobytes() + weight[order].tobytes()


def weighted_jaccard(a: bytes, b: bytes) -> float:
    """Sum of the smaller weights over the sum of the larger ones."""
    n, m = len(a) // 8, len(b) // 8
    ka, wa = np.frombuffer(a, np.uint32, n), np.frombuffer(a, np.float32, n, n * 4)
    kb, wb = np.frombuffer(b, np.uint32, m), np.frombuffer(b, np.float32, m, m * 4)
    at = np.minimum(np.searchsorted(ka, kb), max(n - 1, 0))
    same = ka[at] == kb if n else np.zeros(m, bool)
    both = float(np.minimum(wa[at[same]], wb[same]).sum(dtype=np.float64)) if n else 0.0
    return both / max(float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - both, 1e-30)


def _similarities(batches):
    for batch in batches:
        a, b = batch.column("va").to_pylist(), batch.column("vb").to_pylist()
        j = [weighted_jaccard(x, y) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(j, pa.float64())], ["a", "b", "similarity"])


def verified(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b). An ``a`` with many partners is spread: its partners are dealt
    to groups of about ``_MEMBERS`` and its vector goes to each group once."""
    many = pairs.groupBy("a").agg(F.greatest(F.ceil(F.count(F.lit(1)) / _MEMBERS), F.lit(1)).cast("int").alias("_n"))
    left = (many.join(vectors.select(F.col("doc_id").alias("a"), F.col("vector").alias("va")), "a")
            .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).select("a", "_salt", "va"))
    right = (pairs.join(many, "a").withColumn("_salt", F.pmod(F.xxhash64("b"), F.col("_n")).cast("int")).select("a", "b", "_salt")
             .join(vectors.select(F.col("doc_id").alias("b"), F.col("vector").alias("vb")), "b"))
    return right.join(left, ["a", "_salt"]).select("a", "b", "va", "vb").mapInArrow(_similarities, "a long, b long, similarity double")


def _links(members: DataFrame, vectors: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs that share a bucket.

    First all members of a bucket meet its leader, the document with most company in all its buckets. After that only
    pairs of a bucket whose documents are not yet in one component can join anything. Of these, two that are both
    linked to the leader cannot be; 1 - similarity is a metric, so the distances of a similar pair to the leader
    differ by at most 1 - ``similarity``. The pairs left are verified too, in blocks of bounded size: a block of
    members far from the leader meets each block of all members, and only links leave the task."""
    # written tables on one side: Spark can then split the other side's large partitions
    sizes = saved(members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "near-sizes")
    members = saved(members.join(sizes, ["band", "key"]), "near-members")
    company = members.groupBy("doc").agg(F.sum("_n").alias("_c"))
    members = members.join(company, "doc")
    leaders = members.groupBy("band", "key").agg(F.max(F.struct("_c", (-F.col("doc")).alias("_d")))["_d"].alias("_d")) \
        .select("band", "key", (-F.col("_d")).alias("a"))
    leaders = saved(leaders, "near-leaders")
    met = members.select("band", "key", F.col("doc").alias("b")).join(leaders, ["band", "key"])
    met = saved(met.where("a <> b"), "near-met")
    first = saved(verified(met.select("a", "b").distinct(), vectors.select("doc_id", "vector")), "near-first")
    stars = components(first.where(F.col("similarity") >= similarity))
    joined = stars.select(F.col("node").alias("b"), "root")
    far = met.join(first, ["a", "b"]).join(joined, "b", "left") \
        .select("band", "key", "b", (1 - F.col("similarity")).alias("d"), F.coalesce("root", "b").alias("root"))
    far = saved(far, "near-far")
    mixed = far.groupBy("band", "key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("band", "key")
    far = far.join(mixed, ["band", "key"], "left_semi")
    counts = far.groupBy("band", "key").agg(F.sum((F.col("d") > 1 - similarity).cast("int")).alias("_x"), F.count(F.lit(1)).alias("_y"))
    far = far.join(counts, ["band", "key"]).withColumn("_nx", F.ceil(F.col("_x") / _FAR_BLOCK).cast("int")).withColumn(
        "_ny", F.ceil(F.col("_y") / _NEAR_BLOCK).cast("int")).where("_nx > 0").join(vectors.withColumnRenamed("doc_id", "b"), "b")
    cell = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = ["b", "d", "root", "keys", "vector"]
    alone = far.where(F.col("d") > 1 - similarity).select("band", "key", cell("_nx").alias("_i"), every("_ny").alias("_j"), F.lit(True).alias("alone"), *data)
    all_ = far.select("band", "key", every("_nx").alias("_i"), cell("_ny").alias("_j"), F.lit(False).alias("alone"), *data)
    second = alone.unionByName(all_).groupBy("band", "key", "_i", "_j").applyInArrow(ex.task(_across, similarity), "a long, b long")
    # the components found so far stand for their links; mostly no other link is left
    return stars.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(second)


def _across(similarity: float, table: pa.Table) -> pa.Table:
    """Links between a block of members that are far from their leader and a block of all members of the bucket. A
    pair is looked at in the first bucket that it shares only."""
    band = table.column("band")[0].as_py() if table.num_rows else 0
    side = np.array(table.column("alone").to_pylist(), dtype=bool)
    doc, d, root = (table.column(c).to_numpy() for c in ("b", "d", "root"))
    keys = np.array(table.column("keys").to_pylist(), dtype=np.int64).reshape(len(doc), -1)
    vectors = table.column("vector").to_pylist()
    ys = np.flatnonzero(~side)
    names = [np.frombuffer(v, np.uint32, len(v) // 8) for v in vectors]
    weights = [np.frombuffer(v, np.float32, len(v) // 8, len(v) // 2) for v in vectors]
    total = np.array([w.sum(dtype=np.float64) for w in weights])
    reach, links = 1 - similarity, []
    for x in np.flatnonzero(side):
        may = (root[ys] != root[x]) & (np.abs(d[ys] - d[x]) <= reach + 1e-6) & ((d[ys] <= reach) | (doc[ys] > doc[x]))
        may &= ~(keys[ys][:, :band] == keys[x, :band]).any(axis=1)
        may &= np.minimum(total[ys], total[x]) >= (similarity - 1e-6) * np.maximum(total[ys], total[x])
        y = ys[may]
        if not len(y) or not len(names[x]):
            continue
        k, w = np.concatenate([names[i] for i in y]), np.concatenate([weights[i] for i in y])
        size = np.array([len(names[i]) for i in y])
        at = np.minimum(np.searchsorted(names[x], k), len(names[x]) - 1)
        low = np.where(names[x][at] == k, np.minimum(weights[x][at], w), np.float32(0)).astype(np.float64)
        both = np.add.reduceat(low, np.concatenate([[0], np.cumsum(size)[:-1]]))
        links.extend((int(doc[x]), int(doc[i])) for i in y[both >= similarity * (total[x] + total[y] - both)])
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): the smallest node of each component of undirected ``links`` (a, b), by alternating
    large-star and small-star rounds over written tables until every node hangs on its root."""
    edges = saved(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), name)
    while not _is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = saved(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = saved(small.where("u <> v").distinct(), name)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _is_star_forest(edges: DataFrame) -> bool:
    """Every node has one neighbour below it, and that one has none."""
    if edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").count():
        return False
    return edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").count() == 0


def _classes(docs: DataFrame, shingle: int, similarity: float, bands: int, rows: int, idf_strength: float, doc_id: str, text: str) -> DataFrame:
    """(id, digest, root) of every row that is near another one."""
    lay = ex.layout(docs, text)
    by_block = ex.dealt(docs, lay, doc_id, text).groupBy(ex.CHUNK)
    counts = (by_block.applyInArrow(ex.task(_send_shingles, lay, shingle), _SENT)
              .groupBy(ex.PART).applyInArrow(ex.task(_count), _ANSWER))
    signed = saved(by_block.cogroup(counts.groupBy(ex.CHUNK)).applyInArrow(
        ex.task2(_sign, lay, shingle, similarity, bands, rows, idf_strength), _SIGNED), "near-signed")
    heads = signed.where(F.col("text_key").isNotNull())
    same = saved(heads.groupBy("text_key").agg(F.min("doc_id").alias("rep")), "near-same")
    head_rep = heads.select("doc_id", "text_key").join(same, "text_key").select(F.col("doc_id").alias("leader"), "rep")
    vectors = saved(heads.join(same.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "vector", "keys"), "near-vectors")
    members = vectors.select(F.col("doc_id").alias("doc"), F.posexplode("keys").alias("band", "key"))
    roots = components(_links(members, vectors, similarity))
    head_rep = head_rep.join(roots, head_rep["rep"] == roots["node"], "left").select("leader", F.coalesce("root", "rep").alias("root"))
    return saved(signed.select("id", "digest", "leader").join(head_rep, "leader").select("id", "digest", "root"), "near-classes")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                    idf_strength: float = IDF_STRENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id), one row per distinct id: the class is named by its smallest id."""
    classes = _classes(docs, shingle, similarity, bands, rows, idf_strength, doc_id, text)
    names = classes.groupBy("root").agg(F.min("id").alias("class_id"))
    found = classes.where("id IS NOT NULL").join(names, "root").groupBy(F.col("id").alias("doc_id")).agg(F.min("class_id").alias("class_id"))
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id")).distinct()
    return every.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
             idf_strength: float = IDF_STRENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, of each class one. Rows go by id and text, whatever other rows carry their id."""
    classes = _classes(docs, shingle, similarity, bands, rows, idf_strength, doc_id, text)
    order = F.struct(F.col("id").isNull().alias("none"), "id", "digest")
    kept = saved(classes.groupBy("root").agg(F.min(order).alias("k")), "near-kept")
    texts = classes.groupBy("root", "id", "digest").agg(F.count(F.lit(1)).alias("n")).join(kept, "root")
    first = F.col("id").eqNullSafe(F.col("k.id")) & (F.col("digest") == F.col("k.digest"))
    texts = saved(texts.select(F.col("id").alias("__near_id"), F.col("digest").alias("__near_digest"), first.alias("__near_first"), "n")
                  .where("NOT __near_first OR n > 1").drop("n"), "near-gone")
    digest = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    same = F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col("__near_id")) & (digest == F.col("__near_digest"))
    left = docs.join(texts.drop("__near_first"), same, "left_anti")
    repeated = texts.where("__near_first").select("__near_id", "__near_digest")
    if repeated.isEmpty():
        return left
    # rows equal in id and text to the one kept: any of them, combined in the task first
    every = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__near_row")
    some = docs.join(repeated, same, "inner").select("__near_id", "__near_digest", every).groupBy("__near_id", "__near_digest").agg(F.first("__near_row").alias("r"))
    return left.unionByName(some.select("r.*"))
