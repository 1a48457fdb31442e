"""Cross-tokenizer alignment: groups and links between the tokens of two tokenizers over the same bytes.

Both tokenizers read each text with one space before it; A is a byte-level BPE (a ``tokenizers`` file), B a
SentencePiece model that adds the space itself. The byte offsets at which tokens of A and of B end are two ascending
lists. They are merged by merge paths: binary searches on evenly spaced diagonals cut the merged order into
pieces of equal work, each piece finds the common ends in its own stretch and numbers its tokens by them, and the
pieces are stitched by adding up the common ends of those before; a piece also looks at the last A end before it, so that
a common end cut apart by a border is found once. All texts of a run lie one after the other in the same two
lists, so a long text is cut into pieces like many short ones.

Tokens between two common ends form a group; every A token of a group is linked with every B token of it. A text's
distinct links are written once, as rows of at most ``LINKS`` pairs. Spark counts the documents that
hold a pair (combined in the task first), finds each A id's highest count, and joins the counts to the written links. The table
of counts has one row for each pair of ids that occurs; it is broadcast up to ``BROADCAST_PAIRS`` rows and joined
by a shuffle beyond.

Defined cases: texts that are null or empty, or whose joined bytes of A or B are not the space and the text, have no tokens:
zeros, and an empty ``groups_sha256``. Null and repeated ids are documents like any other; a text of any length is read
whole; links are counted exactly (64 bits).
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from annoscope.llm import _text as tx
from annoscope.session import written

#: Public vocabularies; the driver reads the files and ships them.
TOKENIZER_A, TOKENIZER_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
PIECE = 1 << 15  # merge steps of one piece
LINKS = 1 << 21
BROADCAST_PAIRS = 1_000_000
_SHORT = 1 << 16  # characters up to which texts go to the rank-based encoder

# Fixed value: the split pattern of byte-level BPE.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# ---- tokenizers ----
def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others
    from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _by_rank(spec: dict) -> bool:
    """Whether merging the pair with the smallest joined id gives the same tokens as the file's merges: ids rise
    with the merges, and each entry, taken alone, is merged to itself."""
    from tokenizers import Tokenizer

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return False
    vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab[a + b] for a, b in pairs]
    if ids != sorted(ids):
        return False
    special = {t["content"] for t in spec.get("added_tokens", [])}
    entries = [p for p in vocab if p not in special]
    bare = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
    return all(e.ids == [vocab[p]] for p, e in zip(entries, bare.encode_batch(entries, add_special_tokens=False)))


class Tokenizers:
    """Both encoders and the bytes of each id, made once by a worker from the files' contents."""

    def __init__(self, a_file: bytes, b_file: bytes, by_rank: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        spec, letters = json.loads(a_file), _byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.a_bytes = [b""] * (max([*spec["model"]["vocab"].values(), *special.values()]) + 1)
        for piece, i in (spec["model"]["vocab"] | special).items():
            self.a_bytes[i] = piece.encode() if piece in special else bytes(letters[c] for c in piece)
        self.whole = Tokenizer.from_str(a_file.decode())
        self.whole.encode_special_tokens = True
        ranks = {b: i for i, b in enumerate(self.a_bytes) if i not in special.values()}
        self.quick = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if by_rank else None
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def encode_a(self, text: str) -> list[int]:
        if self.quick is not None and len(text) <= _SHORT:
            return self.quick.encode_ordinary(text)
        return self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of A and B, both empty where the text has no tokens."""
        if not text:
            return [], []
        want = b" " + text.encode()
        a = self.encode_a(" " + text)
        if b"".join(map(self.a_bytes.__getitem__, a)) != want:
            return [], []
        b = self.b.encode(text)
        return (a, b) if b"".join(map(self.b_bytes.__getitem__, b)) == want else ([], [])


@functools.lru_cache(maxsize=2)
def _cached(digest: str, key: Files) -> Tokenizers:
    return Tokenizers(*key.given.value)


class Files:
    """The broadcast files, hashed by their contents' digest."""

    def __init__(self, given: Broadcast, digest: str):
        self.given, self.digest = given, digest

    def __hash__(self) -> int:
        return hash(self.digest)

    def __eq__(self, other) -> bool:
        return self.digest == other.digest

    def tokenizers(self) -> Tokenizers:
        return _cached(self.digest, self)


# ---- merge paths ----
def diagonals(a: np.ndarray, b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge of two ascending lists (of equal numbers A's first) stands after each multiple of ``piece`` steps:
    how many entries of each list are behind it. One binary search a diagonal, all side by side."""
    steps = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(steps - len(b), 0), np.minimum(steps, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        a_first = np.zeros(len(steps), bool)
        a_first[open_] = a[middle[open_]] <= b[(steps - 1 - middle)[open_]]
        low, high = np.where(open_ & a_first, middle + 1, low), np.where(open_ & ~a_first, middle, high)
    return low, steps - low


def _piece(a: np.ndarray, b: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(A's groups, B's groups, common ends) of one piece, numbered from 0; ``before`` is the last A end before it, if any.
    A token's group is the number of common ends below its own end."""
    own = np.concatenate([before, a])
    at = np.searchsorted(b, own)
    common = own[np.flatnonzero(b[np.minimum(at, len(b) - 1)] == own)] if len(b) else own[:0]
    return np.searchsorted(common, a), np.searchsorted(common, b), len(common)


def groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, int]:
    """The group of each A and of each B token, and the number of groups."""
    i, j = diagonals(a, b, piece)
    of_a, of_b, base = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), 0
    for k in range(len(i) - 1):
        left, right, found = _piece(a[i[k]:i[k + 1]], b[j[k]:j[k + 1]], a[max(i[k] - 1, 0):i[k]])
        of_a[i[k]:i[k + 1]], of_b[j[k]:j[k + 1]] = base + left, base + right
        base += found
    return of_a, of_b, base


# ---- the digest and the links of a run of texts ----
@functools.lru_cache(maxsize=4)
def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0..most-1 as rows of bytes with one spare place, and their numbers."""
    text = [str(i).encode() for i in range(most)]
    size = np.array([len(t) for t in text], np.int64)
    return np.frombuffer(b"".join(t.ljust(size.max() + 1) for t in text), np.uint8).reshape(most, -1), size


def _digests(a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, n_groups: int, docs: np.ndarray, last: np.ndarray) -> list[str]:
    """SHA-256 of each text's groups as ``a1,a2|b1;a3|b2``; ``docs`` has the first group of each text, ``last`` says where its
    groups end."""
    n_a, n_b = np.bincount(ga, minlength=n_groups), np.bincount(gb, minlength=n_groups)
    end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
    place_a, place_b = np.arange(len(a)) + (end_b - n_b)[ga], np.arange(len(b)) + end_a[gb]
    ids, sep = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    sep[(end_a + end_b - n_b) - 1] = ord("|")
    sep[(end_a + end_b) - 1] = ord(";")
    table, size = _digits(1 << int(ids.max(initial=0)).bit_length())
    rows = table[ids]
    rows[np.arange(len(ids)), size[ids]] = sep
    text = rows[np.arange(table.shape[1]) <= size[ids][:, None]].tobytes()
    at = np.concatenate([[0], np.cumsum(size[ids] + 1)])
    until = np.concatenate([[0], end_a + end_b])
    return [hashlib.sha256(text[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(at[until[docs]].tolist(), at[until[last]].tolist())]


def _distinct(group: np.ndarray, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, id, times), ascending."""
    key, times = np.unique(group * size + ids, return_counts=True)
    return key // size, key % size, times


def links(doc_of_group: np.ndarray, a: np.ndarray, b: np.ndarray, ga: np.ndarray, gb: np.ndarray, a_ids: int, b_ids: int,
          most: int = LINKS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text, pair, times) of the distinct linked pairs a * b_ids + b of each text, ascending within a part; the parts, of about
    ``most`` pairs or of one text's one A id, hold different pairs."""
    g, x, times = _distinct(ga, a, a_ids)
    h, y, y_times = _distinct(gb, b, b_ids)
    first = np.searchsorted(h, g)
    width = np.searchsorted(h, g, "right") - first
    owner = doc_of_group[g] * a_ids + x
    order = np.argsort(owner, kind="stable")
    owner, first, width, times = owner[order], first[order], width[order], times[order]
    starts, total = tx.segment_starts(owner), np.concatenate([[0], np.cumsum(width)])
    bounds = np.append(starts, len(owner))
    k = 0
    while k < len(starts):
        to = max(int(np.searchsorted(total[bounds], total[bounds[k]] + most, "right")) - 1, k + 1)
        rows = slice(bounds[k], bounds[to])
        k = to
        w = width[rows]
        rep = np.repeat(np.arange(len(w)), w)
        at = first[rows][rep] + np.arange(len(rep)) - np.repeat(np.cumsum(w) - w, w)
        key = owner[rows][rep] * b_ids + y[at]
        by = np.argsort(key, kind="stable")
        key, m = key[by], (times[rows][rep] * y_times[at])[by]
        head = tx.segment_starts(key)
        key, m = key[head], np.add.reduceat(m, head)
        yield key // (a_ids * b_ids), key % (a_ids * b_ids), m


def _aligned(files: Files):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = files.tokenizers()
        for batch in batches:
            for part in tx.slices(batch):
                yield from _rows(t, part)

    return run


_MAIN = ("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def _rows(t: Tokenizers, part: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row for each text with its first part of links, and more rows with further parts."""
    a_lists, b_lists = zip(*[t.encode(x or "") for x in part.column("text").to_pylist()])
    n_a, n_b = (np.array([len(x) for x in lists], np.int64) for lists in (a_lists, b_lists))
    a, b = (np.fromiter((i for x in lists for i in x), np.int64, int(n.sum())) for lists, n in ((a_lists, n_a), (b_lists, n_b)))
    docs = len(n_a)
    ga, gb, n = groups(np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b]))
    doc_a = np.repeat(np.arange(docs), n_a)
    doc_of_group = doc_a[np.searchsorted(ga, np.arange(n))]
    bounds = np.searchsorted(doc_of_group, np.arange(docs + 1))
    per_group = np.concatenate([[0], np.cumsum(np.bincount(ga, minlength=n) * np.bincount(gb, minlength=n))])
    main = [part.column("key").combine_chunks(), part.column("doc_id").combine_chunks(), n_a, n_b, np.diff(bounds), per_group[bounds[1:]] - per_group[bounds[:-1]],
            pa.array(_digests(a, b, ga, gb, n, bounds[:-1], bounds[1:]), pa.string())]
    main = pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in main], list(_MAIN))
    seen = np.zeros(docs, bool)
    for doc, pair, m in links(doc_of_group, a, b, ga, gb, len(t.a_bytes), len(t.b_bytes)):
        heads = tx.segment_starts(doc)
        yield _batch(main, doc[heads], ~seen[doc[heads]], np.append(heads, len(doc)), pair, m)
        seen[doc[heads]] = True
    left = np.flatnonzero(~seen)
    yield _batch(main, left, np.ones(len(left), bool), np.zeros(len(left) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _batch(main: pa.Table, rows: np.ndarray, first: np.ndarray, offsets: np.ndarray, pair: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    flat = pa.StructArray.from_arrays([pa.array(pair), pa.array(m)], ["pair", "times"])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
    columns = [c.combine_chunks() for c in main.take(pa.array(rows)).columns]
    return pa.RecordBatch.from_arrays([*columns, pa.array(first), lists], [*_MAIN, "first", "links"])


def align(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", a_path: str = TOKENIZER_A, b_path: str = TOKENIZER_B,
          broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    spark = docs.sparkSession
    with open(a_path, "rb") as fa, open(b_path, "rb") as fb:
        a_file, b_file = fa.read(), fb.read()
    spec = json.loads(a_file)
    files = Files(spark.sparkContext.broadcast((a_file, b_file, _by_rank(spec))), hashlib.sha256(a_file + b_file).hexdigest())
    b_ids = _pieces(b_file)

    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"key long, doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, first boolean, links array<struct<pair:long,times:long>>"
    aligned = written(rows.mapInArrow(_aligned(files), schema), "aligned")

    each = aligned.select("key", F.inline("links"))
    counts = each.groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = written(counts.withColumn("a", F.expr(f"pair div {b_ids}")), "pair-counts")
    highest = counts.groupBy("a").agg(F.max("docs").alias("highest"))
    judged = written(counts.join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best")), "pair-best")
    if judged.count() <= broadcast_pairs:
        judged = F.broadcast(judged)
    sums = each.join(judged, "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    out = aligned.where("first").drop("first", "links").join(sums, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select(F.col("doc_id").alias(doc_id), "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")


def _pieces(model: bytes) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size()
