"""Token counts: greedy longest-match word pieces by a linear automaton.

The vocabulary is a trie with failure links. Where no child fits the next byte, the automaton follows the failure link
of its node and adds the number of pieces that the link pops; these numbers are computed beforehand, so a
word's piece count needs one pass over its bytes and no piece is ever built. All distinct words of a run
of texts walk the automaton side by side; known words are looked up by hash.

A word is a run of bytes other than space and 0x09-0x0D. With a byte vocabulary each word is read with one
space before it (its tokens carry the space); with ``continuation`` (such as b"##") pieces inside a word
are the tokens that begin with that mark. A word that cannot be cut into pieces counts as one unknown token.

Defined cases: null and empty texts, and those of white space only, count 0; ids may be null; rows that repeat an id count
each for itself; a word of any length is read whole. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from annoscope.llm import _text as tx

#: A public byte-level vocabulary; any file of base64 token and rank a line will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_KNOWN_WORDS = 1_000_000  # words remembered by a task; more are counted again


@dataclass(frozen=True)
class Automaton:
    """Edges as sorted keys node * 256 + byte; per node its failure link (-1: none), the pieces popped on
    it, and the pieces popped from it to the end of a word (-1: the word cannot be cut)."""

    edges: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    pops: np.ndarray
    last: np.ndarray
    start: int
    before: bytes

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each byte span."""
        n = len(start)
        node, total = np.full(n, self.start), np.zeros(n, np.int64)
        for b in self.before:
            self._step(node, total, np.arange(n), np.full(n, b))
        length = end - start
        order = np.argsort(-length, kind="stable")
        falling = -length[order]
        for j in range(int(length.max()) if n else 0):
            live = order[:np.searchsorted(falling, -j, "left")]
            live = live[node[live] >= 0]
            if not len(live):
                break
            self._step(node, total, live, data[start[live] + j].astype(np.int64))
        end_pops = np.where(node >= 0, self.last[np.maximum(node, 0)], -1)
        return np.where(end_pops < 0, 1, total + end_pops)

    def _step(self, node: np.ndarray, total: np.ndarray, who: np.ndarray, byte: np.ndarray) -> None:
        while len(who):
            key = node[who] * 256 + byte
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            fits = self.edges[at] == key
            node[who[fits]] = self.targets[at[fits]]
            who, byte = who[~fits], byte[~fits]
            total[who] += self.pops[node[who]]
            node[who] = self.link[node[who]]
            going = node[who] >= 0
            who, byte = who[going], byte[going]


def automaton(tokens: Iterable[bytes], before: bytes = b" ", continuation: bytes = b"") -> Automaton:
    """The automaton of a vocabulary. Without ``continuation`` the same tokens fit at the start of and inside a word."""
    children: list[dict[int, int]] = [{}]
    is_token = [False]
    inner = 0
    if continuation:
        children.append({})
        is_token.append(False)
        inner = 1

    def add(root: int, piece: bytes) -> None:
        v = root
        for b in piece:
            if b not in children[v]:
                children[v][b] = len(children)
                children.append({})
                is_token.append(False)
            v = children[v][b]
        is_token[v] = v != root

    for t in tokens:
        if continuation and t.startswith(continuation) and len(t) > len(continuation):
            add(inner, t[len(continuation):])
        elif t:
            add(0, t)
    link, pops = [-1] * len(children), [0] * len(children)
    level = [0] if inner == 0 else [0, inner]
    while level:
        below = []
        for u in level:
            for b, v in children[u].items():
                below.append(v)
                if is_token[v]:
                    link[v], pops[v] = inner, 1
                    continue
                z, n = link[u], pops[u]
                while z >= 0 and b not in children[z]:
                    n += pops[z]
                    z = link[z]
                if z >= 0:
                    link[v], pops[v] = children[z][b], n
        level = below
    last = [-1] * len(children)
    last[inner] = 0
    for v in range(len(children)):
        path, u = [], v
        while last[u] < 0 and link[u] >= 0:
            path.append(u)
            u = link[u]
        if last[u] >= 0:
            for w in reversed(path):
                last[w] = pops[w] + last[link[w]]
    pairs = sorted((u * 256 + b, v) for u, kids in enumerate(children) for b, v in kids.items())
    return Automaton(np.array([k for k, _ in pairs], np.int64), np.array([v for _, v in pairs], np.int64), np.array(link, np.int64),
                     np.array(pops, np.int64), np.array(last, np.int64), 0, before)


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Tokens of a file of base64 token and rank a line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        known, pieces = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in tx.slices(batch):
                data, offsets = tx.utf8(part.column("text"))
                start, end, first = tx.word_spans(data, offsets)
                hashes, at, which = np.unique(tx.span_hashes(data, start, end), return_index=True, return_inverse=True)
                where = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                old = known[where] == hashes if len(known) else np.zeros(len(hashes), bool)
                count = np.zeros(len(hashes), np.int64)
                count[old] = pieces[where[old]]
                new = at[~old]
                count[~old] = machine.counts(data, start[new], end[new])
                if len(known) + len(new) > _KNOWN_WORDS:
                    known, pieces = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                known, pieces = np.concatenate([known, hashes[~old]]), np.concatenate([pieces, count[~old]])
                order = np.argsort(known)
                known, pieces = known[order], pieces[order]
                total = np.concatenate([[0], np.cumsum(count[which])])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array(np.diff(first), pa.int64()),
                                                  pa.array(total[first[1:]] - total[first[:-1]], pa.int64())], ["doc_id", "n_words", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, doc_id: str = "doc_id", text: str = "text", before: bytes = b" ",
                 continuation: bytes = b"") -> DataFrame:
    """(doc_id, n_words, n_tokens) of every row. The vocabulary file is read by the driver and broadcast as arrays."""
    machine = automaton(read_vocabulary(vocabulary), before, continuation)
    if len(machine.link) > 20_000_000:
        raise ValueError("the vocabulary is too large to broadcast")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_counted(docs.sparkSession.sparkContext.broadcast(machine)), "doc_id long, n_words long, n_tokens long")
