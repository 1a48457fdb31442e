"""Toxic spans by a linear-chain conditional random field (CRF).

Token labels come from document labels: a word, or a beginning of words (3 to 10 characters), is an evidence type if the
lower confidence bound of the share of toxic documents among its documents is at least ``EVIDENCE``, and documents drawn at the
sample's own share of toxic ones would show so many toxic ones with a chance of at most ``CHANCE``; there is no limit on frequency. In toxic
documents the words with such a type are labelled 1, all others 0. The CRF has two states per word. Its state weights
are the word's strongest type, types of the neighbours, digits and length; transitions are free. It is fitted by L-BFGS: a step
is one Spark pass over the written words, whose tasks add up forward-backward expectations. For scoring, forward and backward
messages of a two-state chain are ratios that each word maps by a 2 x 2 matrix; matrices are multiplied in blocks of words, so all texts
of a batch advance together and a very long text takes no longer than its words.

A document's score is a logistic function of its three largest marginals, the expected number and share of toxic words
and its length, fitted and calibrated (isotonic regression) on a quarter of the sample that the tagger did not see. Offending spans are the runs of words with a marginal of 0.5 or more.

Labels are the only outside input: doc_id, lang and source never enter a score. The model is fitted on at most
``SAMPLE`` labelled documents (those with the smallest hashes); types are counted in all of them that are not set aside, the CRF sees
the whole texts of all toxic ones of these and of about as many others. The types are broadcast, 16 bytes each, at most ``TYPES`` of
them, the strongest; all documents are scored, on their whole texts.

Defined cases: null and empty texts have no words and get the score of a text without evidence; null labels are not used; of
repeated labels of an id the largest counts; rows that repeat an id are scored each for itself, and are documents of their own in the
sample unless the text is the same too; without labels the score is 0, with one class it is that class's smoothed share; a null
id is hashed as an empty string.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from annoscope.llm import _text as tx
from annoscope.session import written as saved
from annoscope.llm.near_dedup import GAP
from annoscope.llm.quality import _isotonic, fold
from annoscope.operators import sparse as sp
from annoscope.operators.train import Model as Search

EVIDENCE, CONFIDENCE, CHANCE, TYPES = 0.3, 2.0, 1e-4, 1 << 20
SAMPLE, STEPS, RIDGE = 20_000, 100, 0.05  # a weak ridge: a type of four documents must outweigh the bias
PREFIXES = range(3, 11)
GRID, LOW, HIGH = 400, -10.0, 10.0  # of the linear score
_BLOCK = 64
_FILTER_BITS = 20
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True


@dataclass
class Words:
    """The words of a run of texts: byte spans, first word of each text, and the characters before each byte."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    chars: np.ndarray
    char_at: np.ndarray

    @staticmethod
    def of(text: pa.Array) -> Words:
        data, offsets = tx.utf8(pc.utf8_lower(text))
        start, end, first = tx.word_spans(data, offsets, GAP)
        begins = (data & 0xC0) != 0x80
        return Words(data, start, end, first, np.concatenate([[0], np.cumsum(begins)]), np.append(np.flatnonzero(begins), len(data)))

    def types(self) -> Iterator[np.ndarray]:
        """Hashes of each word and of its beginnings; 0 where the word is no longer than the beginning."""
        if not len(self.start):
            return
        up, down = tx._power_tables(len(self.data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tx._BYTE_VALUE[self.data] * up[:len(self.data)])])
        base, factor = total[self.start], down[self.start]
        yield tx.mix((total[self.end] - base) * factor) | np.uint64(1)
        c, n = self.chars[self.start], self.chars[self.end] - self.chars[self.start]
        for k in PREFIXES:
            longer = np.flatnonzero(n > k)
            out = np.zeros(len(self.start), np.uint64)
            stop = self.char_at[c[longer] + k]
            out[longer] = tx.mix((total[stop] - base[longer]) * factor[longer] + np.uint64(k)) | np.uint64(1)
            yield out


@dataclass
class Lexicon:
    """Evidence types in ascending order of hash, with the strength of each."""

    keys: np.ndarray
    strength: np.ndarray
    seen: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, strength: np.ndarray) -> Lexicon:
        order = np.argsort(keys)
        seen = np.zeros(1 << _FILTER_BITS, dtype=bool)
        seen[keys >> np.uint64(64 - _FILTER_BITS)] = True
        return Lexicon(keys[order], strength[order], seen)

    def where(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, types) of the hashes that are in the lexicon."""
        at = np.flatnonzero(self.seen[hashes >> np.uint64(64 - _FILTER_BITS)])
        i = np.minimum(np.searchsorted(self.keys, hashes[at]), max(len(self.keys) - 1, 0))
        real = self.keys[i] == hashes[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[real], i[real]

    def strongest(self, words: Words) -> np.ndarray:
        """Per word 1 + its strongest type, or 0."""
        out, best = np.zeros(len(words.start), np.int64), np.zeros(len(words.start))
        for hashes in words.types():
            at, i = self.where(hashes)
            better = self.strength[i] > best[at]
            out[at[better]], best[at[better]] = i[better] + 1, self.strength[i[better]]
        return out


# ---- the chain ----
def _shape(words: Words) -> np.ndarray:
    digits = np.concatenate([[0], np.cumsum(_DIGIT[words.data])])
    return np.stack([digits[words.end] > digits[words.start], words.end - words.start > 12], axis=1).astype(float)


def _neighbours(kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    known = (kind > 0).astype(float)
    before, after = np.zeros(len(kind)), np.zeros(len(kind))
    before[1:], after[:-1] = known[:-1], known[1:]
    some = np.diff(first) > 0
    before[first[:-1][some]] = 0
    after[first[1:][some] - 1] = 0
    return np.stack([before, after], axis=1)


@dataclass
class Chain:
    """Weights of the CRF: types, then (bias, before, after, digits, long), then transitions 01, 10, 11."""

    types: np.ndarray
    rest: np.ndarray
    moves: np.ndarray

    def emissions(self, kind: np.ndarray, extra: np.ndarray) -> np.ndarray:
        return np.concatenate([[0.0], self.types])[kind] + self.rest[0] + extra @ self.rest[1:]


def messages(b: np.ndarray, first: np.ndarray, k01: float, k10: float, k11: float) -> tuple[np.ndarray, np.ndarray]:
    """(r, s): ratios state 1 : state 0 of the forward messages (with the word's own factor ``b``) and of the backward ones,
    for chains that lie end to end."""
    start = first[:-1][np.diff(first) > 0]
    forward = _chain(b, first, lambda x: (k11 * x, k01 * x, np.full(len(x), k10), np.ones(len(x))), start, b[start])
    # Backwards the message passes the next word's factor; each chain is read from its end.
    flip = np.concatenate([first[-1] - first[::-1]])
    moved = b[::-1]
    after = np.concatenate([[1.0], moved[:-1]])  # the factor of the word behind; the first of each chain has none
    start = flip[:-1][np.diff(flip) > 0]
    backward = _chain(after, flip, lambda x: (k11 * x, np.full(len(x), k10), k01 * x, np.ones(len(x))), start, np.ones(len(start)))
    return forward, backward[::-1]


def _chain(b: np.ndarray, first: np.ndarray, matrix, start: np.ndarray, value: np.ndarray) -> np.ndarray:
    """x_t = (m11 x_(t-1) + m10) / (m01 x_(t-1) + m00) along each chain, with (m11, m10, m01, m00) = ``matrix``(b);
    at the chains' first words ``start`` x is ``value``."""
    n = len(b)
    out = np.empty(n)
    if not n:
        return out
    size = np.diff(first)
    rows = -(-size // _BLOCK)
    row_first = np.concatenate([[0], np.cumsum(rows)])
    chain = np.repeat(np.arange(len(size)), rows)
    begin = first[chain] + (np.arange(row_first[-1]) - row_first[chain]) * _BLOCK
    length = np.minimum(first[chain + 1] - begin, _BLOCK)
    m = [np.ascontiguousarray(v) for v in matrix(b)]
    m[0][start], m[1][start], m[2][start], m[3][start] = 0.0, value, 0.0, 1.0  # a constant map
    p11, p10, p01, p00 = np.ones(len(begin)), np.zeros(len(begin)), np.zeros(len(begin)), np.ones(len(begin))
    for j in range(_BLOCK):
        i = np.minimum(begin + j, n - 1)
        live = j < length
        a, c, d, e = (np.where(live, v[i], w) for v, w in zip(m, (1.0, 0.0, 0.0, 1.0)))
        p11, p10, p01, p00 = a * p11 + c * p01, a * p10 + c * p00, d * p11 + e * p01, d * p10 + e * p00
        top = np.maximum(np.maximum(p11, p10), np.maximum(p01, p00))
        p11, p10, p01, p00 = p11 / top, p10 / top, p01 / top, p00 / top
    x, at_row = np.zeros(len(size)), np.zeros(len(begin))
    by_rank = np.argsort(-rows, kind="stable")
    falling = -rows[by_rank]
    for j in range(int(rows.max()) if len(rows) else 0):
        live = by_rank[:np.searchsorted(falling, -j, "left")]
        row = row_first[live] + j
        at_row[row] = x[live]
        x[live] = (p11[row] * x[live] + p10[row]) / (p01[row] * x[live] + p00[row])
    x = at_row
    for j in range(_BLOCK):
        live = np.flatnonzero(j < length)
        if not len(live):
            break
        i = begin[live] + j
        x[live] = (m[0][i] * x[live] + m[1][i]) / (m[2][i] * x[live] + m[3][i])
        out[i] = x[live]
    return out


def marginals(chain: Chain, kind: np.ndarray, extra: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The probability of state 1 of each word."""
    b = np.exp(np.clip(chain.emissions(kind, extra), -30, 30))
    r, s = messages(b, first, *np.exp(chain.moves))
    return r * s / (1 + r * s)


def _chain_of(w: np.ndarray, types: int) -> Chain:
    """From weights in the order bias, types, the rest, transitions."""
    return Chain(w[1:types + 1], np.concatenate([w[:1], w[types + 1:-3]]), np.clip(w[-3:], -30, 30))


def add_loss(total: np.ndarray, w: np.ndarray, types: int, kind: np.ndarray, extra: np.ndarray, first: np.ndarray, label: np.ndarray) -> None:
    """Add the gradient of minus the conditional log-likelihood of these chains, then its value, then the number of words."""
    begins = np.zeros(len(kind), dtype=bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    inner, last = np.flatnonzero(~begins), first[1:][np.diff(first) > 0] - 1
    chain = _chain_of(w, types)
    emission = np.clip(chain.emissions(kind, extra), -30, 30)
    b, (k01, k10, k11) = np.exp(emission), np.exp(chain.moves)
    r, s = messages(b, first, k01, k10, k11)
    p = r * s / (1 + r * s)
    before, bs = r[inner - 1], b[inner] * s[inner]
    pairs = np.stack([k01 * bs, before * k10, before * k11 * bs])
    expected = (pairs / (1 + pairs.sum(axis=0))).sum(axis=1)
    seen = np.array([np.sum((label[inner - 1] == i) & (label[inner] == j)) for i, j in ((0, 1), (1, 0), (1, 1))], float)
    d = p - label
    total[0] += d.sum()
    total[1:types + 1] += np.bincount(kind, d, types + 1)[1:]
    total[types + 1:-5] += extra.T @ d
    total[-5:-2] += expected - seen
    # the sum over all labellings, from the ratios: state 0 of a word gathers 1 + k10 r, a chain's end 1 + r
    total[-2] += np.log1p(k10 * before).sum() + np.log1p(r[last]).sum() - label @ emission - seen @ chain.moves
    total[-1] += len(kind)


def _squares(total: np.ndarray, types: int, kind: np.ndarray, extra: np.ndarray, first: np.ndarray) -> None:
    """Add the squares of the features, and the number of words last: the scale of the first step."""
    total[0] += len(kind)
    total[1:types + 1] += np.bincount(kind, minlength=types + 1)[1:]
    total[types + 1:-5] += extra.sum(axis=0)
    total[-5:-2] += len(kind) - np.count_nonzero(np.diff(first))
    total[-1] += len(kind)


def _descend(evaluate, squares: np.ndarray, ridge: float, steps: int) -> np.ndarray:
    """The weights of least loss plus ridge; ``evaluate`` gives the sums of ``add_loss`` at a point."""
    search = sp._Search(Search(0, 1 / ridge, 0), len(squares), 1e-7, squares, steps)
    search.ridge[:] = ridge
    search.model.weights = np.zeros(len(squares))
    for _ in range(steps):
        got = evaluate(search.trial)
        if not search.tell(got[-2], got[:-2], got[-1]):
            break
    return search.model.weights


def fit_chain(kind: np.ndarray, extra: np.ndarray, first: np.ndarray, label: np.ndarray, types: int, steps: int = STEPS, ridge: float = 1e-3) -> Chain:
    """Maximum of the conditional log-likelihood, 100 times its mean per word, with ridge, for chains in memory."""
    width = types + extra.shape[1] + 6

    def sums(add, *args) -> np.ndarray:
        total = np.zeros(width)
        add(total, *args)
        return total

    w = _descend(lambda point: sums(add_loss, point, types, kind, extra, first, label), sums(_squares, types, kind, extra, first)[:-2], ridge * len(kind) / 100, steps)
    return _chain_of(w, types)


# ---- the model ----
@dataclass
class Model:
    lexicon: Lexicon
    chain: Chain
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None
    constant: float | None = None

    def read(self, text: pa.Array) -> tuple[Words, np.ndarray]:
        words = Words.of(text)
        kind = self.lexicon.strongest(words)
        extra = np.concatenate([_neighbours(kind, words.first), _shape(words)], axis=1)
        return words, marginals(self.chain, kind, extra, words.first)

    def features(self, first: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Per text: the chance that one of its three most probable words is toxic, the expected number of toxic words
        and their share (logarithms), the length, and products of these."""
        cost = -np.log1p(-np.minimum(p, 1 - 1e-9))
        doc, n = tx.doc_of(first), np.diff(first)
        some = np.flatnonzero(n > 0)
        total, expected = np.zeros(len(n)), np.bincount(doc, p, len(n))
        for _ in range(3):
            if not len(some):
                break
            top = np.zeros(len(n))
            top[some] = np.maximum.reduceat(cost, first[some])
            total += top
            hit = np.flatnonzero(cost >= top[doc])
            cost[hit[tx.segment_starts(doc[hit])]] = 0.0
        x = np.stack([np.log(total + 1e-4), np.log(expected + 1e-2), np.log((expected + 1e-2) / (n + 10)), np.log(n + 1)], axis=1)
        return np.concatenate([x, x[:, :1] * x[:, 2:3], x[:, 2:3] ** 2, x[:, :1] ** 2], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The document's linear score, from its features."""
        return np.clip((x - self.mean) / self.spread @ self.weights[1:] + self.weights[0], LOW, HIGH)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.interp(self.raw(x), *self.knots)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps (the intercept first)."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
    return w


def _type_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(type, documents, toxic documents) of each batch's texts."""
    for batch in batches:
        for part in tx.slices(batch):
            words = Words.of(part.column("text"))
            toxic = np.array(part.column("y").to_pylist(), float)
            doc, found = tx.doc_of(words.first).astype(np.uint64), []
            for hashes in words.types():
                at = np.flatnonzero(hashes)
                # equal types of a document are next to each other: the low bits of a hash make room for the text's number
                found.append(np.unique(hashes[at] & ~np.uint64(0xFFFFF) | doc[at]))
            if found:
                pair = np.concatenate(found)
                types, at = np.unique(pair & ~np.uint64(0xFFFFF), return_inverse=True)
                bad = np.bincount(at, toxic[(pair & np.uint64(0xFFFFF)).astype(np.int64)], len(types))
                yield pa.RecordBatch.from_arrays([pa.array(types.view(np.int64), pa.int64()), pa.array(np.bincount(at), pa.int64()),
                                                  pa.array(bad.astype(np.int64), pa.int64())], ["type", "n", "a"])


def _evidence(rows: DataFrame, share: float) -> Lexicon:
    """The evidence types of labelled rows (text, y), of which ``share`` are toxic."""
    counted = rows.select("text", "y").mapInArrow(_type_counts, "type long, n long, a long").groupBy("type").agg(F.sum("n").alias("n"), F.sum("a").alias("a"))
    n, p, z = F.col("n"), F.col("a") / F.col("n"), F.lit(CONFIDENCE)
    bound = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    clean = F.when(p < 1, (1 - p) * F.log((1 - p) / F.lit(1 - share))).otherwise(0.0)
    surprise = F.when((p > share), n * (p * F.log(p / F.lit(share)) + clean)).otherwise(0.0)  # Chernoff's bound on the chance of so many
    good = counted.withColumn("bound", bound).where((F.col("bound") >= EVIDENCE) & (surprise >= F.lit(-float(np.log(CHANCE)))))
    got = good.orderBy(F.col("bound").desc(), "type").limit(TYPES).select("type", "bound").toArrow()
    return _Masked.of(got.column("type").to_numpy().view(np.uint64), got.column("bound").to_numpy())


class _Masked(Lexicon):
    """A lexicon of hashes without their low 20 bits."""

    @staticmethod
    def of(keys: np.ndarray, strength: np.ndarray) -> _Masked:
        lex = Lexicon.of(keys, strength)
        return _Masked(lex.keys, lex.strength, lex.seen)

    def where(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return super().where(hashes & ~np.uint64(0xFFFFF))


def _encoded(shared):
    """The words of learning texts: kinds, the other features and the label in bits, words per text; a row for each run of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                words = Words.of(part.column("text"))
                kind = shared.value.strongest(words)
                y = np.array(part.column("y").to_pylist(), np.uint8)
                extra = np.concatenate([_neighbours(kind, words.first), _shape(words)], axis=1).astype(np.uint8)
                bits = extra @ np.array([1, 2, 4, 8], np.uint8) + 16 * ((kind > 0) & (y[tx.doc_of(words.first)] > 0)).astype(np.uint8)
                row = (kind.astype(np.int32), bits.astype(np.uint8), np.diff(words.first).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in row], ["kind", "bits", "size"])
    return run


def _chains(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, extra, first, label) of each row of ``_encoded``."""
    for kind, bits, size in zip(*(batch.column(c) for c in ("kind", "bits", "size"))):
        flags = np.frombuffer(bits.as_py(), np.uint8)
        extra = (flags[:, None] >> np.arange(4, dtype=np.uint8) & 1).astype(float)
        first = np.concatenate([[0], np.cumsum(np.frombuffer(size.as_py(), np.int64))])
        yield np.frombuffer(kind.as_py(), np.int32).astype(np.int64), extra, first, (flags >> 4).astype(float)


def _model(rows: DataFrame) -> Model:
    """The types of all rows (text, y, h), and the chain fitted on the toxic ones and about as many others."""
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sc = rows.sparkSession.sparkContext
    lexicon = _evidence(rows, size[1] / (size[0] + size[1]))
    types = len(lexicon.keys)
    part = F.pmod(F.xxhash64(F.lit(1), F.col("h")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, max(size[1], 500) / size[0]))
    words = rows.where((F.col("y") == 1) | part).select("text", "y").mapInArrow(_encoded(sc.broadcast(lexicon)), "kind binary, bits binary, size binary")
    words = saved(words, "toxic-words")
    tasks, shape = sp._tasks(words), (types + 10, 1)

    def squares(total: np.ndarray, batch: pa.RecordBatch) -> None:
        for kind, extra, first, _ in _chains(batch):
            _squares(total[:, 0], types, kind, extra, first)

    def evaluate(point: np.ndarray) -> np.ndarray:
        given = sc.broadcast(point)

        def work(total: np.ndarray, batch: pa.RecordBatch) -> None:
            for chains in _chains(batch):
                add_loss(total[:, 0], given.value, types, *chains)

        out = sp._summed(words, tasks, shape, work)[0]
        given.destroy()
        return out

    sums = sp._summed(words, tasks, shape, squares)
    if not sums or not sums[0][-1]:
        return Model(lexicon, _chain_of(np.zeros(types + 8), types))
    return Model(lexicon, _chain_of(_descend(evaluate, sums[0][:-2], RIDGE, STEPS), types))


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Fit on labelled rows for which ``train`` (over doc_id) holds, at most ``SAMPLE`` of them."""
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    chosen = saved(marks.where(train & F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE), "toxic-labels")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("h"))
    least = saved(rows.select("h").distinct().orderBy("h").limit(SAMPLE), "toxic-keys")  # ids may repeat: the bound is one of texts
    rows = saved(rows.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"]), "toxic-sample")
    size = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(size) < 2:
        n = sum(size.values())
        return Model(Lexicon.of(np.zeros(0, np.uint64), np.zeros(0)), Chain(np.zeros(0), np.zeros(5), np.zeros(3)),
                     constant=(size.get(1, 0) + 1) / (n + 2) if n else 0.0)
    learn, check = rows.where(F.pmod(F.col("h"), F.lit(4)) != 0), rows.where(F.pmod(F.col("h"), F.lit(4)) == 0)
    if len({r["y"] for r in learn.select("y").distinct().collect()}) < 2 or len({r["y"] for r in check.select("y").distinct().collect()}) < 2:
        learn = check = rows  # too few labels to set a part aside
    model = _model(learn)
    # seven numbers of each document that the model did not see: at most SAMPLE rows
    seen = check.mapInArrow(_features(rows.sparkSession.sparkContext.broadcast(model)), "x array<double>, y int, h long").collect()
    seen.sort(key=lambda r: (r["h"], r["y"]))
    x, y = np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen], float)
    model.mean, model.spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    model.weights = _logistic((x - model.mean) / model.spread, y)
    cell = np.minimum(((model.raw(x) - LOW) / (HIGH - LOW) * GRID).astype(int), GRID - 1)
    count = np.bincount(cell, minlength=GRID)
    some = np.flatnonzero(count)
    model.knots = _isotonic(LOW + (some + 0.5) * (HIGH - LOW) / GRID, np.bincount(cell, y, GRID)[some], count[some])
    return model


def _features(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices(batch):
                words, p = shared.value.read(part.column("text"))
                x = shared.value.features(words.first, p)
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), part.column("y").combine_chunks(), part.column("h").combine_chunks()], ["x", "y", "h"])
    return run


def _judged(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in tx.slices(batch):
                words, p = model.read(part.column("text"))
                score = model.score(model.features(words.first, p))
                edge = np.zeros(len(p) + 1, dtype=bool)
                edge[words.first] = True
                on = p >= 0.5
                left, right = np.concatenate([[False], on[:-1]]), np.concatenate([on[1:], [False]])
                begin = np.flatnonzero(on & (~left | edge[:-1]))
                end = np.flatnonzero(on & (~right | edge[1:]))
                text_start = words.chars[tx.utf8(pc.utf8_lower(part.column("text")))[1]][:-1]
                doc = tx.doc_of(words.first)[begin] if len(begin) else begin
                top = np.maximum.reduceat(np.append(p, 0), np.stack([begin, end + 1], axis=1).reshape(-1))[::2] if len(begin) else np.zeros(0)
                spans = pa.StructArray.from_arrays([pa.array(words.chars[words.start[begin]] - text_start[doc], pa.int64()),
                                                    pa.array(words.chars[words.end[end]] - text_start[doc], pa.int64()), pa.array(top, pa.float64())],
                                                   ["begin", "end", "probability"])
                offsets = pa.array(np.searchsorted(begin, words.first), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").combine_chunks(), pa.array(score, pa.float64()), pa.ListArray.from_arrays(offsets, spans)],
                                                 ["doc_id", "score", "spans"])
    return run


def tag(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, spans) of every row; spans are (begin, end, probability) in characters of the text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_judged(docs.sparkSession.sparkContext.broadcast(model)),
                           "doc_id long, score double, spans array<struct<begin:long,end:long,probability:double>>")


def detect(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2, doc_id: str = "doc_id", text: str = "text",
           threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row; labels of held-out rows (crc32 of the id) are not used."""
    model = fit(docs, labels, label, fold(F.col("doc_id"), folds) != held_out, doc_id, text)
    out = tag(docs, model, doc_id, text)
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
