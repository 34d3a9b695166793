"""Quality by nearest-neighbour voting over latent-semantic vectors.

Terms of a text: its words, pairs of neighbouring words and runs of three
characters (code points), after lower-casing A-Z, over the whole text, hashed to
``BUCKETS`` for the words and as many for the characters. A term weighs one plus
the log of its count, times its inverse document frequency, which is counted in
Spark over all rows; words and characters each have length 1. The latent space is
the leading singular vectors of these weights over the training rows (randomised
subspace iteration).

Beside them stands the shape of a text, ``SHAPE`` times as long: square roots
of the relative frequencies of its three-byte character-class patterns (letters by
case, digits, white space, each punctuation mark), and how far it repeats itself
(words against the word before, distinct words and word triples), by soft bins,
projected to the leading singular vectors of their own.

Training rows: at most ``MOST`` labelled documents outside the held-out fold, the
first in an order by hash; their vectors are broadcast (``MOST x 2 DIMS`` floats),
and so is the projection (``2 BUCKETS x DIMS``).
Every document's cosine with every one of them is computed exactly, block by
block; the ``NEAREST`` vote with their similarity to the power ``SHARPNESS``.

Cases: null and empty texts have no features and get the share of label 1 in the
training rows; labels of unknown documents and null labels are left out; of
repeated labels the largest counts; without any label the score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from residuum.llm.staging import give_back, hold, id_text
from residuum.llm.textops import LOWER, SPACE_SPLIT, blocks, find_words, prefix_hash, span_hash, text_buffer, word_hashes

MOST = 4096
DIMS = 48
BITS = 16
BUCKETS = 1 << BITS
SHAPE = 1.0
NEAREST = 25
SHARPNESS = 4
PATTERNS = 1021
_BINS = 12
FEATURES = PATTERNS + 3 * _BINS
_SLICE = 1 << 20
_CHARS = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_TOP = np.uint64(64 - BITS)

_CLASS = np.arange(256, dtype=np.int64)
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x80:] = 0x30, 0x41, 0x61, 0x61


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``most`` labelled documents of each label, the first by a hash of the id."""
    y = labels.where(F.col(label).isNotNull() & keep).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    some = [y.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for v, n in enumerate(most)] if isinstance(most, tuple) else [
        y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)]
    chosen = some[0] if len(some) == 1 else some[0].unionByName(some[1])
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def shapes(b) -> np.ndarray:
    """The shape features of each document of a block."""
    c = _CLASS[b.data]
    n = len(c)
    out = np.zeros((len(b.ids), FEATURES), np.float32)
    code = (c[:-2] * 65599 + c[1:-1] * 257 + c[2:]) % PATTERNS if n > 2 else c[:0]
    words = find_words(b.data, b.off, SPACE_SPLIT)
    h = word_hashes(b.data, words)
    total = prefix_hash(h)
    at = np.arange(max(0, len(h) - 2))
    triple = span_hash(total, at, at + 3)
    for i in range(len(b.ids)):
        low, high = int(b.off[i]), int(b.off[i + 1])
        if high - low > 2:
            out[i, :PATTERNS] = np.sqrt(np.bincount(code[low:high - 2], minlength=PATTERNS) / (high - low - 2))
        x, y = int(words.first[i]), int(words.first[i + 1])
        if y - x >= 3:
            same = float((h[x + 1:y] == h[x:y - 1]).mean())
            shares = (same, len(np.unique(h[x:y])) / (y - x) * (1 if y - x < 1000 else (y - x) / 1000) ** 0.5, len(np.unique(triple[x:y - 2])) / (y - x - 2))
            for k, v in enumerate(shares):
                p = min(max(v, 0.0), 1.0) * (_BINS - 1)
                j = min(int(p), _BINS - 2)
                out[i, PATTERNS + k * _BINS + j] = 1 - (p - j)
                out[i, PATTERNS + k * _BINS + j + 1] = p - j
    return out


def _characters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of each character in one number, and the first character of each document."""
    if not len(data) or data.max() < 0x80:
        return data, off
    first = (data & 0xC0) != 0x80
    first[off[:-1][off[:-1] < len(data)]] = True
    at = np.flatnonzero(first)
    size = np.diff(np.append(at, len(data)))
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        longer = size > k
        out[longer] |= data[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out, np.searchsorted(at, off)


def terms(b) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, term, count`` of the terms of a block's documents, by row and term."""
    data = LOWER[b.data]
    words = find_words(data, b.off, SPACE_SPLIT)
    h = word_hashes(data, words)
    doc = np.repeat(np.arange(len(b.ids)), np.diff(words.first))
    at = np.flatnonzero(doc[:-1] == doc[1:])
    pairs = span_hash(prefix_hash(h), at, at + 2)
    c, first = _characters(data, b.off)
    of = np.repeat(np.arange(len(b.ids), dtype=np.int64), np.diff(first)) if len(b.ids) > 1 else None
    keys = [doc << (BITS + 1) | (h >> _TOP).astype(np.int64), doc[at] << (BITS + 1) | (pairs >> _TOP).astype(np.int64)]
    many = np.zeros(BUCKETS, np.int64)
    for i in range(0, max(0, len(c) - 2), _SLICE):
        x = c[i:i + _SLICE + 2].astype(np.uint64)
        gram = ((x[:-2] * _CHARS[0] + x[1:-1] * _CHARS[1] + x[2:] * _CHARS[2]) >> _TOP).astype(np.int64)
        if of is None:  # one document, of any length
            many += np.bincount(gram, minlength=BUCKETS)
        else:
            r, last = of[i:i + len(gram)], of[i + 2:i + 2 + len(gram)]
            keys.append((r << (BITS + 1) | BUCKETS | gram)[r == last])
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    if of is None:
        some = np.flatnonzero(many)
        key, count = np.concatenate([key, some | BUCKETS]), np.concatenate([count, many[some]])
    return key >> (BITS + 1), (key & (2 * BUCKETS - 1)).astype(np.int32), count


def weights(b, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``edge, term, weight``: of document i the entries ``edge[i]`` to ``edge[i + 1]``."""
    row, term, count = terms(b)
    w = (1 + np.log(count)) * rarity[term]
    part = 2 * row + (term >= BUCKETS)
    w /= np.sqrt(np.bincount(part, w * w, 2 * len(b.ids)))[part]
    return np.searchsorted(row, np.arange(len(b.ids) + 1)), term, w.astype(np.float32)


def rarities(texts: DataFrame) -> np.ndarray:
    """Inverse document frequency of each term over all rows of ``texts`` (any number, text)."""
    def run(batches):
        n, seen = 0, np.zeros(2 * BUCKETS, np.int64)
        for b in blocks(batches):
            n += len(b.ids)
            seen += np.bincount(terms(b)[1], minlength=2 * BUCKETS)
        some = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(seen[some], n))], names=["term", "n"])
    rows = texts.mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(2 * BUCKETS + 1)
    n[rows["term"].to_numpy(np.int64)] = rows["n"].to_numpy()  # the number of rows at -1
    return np.log((1 + n[-1]) / (1 + n[:-1])) + 1


def _times(edge: np.ndarray, at: np.ndarray, w: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """The sparse rows (weights ``w`` at places ``at``) times ``dense``."""
    out = np.zeros((len(edge) - 1, dense.shape[1]), np.float32)
    for i in np.flatnonzero(np.diff(edge)).tolist():
        x, y = edge[i], edge[i + 1]
        out[i] = w[x:y] @ dense[at[x:y]]
    return out


def _singular(edge: np.ndarray, term: np.ndarray, w: np.ndarray, dims: int) -> np.ndarray:
    """The leading right singular vectors of the sparse rows, by subspace iteration from a fixed start."""
    by = np.argsort(term, kind="stable").astype(np.int32)
    edge_t, w_t = np.searchsorted(term[by], np.arange(2 * BUCKETS + 1)), w[by]
    row_t = np.repeat(np.arange(len(edge) - 1, dtype=np.int32), np.diff(edge))[by]
    del by
    v = np.random.default_rng(0).standard_normal((2 * BUCKETS, min(dims + 16, len(edge) - 1)), np.float32)
    for _ in range(3):
        q = np.linalg.qr(_times(edge, term, w, v))[0]
        del v  # half of what the driver holds here
        v = _times(edge_t, row_t, w_t, q)
    value, turn = np.linalg.eigh((v.T @ v).astype(np.float64))
    keep = np.flatnonzero(value > max(value[-1], 0) * 1e-6)[::-1][:dims]
    return v @ (turn[:, keep] / np.sqrt(value[keep])).astype(np.float32)


class Model:
    """Projections and labelled vectors; ``share`` is the share of label 1 among them."""

    def __init__(self, rarity: np.ndarray, edge: np.ndarray, term: np.ndarray, w: np.ndarray, shape: np.ndarray, y: np.ndarray, dims: int = DIMS):
        self.share = float(y.mean()) if len(y) else 0.5
        self.y = y.astype(np.float32)
        self.rarity = rarity
        if len(y):
            gram = shape.T.astype(np.float64) @ shape
            self.shape_basis = np.linalg.eigh(gram)[1][:, ::-1][:, :dims].astype(np.float32)
            self.basis = _singular(edge, term, w, dims)
            self.vectors = self._place(edge, term, w, shape)

    @staticmethod
    def _unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def _place(self, edge, term, w, shape) -> np.ndarray:
        return self._unit(np.hstack([self._unit(_times(edge, term, w, self.basis)), SHAPE * self._unit(shape @ self.shape_basis)]))

    def vectors_of(self, b) -> np.ndarray:
        """A vector of length 1 for each document of a block, or of 0 without features known from training."""
        return self._place(*weights(b, self.rarity), shapes(b))

    def score(self, b) -> np.ndarray:
        out = np.full(len(b.ids), self.share)
        if not len(self.y) or not len(b.ids):
            return out
        v = self.vectors_of(b)
        some = np.flatnonzero(v.any(axis=1))
        k = min(NEAREST, len(self.y))
        for part in np.array_split(some, 1 + len(some) // 512):
            near = v[part] @ self.vectors.T
            top = np.argpartition(-near, k - 1, axis=1)[:, :k]
            w = np.maximum(np.take_along_axis(near, top, axis=1), 0).astype(np.float64) ** SHARPNESS
            out[part] = np.where(w.any(axis=1), np.clip((w * self.y[top]).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-12), 0, 1), self.share)
        return out


def train(texts: DataFrame, docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int = MOST) -> Model:
    """Weights are made on the executors; the driver gets at most ``most`` rows of them, sparse, and of ``FEATURES`` floats.

    Document frequencies are those of ``texts`` (any number, text), which may hold rows that ``docs`` has no id for.
    """
    rarity = rarities(texts)
    sent = docs.sparkSession.sparkContext.broadcast(rarity)  # read by one job, which ends here

    def run(batches):
        for batch in batches:
            y = np.asarray(batch.column(2))
            done = 0
            for b in blocks([batch]):
                edge, term, w = weights(b, sent.value)
                cut = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
                yield pa.record_batch([pa.array(b.ids), pa.array([term[i:j].tobytes() for i, j in cut], pa.binary()), pa.array([w[i:j].tobytes() for i, j in cut], pa.binary()),
                                       pa.array([r.tobytes() for r in shapes(b).astype(np.float16)], pa.binary()), pa.array(y[done:done + len(b.ids)], pa.int32())],
                                      names=["doc_id", "term", "w", "shape", "label"])
                done += len(b.ids)
    rows = (training_rows(docs, labels, label, keep, most).mapInArrow(run, "doc_id bigint, term binary, w binary, shape binary, label int")
            .toArrow().sort_by([("doc_id", "ascending"), ("w", "ascending")]))
    y = rows.column("label").to_numpy()
    (term, off), (w, _), (shape, _) = (text_buffer(rows.column(c).combine_chunks()) for c in ("term", "w", "shape"))
    del rows
    sent.destroy()
    model = Model(rarity, off // 4, term[:off[-1]].view(np.int32), w[:off[-1]].view(np.float32),
                 shape[:2 * FEATURES * len(y)].view(np.float16).reshape(-1, FEATURES).astype(np.float32), y)
    del term, w, shape
    give_back()
    return model


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.lit(0).cast("bigint").alias("at"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))


def scores(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, held_out, score, predicted``; ``labels`` has ``doc_id`` and the label."""
    texts, docs = _texts(docs, text_col), id_text(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(texts, docs, labels, label, fold("doc_id", parts) != held))

    def run(batches):
        for b in blocks(batches):
            yield pa.record_batch([pa.array(b.ids), pa.array(model.value.score(b))], names=["doc_id", "score"])
    return (docs.mapInArrow(run, "doc_id bigint, score double")
            .select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns; rows without an id are scored too.

    No text is shuffled; the texts alone go to the Python workers, and no row comes back.
    """
    model = hold(docs.sparkSession.sparkContext.broadcast(train(_texts(docs, text_col), id_text(docs, id_col, text_col), labels, label, fold("doc_id", parts) != held)))

    def good(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            score = [model.value.score(b) for b in blocks([pa.record_batch([pa.array(np.zeros(len(t), np.int64)), t], names=["at", "t"])])]
            yield pa.array(np.concatenate(score) >= threshold if score else np.empty(0, bool))
            del t, score
        give_back()
    return docs.where(F.arrow_udf(good, "boolean")(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
