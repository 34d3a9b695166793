"""Toxicity by a character n-gram linear classifier with naive Bayes scaled features.

Features are the character n-grams (code points after lower-casing A-Z, in any
script, ``ORDERS`` long) that occur in a text, hashed to ``BUCKETS``; each present feature has the value of
its smoothed log-count ratio between the labels, and 0 if its shares under the two
labels are not ``APART`` standard errors apart (else the noise of a long text
drowns what it says). A logistic regression over these values is fitted by
gradient steps.

Training rows: at most ``MOST`` labelled documents of each label outside the
held-out fold, the first in an order by hash; whole texts. The intercept is
shifted by what the two limits change in the labels' odds.

Cases: null and empty texts, and those shorter than an n-gram, have no features
and score by the intercept; texts of any length are read whole; repeated rows score
alike; an empty table gives no rows; other columns, under any names, are not read; null
labels and labels of unknown documents are left out; of repeated labels the
largest counts; with fewer than two labels the score is 0 or 1 as the only label
says, and 0.5 without any.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from residuum.llm.quality import _characters, fold, training_rows
from residuum.llm.staging import id_text
from residuum.llm.textops import LOWER, blocks

ORDERS = (4, 5)
BUCKETS = 1 << 18
MOST = 2000
APART = 4
STEPS = 60
DECAY = 1e-3
_MUL = np.uint32(0x9E3779B1)


def present(b):
    """For each document of a block, the sorted buckets of the n-grams that occur in it."""
    data, off = _characters(LOWER[b.data], b.off)
    data = data.astype(np.uint32)
    grams = []
    for size in ORDERS:
        h = np.zeros(max(0, len(data) - size + 1), np.uint32)
        for k in range(size):
            h = (h ^ data[k:k + len(h)]) * _MUL
            h ^= h >> np.uint32(15)
        grams.append(h & np.uint32(BUCKETS - 1))
    mark = np.zeros(BUCKETS, dtype=bool)
    for i in range(len(b.ids)):
        low, high = int(off[i]), int(off[i + 1])
        parts = [g[low:max(low, high - size + 1)] for g, size in zip(grams, ORDERS)]
        if high - low > 4 * BUCKETS // 100:
            for p in parts:
                mark[p] = True
            out = np.flatnonzero(mark).astype(np.int32)
            mark[out] = False
        else:
            out = np.unique(np.concatenate(parts)).astype(np.int32)
        yield out


class Model:
    def __init__(self, rows: list[np.ndarray], y: np.ndarray, shift: float = 0.0):
        self.bias = 0.0
        self.ratio = self.weight = np.zeros(BUCKETS, np.float32)
        if not len(y):
            return
        if y.min() == y.max():
            self.bias = np.inf if y[0] else -np.inf
            return
        n1, n0 = int(y.sum()), int((1 - y).sum())
        size = np.array([len(r) for r in rows])
        lab = np.repeat(y.astype(bool), size)
        flat = np.concatenate(rows)
        p, q = (np.bincount(flat[m], minlength=BUCKETS).astype(np.float64) for m in (lab, ~lab))
        share = (p + q) / (n1 + n0)
        apart = (p / n1 - q / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
        self.ratio = np.where(np.abs(apart) > APART, np.log(((p + 1) / (n1 + 2)) / ((q + 1) / (n0 + 2))), 0).astype(np.float32)
        rows = [r[self.ratio[r] != 0] for r in rows]
        size = np.array([len(r) for r in rows])
        flat, ends = np.concatenate(rows), np.cumsum(size)
        w, bias, m, v = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
        for t in range(1, STEPS + 1):
            cut = np.concatenate([[0], np.cumsum((w * self.ratio)[flat])])
            z = cut[ends] - cut[ends - size] + bias
            g = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y) / len(y)
            grad = np.append(np.bincount(flat, np.repeat(g, size), BUCKETS) * self.ratio + DECAY * w, g.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            step = 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-10)
            w, bias = w - step[:-1], bias - step[-1]
        self.weight, self.bias = (w * self.ratio).astype(np.float32), bias + shift

    def score(self, r: np.ndarray) -> float:
        z = self.bias + float(self.weight[r].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def train(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: int = MOST) -> Model:
    def run(batches):
        for batch in batches:
            y = np.asarray(batch.column(2))
            done = 0
            for b in blocks([batch]):
                yield pa.record_batch([pa.array(b.ids), pa.array([r.tobytes() for r in present(b)], pa.binary()),
                                       pa.array(y[done:done + len(b.ids)], pa.int32())], names=["doc_id", "x", "label"])
                done += len(b.ids)
    rows = training_rows(docs, labels, label, keep, (most, most)).mapInArrow(run, "doc_id bigint, x binary, label int").toPandas().sort_values("doc_id")
    y = rows["label"].to_numpy()
    all_y = {r["y"]: r["n"] for r in labels.where(F.col(label).isNotNull() & keep).groupBy(F.col(label).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = lambda a, b: np.log((a + 1) / (b + 1))
    shift = odds(all_y.get(1, 0), all_y.get(0, 0)) - odds(int(y.sum()), int((1 - y).sum()))
    return Model([np.frombuffer(x, np.int32) for x in rows["x"]], y, shift)


def scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, held_out, score, predicted``; ``labels`` has ``doc_id`` and the label."""
    docs = id_text(docs, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, fold("doc_id", parts) != held))

    def run(batches):
        for b in blocks(batches):
            yield pa.record_batch([pa.array(b.ids), pa.array([model.value.score(r) for r in present(b)])], names=["doc_id", "score"])
    return (docs.mapInArrow(run, "doc_id bigint, score double")
            .select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))
