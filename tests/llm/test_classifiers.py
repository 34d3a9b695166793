"""The trained scores against plain versions: dense matrices, explicit loops, every cosine and every vote."""

import random

import numpy as np
import pytest

from residuum.llm import quality, toxicity
from residuum.llm.textops import Block
from tests.llm.test_operators import low

LETTERS = "abcdefghij klmn", "абвгдежз ийкл", "aé漢b字c 😀de"


def block(texts):
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return Block(np.arange(len(texts)), np.frombuffer(b"".join(data), np.uint8), off)


def texts(seed, n):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(LETTERS[i % 3]) for _ in range(rnd.choice([0, 1, 3, 4, 5, 40, 400]))) for i in range(n)]


def grams(text):
    t = low(text)
    return {t[i:i + n] for n in toxicity.ORDERS for i in range(len(t) - n + 1)}


def buckets(text):
    """The buckets of a text's n-grams, each hashed as a text of its own."""
    return sorted({int(x) for g in grams(text) for x in next(toxicity.present(block([g])))})


def test_ngrams_are_characters_and_stay_inside_a_text():
    some = texts(1, 60)
    for t, got in zip(some, toxicity.present(block(some))):
        assert got.tolist() == buckets(t), t
    assert len(next(toxicity.present(block(["абвг"])))) == 1  # four letters of two bytes are one n-gram


def plain_toxicity(rows, y, shift, new):
    """Ratios and gradient steps over a dense matrix of the features that tell the labels apart."""
    every = sorted({g for r in rows for g in r})
    x = np.array([[g in r for g in every] for r in rows], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    p, q = x[y == 1].sum(axis=0), x[y == 0].sum(axis=0)
    share = (p + q) / len(y)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    ratio = np.where(abs(p / n1 - q / n0) > toxicity.APART * error, np.log((p + 1) / (n1 + 2) / ((q + 1) / (n0 + 2))), 0)
    x *= ratio
    w = np.zeros(len(every) + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, toxicity.STEPS + 1):
        g = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))) - y
        grad = np.append(x.T @ g / len(y) + toxicity.DECAY * w[:-1], g.mean())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        w = w - 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-10)
    z = [sum(w[i] * ratio[i] for i, g in enumerate(every) if g in r) + w[-1] + shift for r in new]
    return 1 / (1 + np.exp(-np.array(z)))


@pytest.mark.parametrize("shift", [0.0, -1.5])
def test_toxicity_equals_a_dense_regression(shift):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
    y = np.array([i % 3 == 0 for i in range(90)], int)
    made = [" ".join(rnd.choice(words[:24] if label else words[16:]) for _ in range(20)) for label in y]
    rows = list(toxicity.present(block(made)))
    model = toxicity.Model(rows, y, shift)
    assert (model.weight != 0).sum() > 20
    new = list(toxicity.present(block(texts(3, 20) + [" ".join(rnd.choice(words) for _ in range(9)) for _ in range(40)])))
    want = plain_toxicity([set(r.tolist()) for r in rows], y, shift, [set(r.tolist()) for r in new])
    assert np.allclose([model.score(r) for r in new], want, atol=1e-4)
    assert np.ptp(want) > 0.2


def dense(b, rarity):
    edge, term, w = quality.weights(b, rarity)
    out = np.zeros((len(b.ids), 2 * quality.BUCKETS))
    for i in range(len(b.ids)):
        for k in range(edge[i], edge[i + 1]):
            out[i, term[k]] = w[k]
    return out


def test_quality_equals_every_cosine_and_vote():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(1 + i % 7)) for i in range(300)]
    made = [" ".join(rnd.choice(words[(i % 2) * 100:][:200]) for _ in range(rnd.randint(1, 60))) for i in range(70)]
    y = np.array([i % 2 for i in range(70)])
    b, new = block(made), block(made[:10] + texts(5, 30))
    rarity = np.random.default_rng(1).uniform(1, 3, 2 * quality.BUCKETS)
    model = quality.Model(rarity, *quality.weights(b, rarity), quality.shapes(b), y, dims=80)  # as many as there are rows: the space loses nothing
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    base = np.linalg.svd(dense(b, rarity), full_matrices=False)[2]
    shape = np.linalg.svd(quality.shapes(b).astype(float), full_matrices=False)[2][:80]

    def place(x):
        return unit(np.hstack([unit(dense(x, rarity) @ base.T), quality.SHAPE * unit(quality.shapes(x) @ shape.T)]))
    train, vectors = place(b), place(new)
    got = model.score(new)
    for i, v in enumerate(vectors):
        near = sorted(((float(v @ t), int(label)) for t, label in zip(train, y)), reverse=True)[:quality.NEAREST]
        votes = [(max(c, 0) ** quality.SHARPNESS, label) for c, label in near]
        total = sum(w for w, _ in votes)
        want = sum(w * label for w, label in votes) / total if v.any() and total else y.mean()
        assert abs(got[i] - want) < 5e-3, (i, got[i], want)
