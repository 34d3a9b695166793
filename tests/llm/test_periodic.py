"""Periodic runs against a search of every period, and the registered query against a plain version of its contract."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from residuum.llm import periodic as P
from residuum.llm import queries
from residuum.session import shared_path


def plain_runs(w, least=6, exponent=4):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, exponent * q) and all(any(w[s + j] != w[s + j + r] for j in range(size - r)) for r in range(1, q)):
                out.append((s, size, q))
    return sorted(out)


def test_runs_of_random_words():
    rng = random.Random(7)
    for _ in range(600):
        k, n = rng.choice([1, 2, 3, 5, 20]), rng.randrange(70)
        w = [rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.5 and n > 8:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // 3))
            w = w[:a] + [w[a + i % p] for i in range(n - a)]
        for exponent, least in ((4, 6), (3, 6), (2, 2), (5, 9)):
            assert [tuple(r) for r in P.document_runs(w, least, exponent).tolist()] == plain_runs(w, least, exponent), w


def test_trees_answer_extensions():
    rng = random.Random(3)
    for _ in range(50):
        x = [rng.randint(1, 3) for _ in range(rng.randint(2, 40))]
        n = len(x) + 1
        ext = P.Extensions(*P.leaf_tour(P.suffix_tree([*x, 0]), n))
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
        got = ext(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
        s = [*x, 0]
        for (a, b), g in zip(pairs, got):
            want = 0
            while max(a, b) + want < n and s[a + want] == s[b + want]:
                want += 1
            assert g == want


def test_long_period_and_cuts():
    """A long text whose only run is a long one: the cuts keep it whole, and the rest is cut away."""
    rng = random.Random(1)
    prose = [rng.randrange(400) for _ in range(12000)]
    w = prose[:5000] + [prose[5000 + i % 700] for i in range(3300)] + prose[9000:]
    assert [tuple(r) for r in P.document_runs(w, 6, 4).tolist()] == plain_runs(w)
    kept = sum(b - a for a, b in P.stretches(np.array(w) + 1, 6, 4))
    assert 3300 <= kept < 4000


def answer(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
            sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_registered_query_on_odd_texts(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "a", "a " * 5, "a " * 6, "a\x0bb\x0ca b\ra\nb a b", "é \u2028 " * 9, "x" * 70000 + " y" * 400,
             "ab ab ab ab cd " * 4 + "A a A a A a A a A"]
    texts += [" ".join(rng.choice("abcd") for _ in range(rng.randrange(120))) for _ in range(150)]
    rows = [(i - 2, t) for i, t in enumerate(texts)] + [(None, "b c " * 6), (5, "repeated id " * 7), (5, "repeated id " * 7), (2**40, "q r s " * 30)]
    assert any(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows[10:])
    folder = shared_path(spark, "test-periodic")
    spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, runs int, start string").write.parquet(f"{folder}/documents.parquet")
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, folder).collect()]
    assert sorted(got, key=repr) == sorted((answer(*r) for r in rows), key=repr)


def test_empty_table(spark):
    out = P.find_runs(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "n_words", "runs", "collapsed"]
