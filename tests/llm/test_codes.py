"""Codes of whole words, and words that a polynomial hash modulo 2^64 takes for equal."""

import hashlib
import random

import numpy as np

from residuum.llm import jaccard, recompression
from residuum.llm import textops as X


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def pair():
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(31)]
    return " ".join(words[:15] + [a] + words[16:]), " ".join(words[:15] + [b] + words[16:])


def codes(words):
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return X.word_codes(data, X.find_words(data, np.array([0, len(data)]), X.SPACE_SPLIT)).tolist()


def test_codes_depend_on_the_word_alone():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab\u00e9") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 400]))) for _ in range(500)]
    words += ["a" * n for n in range(1, 300)] + [thue_morse(n) for n in (64, 128, 256, 512, 1024, 2048)]
    words += [w.translate(str.maketrans("ab", "ba")) for w in words[-6:]]
    got = codes(words + words[::-1])
    assert got == got[::-1]
    assert len(set(got)) == len(set(words))
    assert codes([]) == []


def test_words_that_a_polynomial_hash_confuses(spark):
    a, b = pair()
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in jaccard.near_duplicate_groups(docs).collect()}
    assert groups == {1: 1, 2: 2, 3: 1}  # 22 of 32 shingles in common
    kept = {r.doc_id: (r.n_removed, r.kept_sha256) for r in recompression.without_repeats(docs).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert kept == {1: (0, sha(a)), 2: (0, sha(b)), 3: (31, sha(""))}
