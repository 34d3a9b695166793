"""Repeat finders against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from residuum.llm import recompression, suffix
from tests.conftest import SF_SMALL


def brute(units_by_doc, size):
    """Mask of removed units for each document."""
    seen, gone = set(), {}
    for doc in sorted(units_by_doc):
        u = units_by_doc[doc]
        gone[doc] = [False] * len(u)
        for i in range(len(u) - size + 1):
            w = tuple(u[i:i + size]) if isinstance(u, list) else u[i:i + size]
            if w in seen:
                gone[doc][i:i + size] = [True] * size
            else:
                seen.add(w)
    return gone


def sha(b):
    return hashlib.sha256(b).hexdigest()


def check_words(texts, rows):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in texts.items()}
    gone = brute(words, 20)
    for r in rows:
        keep = [w for w, g in zip(words[r.doc_id], gone[r.doc_id]) if not g]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(words[r.doc_id]), sum(gone[r.doc_id]), sha(" ".join(keep).encode())), r.doc_id


def check_bytes(texts, rows):
    data = {d: (t or "").encode() for d, t in texts.items()}
    gone = brute(data, 100)
    for r in rows:
        g = gone[r.doc_id]
        runs = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        kept = bytes(x for x, y in zip(data[r.doc_id], g) if not y)
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(g), sum(g), runs, sha(kept)), r.doc_id


def odd_texts():
    rnd = random.Random(5)
    few = ["a", "b", "ab", "é"]
    out = {1: None, 2: "", 3: "x " * 300, 4: "x " * 150 + "y " * 40 + "x " * 90, 5: "x y " * 200, 6: " \n\t", 7: "word"}
    for d in range(10, 60):
        out[d] = " ".join(rnd.choice(few) for _ in range(rnd.randint(1, 200)))
    passage = " ".join(rnd.choice("lorem ipsum dolor sit amet consectetur".split()) + str(rnd.randint(0, 40)) for _ in range(60))
    for d in range(60, 90):
        a = rnd.randint(0, 200)
        out[d] = " ".join(str(rnd.random()) for _ in range(rnd.randint(0, 30))) + " " + passage[a:a + rnd.randint(50, 400)] + " tail" + str(d)
    out[90] = out[89]
    out[91] = " ".join(str(rnd.randint(0, 3000)) for _ in range(30000))
    return out


@pytest.mark.parametrize("op, check", [(recompression.without_repeats, check_words), (suffix.without_repeats, check_bytes)])
def test_odd_texts(spark, op, check):
    texts = odd_texts()
    rows = [(None, "no id", "x")] + [(d, t, "x") for d, t in texts.items()] + [(90, texts[90], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(5)
    got = op(df).collect()
    assert sorted(r.doc_id for r in got) == sorted([*texts, 90])
    check(texts, got)
    assert op(df.where("doc_id < 0")).collect() == []


@pytest.mark.parametrize("op, check", [(recompression.without_repeats, check_words), (suffix.without_repeats, check_bytes)])
def test_given_documents(spark, op, check):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("places", F.lit(1))
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    check(texts, op(df).collect())


def test_multikey_order():
    import numpy as np
    w = np.random.default_rng(1).integers(0, 3, (500, 4)).astype(np.uint64)
    assert (suffix.multikey_order(w) == np.lexsort(w.T[::-1])).all()


def test_windows_are_compared_in_suffix_order(monkeypatch):
    """Random suffixes against brute force; with the order of the rows as they come instead of the sorted one, repeats are missed."""
    import numpy as np
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 3), bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 4))).rjust(rnd.randint(4, 60), b"x"),
             bytes(rnd.choice(b"ab\0") for _ in range(rnd.randint(0, 4))).ljust(rnd.randint(4, 60), b"y")) for _ in range(400)]
    rows.sort(key=lambda r: r[0])
    lead, before, after = zip(*rows)
    import pyarrow as pa
    a, n_a = suffix._side(pa.array(after, pa.binary()), False)
    b, n_b = suffix._side(pa.array(before, pa.binary()), True)
    seen, want = set(), np.zeros((len(rows), 65), bool)
    for i, (x, p, q) in enumerate(rows):
        for k in range(65):
            if len(p) >= k and len(q) >= 64 - k:
                w = (x, k, p[len(p) - k:], q[:64 - k])
                want[i, k] = w in seen
                seen.add(w)
    number = np.array(lead)
    assert want.any() and (suffix.later_in_order(number, a, b, n_a, n_b) == want).all()
    monkeypatch.setattr(suffix, "multikey_order", lambda w: np.arange(len(w)))
    assert not (suffix.later_in_order(number, a, b, n_a, n_b) == want).all()


def test_rows_held_over_and_whole_repeats(monkeypatch):
    """Tiny chunks: leads that cross batches, rows equal as a whole, one lead with many rows."""
    import pyarrow as pa
    monkeypatch.setattr(suffix, "_ROWS", 8)
    rnd = random.Random(3)
    rows = []
    sides = ["".join(rnd.choice("ab") for _ in range(64)) for _ in range(4)]
    for doc in range(300):
        p, q = rnd.choice(sides)[rnd.choice([24, 61, 64]):], rnd.choice(sides)[:rnd.choice([64, 50, 30])]
        if len(p) + len(q) >= 64:
            rows.append((rnd.choice(["l" * 36, "m" * 36, "n" * 36]), doc, 0, p, q))
    rows.sort()
    batches = [pa.record_batch([pa.array([r[0].encode() for r in part], pa.binary()), pa.array([r[1] for r in part]), pa.array([r[2] for r in part]),
                                pa.array([r[3].encode() for r in part], pa.binary()), pa.array([r[4].encode() for r in part], pa.binary())],
                               names=["lead", "doc_id", "first", "before", "after"]) for part in (rows[i:i + 11] for i in range(0, len(rows), 11))]
    got = set()
    for out in suffix._compare(iter(batches)):
        for r in out.to_pylist():
            got |= {(r["doc_id"], at) for at in range(r["low"], r["high"] - 99)}
    seen, want = set(), set()
    for x, doc, _, p, q in rows:
        text = p + x + q
        for at in range(len(text) - 99):
            # a window is known by its text and the place of its lead in it
            w = (text[at:at + 100], len(p) - at)
            if w in seen:
                want.add((doc, at))
            seen.add(w)
    assert want and got == want


@pytest.mark.parametrize("op", [recompression.without_repeats, suffix.without_repeats])
def test_an_id_with_two_texts_raises(spark, op):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (2, text), (2, text + " more")], "doc_id long, text string")
    with pytest.raises(Exception, match="two different texts"):
        op(df).collect()
