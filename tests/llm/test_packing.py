"""Packing: ids equal the tokenizer's, pieces rebuild the documents, sequences are gapless and few."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from residuum.llm import packing
from tests.conftest import SF_SMALL


def check(texts, rows, bound_over=1.02):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for d, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        for i in range(0, len(ids), packing.LENGTH):
            p = ids[i:i + packing.LENGTH]
            want[d, i // packing.LENGTH] = (i, len(p), zlib.crc32(np.array(p, "<u4").tobytes()))
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    assert got == want
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= packing.LENGTH
    least = -(-sum(r.length for r in rows) // packing.LENGTH)
    assert least <= len(at) <= max(least + 1, least * bound_over)


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    check([(r.doc_id, r.text) for r in df.collect()], packing.pack(df).collect(), 1.05)


def test_odd_texts(spark):
    texts = [(1, None), (2, ""), (3, "  \n"), (4, "l'été, DON'T stop!! ñandú Straße ÀÉÎ œuvre 12a3 x_y <|endoftext|> é İI ΣΣ  z"),
             (5, "word " * 5000), (6, "a" * 9000), (7, "a b \x1c c ''s 's"), (8, "\U0001f600 ok\tok\x0bok"), (9, "µ ª º × ÷ ÿ ß ẞ")]
    df = spark.createDataFrame([(None, "no id", 1)] + [(*t, 2) for t in texts], "doc_id long, text string, length int")
    check([(None, "no id"), *texts], packing.pack(df).collect(), 2)
    assert packing.pack(df.where("doc_id < 0")).collect() == []


def test_repeated_rows_are_packed_one_by_one(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3, "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert len(rows) == 3 and sorted(r.offset for r in rows) == [0, 4, 8]


def test_rows_without_an_id_are_all_packed(spark):
    df = spark.createDataFrame([(None, "a b c")] * 40 + [(1, None)], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert len(rows) == 41 and sum(r.length for r in rows) == 161


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_another_tokenizer_encodes_whole_texts(spark, name, tmp_path):
    import json
    import public_tokenizers
    rules = json.load(open(public_tokenizers.path(name)))
    if name.startswith("word"):
        rules["normalizer"] = None
    path = str(tmp_path / "tokenizer.json")
    json.dump(rules, open(path, "w"))
    tok = Tokenizer.from_file(path)
    texts = ["Hello World DON'T", "  two  spaces", "", "l'\u00e9t\u00e9 \u00c9"]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    for r in rows:
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def valid(lengths, out, length):
    fill = defaultdict(int)
    for n, s in zip(lengths, out):
        fill[s] += n
    assert len(out) == len(lengths) and max(fill.values()) <= length
    return len(fill)


@pytest.mark.parametrize("seed", range(3))
def test_shipped_settings_beat_best_fit(seed):
    rnd = np.random.default_rng(seed)
    lengths = sorted(rnd.integers(300, 1100, packing.SHARD // 4).tolist(), reverse=True)
    plain = len(packing.best_fit([], range(len(lengths)), lengths, packing.LENGTH))
    found = valid(lengths, packing.evolve(lengths, [], seed), packing.LENGTH)
    assert packing.least_bins(lengths) <= found < plain


def test_the_bound_is_never_above_the_optimum():
    rnd = np.random.default_rng(0)
    for _ in range(300):
        bins = [rnd.multinomial(20, rnd.dirichlet(np.ones(rnd.integers(1, 5)))) for _ in range(rnd.integers(1, 8))]
        lengths = [int(x) for b in bins for x in b if x]
        assert packing.least_bins(lengths, 20) == len(bins)  # every sequence is full: that many are needed
    assert packing.least_bins([11, 11, 11, 9], 20) == 3 and packing.least_bins([15, 15, 6], 20) == 3 and packing.least_bins([], 20) == 0
