"""The lexicon automaton against plain containment."""

import random

import pytest
from pyspark.sql import functions as F

from residuum.operators import classify as CL
from residuum.operators.automaton import Automaton, automaton_label
from tests.conftest import SF_SMALL


def plain(text, lexicon, other="Other"):
    low = (text or "").lower()
    scores = [(sum(len(w) for w in words if w in low), -i, label) for i, (label, words) in enumerate(lexicon.items())]
    best = max(scores)
    return best[2] if best[0] > 0 else other


def test_automaton_equals_containment(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcé☕ ") for _ in range(rng.randint(1, n)))
    lexicon = {f"L{i}": [word(6) for _ in range(25)] + ["ab", "ab", "zzz😀"] for i in range(16)}
    assert sum(map(len, lexicon.values())) > 400
    texts = [None, "", "x", "ABAB Éa☕", "zzz😀", "😀" * 5] + [word(60) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.l for r in CL.keyword_classify(df, lexicon, "t", "l").collect()}
    assert got == {i: plain(t, lexicon) for i, t in enumerate(texts)}
    machine = Automaton([w for v in lexicon.values() for w in v])
    hits = {r.i: {machine.words[k] for k in r.h} for r in df.where("t IS NOT NULL").select("i", machine.hits(F.lower("t")).alias("h")).collect()}
    assert hits == {i: {w for w in machine.words if w in t.lower()} for i, t in enumerate(texts) if t is not None}


def test_words_are_searched_in_the_runs_of_their_characters(spark, monkeypatch):
    from residuum.operators import automaton as A
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab]^-\\\\\n😀é ") for _ in range(rng.randint(1, n)))
    lexicon = {f"L{i}": [word(5) for _ in range(30)] for i in range(8)}
    texts = [None, "", "\n", "aXaYa"] + [word(40) + "#" + word(40) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    want = {i: plain(t, lexicon) for i, t in enumerate(texts)}
    walks = []
    monkeypatch.setattr(A.Automaton, "hits", lambda self, text, hits=A.Automaton.hits: (walks.append(1), hits(self, text))[1])
    labels = lambda: {r.i: r.l for r in df.select("i", automaton_label(F.col("t"), lexicon, "Other").alias("l")).collect()}
    assert labels() == want and not walks                   # a search costs less than a walk
    monkeypatch.setattr(A, "MAX_SEARCHED", 100)
    assert labels() == want and walks


def test_both_ways_agree_on_a_short_lexicon(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    lexicon = {"a": ["the", "tion", "he"], "b": ["und", "re"], "c": ["there", ""], "d": ["zq"]}
    out = docs.select(CL.keyword_label(F.col("text"), lexicon).alias("x"), automaton_label(F.col("text"), lexicon, "Other").alias("y"))
    assert out.where("x <> y").count() == 0


def test_size_is_checked_and_the_plan_is_map_only(spark):
    with pytest.raises(ValueError):
        Automaton(["word" * 100], max_cells=100)
    words = {"a": [f"word{i}" for i in range(500)]}
    p = CL.keyword_classify(spark.range(3).select(F.col("id").cast("string").alias("t")), words, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in p and "Join" not in p and "Python" not in p
