"""Each stage of the pipeline against brute force on what the stage before it kept."""

import re

import corpus_pipeline
from residuum.llm import quality
from residuum.llm.staging import stage, table
from tests.conftest import SF_SMALL
from tests.llm.test_operators import brute_groups, low
from tests.llm.test_packing import check


def test_stages(spark):
    docs = table(spark, SF_SMALL, "documents")
    columns = docs.columns
    kept = []
    for name, step in corpus_pipeline.STAGES:
        kept.append([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        docs = stage(step(spark, docs, SF_SMALL), "test-pipeline")
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
    given, good, distinct, unlike, clean = kept
    scored = quality.scores(table(spark, SF_SMALL, "documents"), table(spark, SF_SMALL, "labels")).where("predicted = 1").collect()
    assert sorted(d for d, _ in good) == sorted(r.doc_id for r in scored) and len(good) < len(given)
    largest = {}
    for d, t in good:
        largest[low(t)] = max(d, largest.get(low(t), d))
    assert sorted(d for d, _ in distinct) == sorted(largest.values())
    groups = brute_groups(distinct)
    assert sorted(d for d, _ in unlike) == sorted(d for d, (_, c) in groups.items() if d == c)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = set()
    for r in table(spark, SF_SMALL, "benchmark").collect():
        w = re.findall(word, low(r.text))
        windows |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}

    def leaks(t):
        w = re.findall(word, low(t))
        return any(tuple(w[k:k + n]) in windows for n in sizes for k in range(len(w) - n + 1))
    assert sorted(d for d, _ in clean) == sorted(d for d, t in unlike if not leaks(t))
    check(clean, docs.collect(), 1.1)
