"""Operators against brute force on odd inputs: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import hashlib
import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.llm import chat, content_sort, decontaminate, graph, jaccard, quality, secrets, toxicity
from residuum.session import shared_path
from tests.conftest import SF_MID, SF_SMALL


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def frame(spark, rows):
    """Documents with an id that is null, and columns named like those the operators use inside."""
    rows = [(None, "no id", 1, "k", 2)] + [(d, t, 1, "k", 2) for d, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, key string, row int").repartition(3)


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_secrets(spark):
    rules = {"assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
             "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24)}
    texts = [(1, None), (2, ""), (3, "é😀 Password: 'abc123' x"), (4, "secret: token: abcdefgh"), (5, "AKIA" * 6 + " AKIAABCD"),
             (6, "token=" + "ab12" * 9), (7, "x" * 50000 + " api_key = \"zzzzzz\"" + "f" * 24), (8, "PASSWD=a api_key:b" + "c" * 30),
             (9, "token==abcde token=abc"), (3, "é😀 Password: 'abc123' x")]
    folder = shared_path(spark, "test-ledger")
    got = {r.doc_id: r for r in secrets.findings_by_document(frame(spark, texts), folder).collect()}
    for d, t in texts:
        spans = sorted((m.start(), i, k, m.end()) for i, (k, (p, g, n)) in enumerate(rules.items()) for m in re.finditer(p, t or "") if len(m[g]) >= n)
        want = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        assert got[d].spans == want and got[d].base_sha256 == sha(want), d
        assert got[d].n_hex == sum(k == "hex" for _, _, k, _ in spans)
    # the ledger is complete now: only new blobs and new rule versions are scanned
    scanned = spark.read.parquet(f"{folder}/scanned")
    before = scanned.count()
    assert before == len({t or "" for _, t in texts}) * 3
    secrets.scan(frame(spark, [*texts, (20, "new token=abcdefgh")]), folder)
    assert spark.read.parquet(f"{folder}/scanned").count() == before + 3
    newer = (*secrets.BASE[:2], secrets.Rule("hex", r"[0-9a-f]{30,}", version=2))
    secrets.scan(frame(spark, texts), folder, newer)
    assert spark.read.parquet(f"{folder}/scanned").count() == before + 3 + before // 3


def test_secrets_of_every_version_of_one_id(spark):
    texts = ["token=abcdef1", "token=zzzzzz2", "no secret", "x token=yyyyyy3", "token=zzzzzz2"]
    rows = [(1, t) for t in texts] + [(2, "x token=yyyyyy3")]
    folder = shared_path(spark, "test-ledger-versions")
    want = sorted([(1, "assign:0:13")] * 3 + [(1, ""), (1, "assign:2:15"), (2, "assign:2:15")])
    for _ in range(2):
        assert sorted((r.doc_id, r.spans) for r in secrets.findings_by_document(frame(spark, rows), folder).collect()) == want
    assert sorted(r.blob for r in spark.read.parquet(f"{folder}/scanned").where("rule = 'hex@1'").collect()) == sorted(map(sha, set(texts)))


def test_secrets_marks_only_blobs_whose_text_was_read(spark, monkeypatch):
    folder = shared_path(spark, "test-ledger-read")
    rows = [(1, "token=abcdef1"), (2, "token=zzzzzz2")]
    stage = secrets.stage
    monkeypatch.setattr(secrets, "stage", lambda df, name: stage(df.unionByName(df.limit(1).withColumn("blob", F.lit("gone"))) if name == "blob-todo" else df, name))
    secrets.scan(frame(spark, rows), folder)
    assert {r.blob for r in spark.read.parquet(f"{folder}/scanned").collect()} == {sha(t) for _, t in rows}


def exact_cases():
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["Hot text", "hot TEXT", "hot text"])) for i in range(100, 400)]
    rows += [(1, None), (2, ""), (3, "É"), (4, "é"), (5, "long " * 20000), (6, "LONG " * 20000), (7, "x"), (7, "x"), (8, "K"), (9, "K")]
    return rows


def test_exact_dedup(spark):
    rows = exact_cases()
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    got = content_sort.duplicate_groups(frame(spark, rows)).where("doc_id IS NOT NULL").collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    texts = dict(rows)
    for r in got:
        t = low(texts[r.doc_id])
        assert (r.keep_id, r.group_size, r.text_sha256) == (max(groups[t]), len(groups[t]), sha(t))
    assert sorted(r.doc_id for r in got if r.kept) == sorted(max(g) for g in groups.values())
    stay = content_sort.deduplicated(frame(spark, rows))
    assert stay.columns == ["doc_id", "text", "n", "key", "row"]
    assert sorted(r.doc_id for r in stay.collect() if r.doc_id is not None) == sorted(max(g) for g in groups.values())
    assert content_sort.duplicate_groups(frame(spark, []).where("false")).collect() == []


def brute_groups(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("small_list", [32, 3])
def test_jaccard_groups(spark, monkeypatch, small_list):
    monkeypatch.setattr(jaccard, "SMALL_LIST", small_list)
    if small_list == 3:  # and the way beyond the broadcast
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "One  TWO"), (5, "a b c d e f g"), (6, "a b c d e f g h"), (7, " \n"), (8, "z " * 3000), (9, "z " * 50), (5, "a b c d e f g")]
    doc = 10
    for _ in range(6):
        base = [rnd.choice(words) for _ in range(rnd.randint(40, 160))]
        for _ in range(25):  # near copies at all distances, and chains
            copy = list(base)
            for _ in range(rnd.randint(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            if rnd.random() < 0.2:
                base = copy
            rows.append((doc, " ".join(copy)))
            doc += 1
    want = brute_groups(rows)
    got = jaccard.near_duplicate_groups(frame(spark, rows)).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id
    assert jaccard.near_duplicate_groups(frame(spark, []).where("false")).collect() == []
    with pytest.raises(ValueError):
        jaccard.near_duplicate_groups(frame(spark, rows), percent=60)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(1000, 1200)] + [(1, rnd.randint(2, 400)) for _ in range(200)] + [(5000, 5000)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(1000, 1201)}) == 1 and got[1000] != got[1]
    assert {got[b] for _, b in edges[200:400]} == {got[1]} or all(got[b] == got[1] for a, b in edges if a == 1)
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_decontamination(spark):
    rnd = random.Random(4)
    item = [f"q{i % 17}é" for i in range(30)]
    items = [(1, " ".join(item)), (2, "Tiny item!"), (3, None), (4, "..."), (5, " ".join(item)), (10, "same same same same same same same same same same same")]
    docs = [(1, None), (2, "-"), (3, "so a TINY, item here"), (4, "pad " * 7 + ", ".join(item[3:14]).upper().replace("É", "é") + " end"), (5, " ".join(item[:9])),
            (6, "same " * 40), (7, " ".join(rnd.choice(item) for _ in range(400))), (8, "x " * 9000 + " ".join(item) + " y" * 9000), (3, "so a TINY, item here")]
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = defaultdict(set)
    for i, t in items:
        w = re.findall(word, low(t))
        for k in range(max(1, len(w) - 9) if w else 0):
            wins[tuple(w[k:k + 10])].add(i)
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame([(*x, "n") for x in items], "item_id long, text string, fp string")).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _ in docs)
    texts = dict(docs)
    for r in got:
        w = re.findall(word, low(texts[r.doc_id]))
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                ids = wins.get(tuple(w[k:k + n]))
                if ids:
                    hit |= set(range(k, k + n))
                    found |= ids
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (
            len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)), r.doc_id


@pytest.mark.parametrize("op, label, least", [(toxicity, "toxic", 0.9), (quality, "quality", 0.9)])
def test_classifiers(spark, op, label, least):
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = op.scores(docs, labels).collect()
    assert len(rows) == docs.count()
    y = {r.doc_id: r[label] for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in y]
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) >= least
    odd = frame(spark, [(1, None), (2, ""), (3, "a"), (4, "word " * 30000), (4, "word " * 30000)])
    got = op.scores(odd, labels.withColumn("text", F.lit("x"))).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 4, 4] and all(0 <= r.score <= 1 for r in got)
    none = op.scores(odd, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}
    assert op.scores(odd.where("false"), labels).collect() == []


def test_quality_filter_keeps_columns_and_rows_without_id(spark):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    scored = {r.doc_id for r in quality.scores(docs, labels).where("predicted = 1").collect()}
    kept = quality.accepted(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == scored


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrst", "абвгдежзиклмнопрстуф"])
def test_quality_tells_words_of_the_same_shape_apart(spark, letters):
    rnd = random.Random(8)
    vocabulary = [["".join(rnd.choice(letters) for _ in range(3 + i % 6)) for i in range(240)] for _ in range(2)]
    common = vocabulary[0][:120]  # half of the words stand in good and bad texts alike
    rows, labels = [], []
    for d in range(400):
        good = d % 2
        own = vocabulary[good][120:]
        # the same lengths at the same places: only which words they are tells the labels apart
        rows.append((d, " ".join(rnd.choice((own, common)[k % 3 == 0][k % 6::6]) for k in range(60))))
        labels.append((d, good))
    got = quality.scores(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int"), threshold=0.5).where("held_out").collect()
    assert len(got) > 50 and np.mean([r.predicted == r.doc_id % 2 for r in got]) >= 0.9


def viterbi(model, rows):
    score = model.begin + model.emission(rows[:1, 1:])[0]
    back = []
    for i in range(1, len(rows)):
        reach = score[:, None] + model.go[rows[i, 0]]
        back.append(reach.argmax(0))
        score = reach.max(0) + model.emission(rows[i:i + 1, 1:])[0]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_chat_decoding_in_chunks_equals_plain_viterbi(spark):
    rnd = random.Random(6)
    rows = [(c, t, " ".join(["w"] * rnd.randint(0, 120)), rnd.choice(["user", "assistant", None])) for c in range(3) for t in range(300)]
    df = spark.createDataFrame([(None, 0, "x", "user"), (7, None, None, "odd"), *rows], "conv_id long, turn long, text string, role string")
    out = chat.format_turns(df).collect()
    assert len(out) == len(rows) + 1
    turns = df.where("conv_id < 3").selectExpr("conv_id AS conv", "turn", "xxhash64(text) AS tie", "text", "role")
    lines = chat.lines_of_turns(turns)
    model = chat.train(chat.lines_of_turns(df.where("conv_id IS NOT NULL").selectExpr("conv_id AS conv", "coalesce(turn, -1) AS turn", "xxhash64(coalesce(text, '')) AS tie", "coalesce(text, '') AS text", "role")))
    obs = defaultdict(list)
    for r in lines.orderBy("conv", "turn", "line").collect():
        obs[r.conv].append((r.opens, r.mark, r.size, r.asks))
    got = defaultdict(list)
    for r in sorted((r for r in out if r.conv_id < 3), key=lambda r: (r.conv_id, r.turn)):
        got[r.conv_id].append(chat.ROLES.index(r.role))
    for c, o in obs.items():
        assert got[c] == viterbi(model, np.array(o))


def test_chat_held_out_and_transcripts(spark):
    conv = spark.read.parquet(f"{SF_MID}/conversations.parquet")
    held = quality.fold("conv_id", 5) == 0
    out = chat.format_turns(conv, keep=~held)
    assert out.count() == conv.count()
    assert out.where(held).agg(F.avg((F.col("role") == F.col("given_role")).cast("int"))).first()[0] > 0.85
    raw = spark.createDataFrame([(1, "User: hi\nhow?\n\nAssistant: fine\n\nHuman: ok"), (2, None)], "doc_id long, text string")
    got = [(r.id, r.role, r.rendered) for r in chat.parse_transcripts(raw, chat.Model()).orderBy("id", "turn").collect()]
    assert got == [(1, "user", "<|user|>\nhi\nhow?\n<|end|>\n"), (1, "assistant", "<|assistant|>\nfine\n<|end|>\n"), (1, "user", "<|user|>\nok\n<|end|>\n")]


def test_only_texts_go_to_the_workers_that_accept_documents(spark):
    docs = frame(spark, [(d, f"some words {d} of a text") for d in range(40)] + [(90, None), (91, "")])
    labels = spark.createDataFrame([(d, float(d % 2)) for d in range(40)], "doc_id long, quality double")
    kept = quality.accepted(docs, labels, threshold=0.4)
    assert "MapInArrow" not in kept._jdf.queryExecution().executedPlan().toString()
    want = quality.scores(docs, labels, threshold=0.4).where("predicted = 1").select("doc_id")
    assert kept.columns == docs.columns and want.count() > 0
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(r.doc_id for r in want.collect())


def test_postings_are_deleted_before_sets_are_cut(spark, monkeypatch):
    words = [f"w{k}" for k in range(60)]
    texts = [(d, " ".join(words[:50] + [f"x{d}"] + words[50:])) for d in range(40)] + [(90, "other words " * 4), (91, None)]
    seen, postings, write = [], [], jaccard.stage

    def record(df, name):
        seen.append((name, sum(os.path.exists(p) for p in postings)))
        out = write(df, name)
        postings.extend([out._stage_path] if name == "jaccard-postings" else [])
        return out
    monkeypatch.setattr(jaccard, "stage", record)
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicate_groups(frame(spark, texts)).collect()}
    assert got == {d: 0 if d < 40 else d for d, _ in texts}
    assert {n for name, n in seen if name in ("jaccard-segments", "jaccard-overlaps")} == {0}
