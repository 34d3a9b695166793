"""Transcripts against a plain parser, empty tables, and the pipeline on odd rows with clashing columns."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from residuum.llm import chat, decontaminate, secrets
from residuum.llm.staging import stage, table
from residuum.session import shared_path
from tests.conftest import SF_SMALL
from tests.llm.test_operators import brute_groups, frame, low, viterbi


def observed(line):
    m = re.match(chat.MARKER, line, re.ASCII)
    mark = chat.ROLES.index(chat.MARKERS[m[1].lower()]) + 1 if m else 0
    return mark, sum(len(line) >= n for n in chat.LENGTHS), int(line.rstrip(" ").endswith("?"))


def plain_lines(pieces):
    """``(turn, role, text, opens, mark, size, asks)`` of the lines of a transcript's ``(turn, text, role)``."""
    out = []
    for turn, text, role in sorted(pieces, key=lambda p: -1 if p[0] is None else p[0]):
        parts = (text or "").split("\n")
        for i, t in enumerate(parts):
            if t.strip(" "):
                mark, *rest = observed(t)
                out.append((-1 if turn is None else turn, role, t, int(i == 0 or not parts[i - 1].strip(" ") or mark > 0), mark, *rest))
    return out


def plain_model(transcripts):
    steps, emitted = {}, {}
    for lines in transcripts:
        before, first = None, True
        for _, role, _, opens, *seen in lines:
            r = chat.ROLES.index(role.lower()) if (role or "").lower() in chat.ROLES else None
            if r is not None:
                emitted[(r, *seen)] = emitted.get((r, *seen), 0) + 1
                if first or before is not None:
                    key = (None if first else before, r, opens)
                    steps[key] = steps.get(key, 0) + 1
            before, first = r, False
    return chat.Model([(*k, n) for k, n in steps.items()], [(*k, n) for k, n in emitted.items()])


def path_score(lines, model, roles):
    r, seen = [chat.ROLES.index(x) for x in roles], np.array([x[3:] for x in lines])
    emit = model.emission(seen[:, 1:])
    return model.begin[r[0]] + emit[0, r[0]] + sum(model.go[seen[i, 0], r[i - 1], r[i]] + emit[i, r[i]] for i in range(1, len(r)))


def plain_turns(lines, roles):
    out = []
    for (turn, given, t, _, mark, *_), role in zip(lines, roles):
        if not out or out[-1][0] != role or mark:
            out.append((role, turn, given, [], set()))
        out[-1][3].append(t)
        out[-1][4].add(turn)
    return [(role, f"<|{role}|>\n" + re.sub(chat.MARKER, "", "\n".join(t), flags=re.ASCII).strip(" ") + "\n<|end|>\n", turn, given, len(n)) for role, turn, given, t, n in out]


@pytest.mark.parametrize("chunk", [16, 4096])
def test_transcripts_equal_a_plain_parser(spark, monkeypatch, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rnd = random.Random(chunk)

    def text(role):
        lines = [" ".join(["wörd"] * rnd.randint(0, 40 if role == "assistant" else 8)) + rnd.choice(["", "?", "? "]) for _ in range(rnd.randint(1, 5))]
        return rnd.choice(["", "", "User: ", "### Assistant:\n", "human>"]) + "\n".join(lines)
    rows = [(c, t, text(r), r) for c in range(40) for t, r in enumerate(rnd.choice([["user", "assistant"] * 3, ["system", "user", "assistant", "assistant"]]))]
    rows += [(50, t, text("user"), rnd.choice(["User", "assistant", None, "odd"])) for t in range(400)]  # one conversation with most of the rows
    rows += [(51, 0, "\n".join(["a line?", "", "Bot: so"] * 1500), "user"), (52, None, None, None), (52, 0, "", "user"), (53, 0, " \n\n ", "user"), (54, None, "first", "user"), (54, 3, "x", "x")]
    columns = "conv_id long, turn long, text string, role string, chunk int, row string, line int, t string, before int, total int, number int"
    df = spark.createDataFrame([(*r, 1, "r", 2, "t", 3, 4, 5) for r in [*rows, (None, 0, "no id", "user")]], columns).repartition(5)
    by = {}
    for c, *piece in rows:
        by.setdefault(c, []).append(piece)
    lines = {c: plain_lines(p) for c, p in by.items()}
    keep = F.col("conv_id") % 3 != 0
    model = plain_model([x for c, x in lines.items() if c % 3])
    numbered = chat.numbered(chat.lines_of_transcripts(chat._turns(df, keep, "conv_id", "turn", "text", "role")))
    trained = chat.train(chat.numbered(chat.lines_of_transcripts(chat._turns(df.where(keep), None, "conv_id", "turn", "text", "role"))))
    assert np.allclose(trained.go, model.go) and np.allclose(trained.begin, model.begin) and all(map(np.allclose, trained.seen, model.seen))
    assert numbered.groupBy("conv", "chunk").count().agg(F.max("count")).first()[0] <= chunk
    roles = {}
    for r in numbered.select("conv", "row").join(chat.decode(numbered, trained), "row").orderBy("row").collect():
        roles.setdefault(r.conv, []).append(r.role)
    for c, found in roles.items():  # the best path, or one of equal probability
        best = viterbi(model, np.array([x[3:] for x in lines[c]]))
        assert abs(path_score(lines[c], model, found) - path_score(lines[c], model, [chat.ROLES[r] for r in best])) < 1e-6, c
    got = {}
    for r in chat.parse_conversations(df, keep=keep).orderBy("conv_id", "number").collect():
        assert r.number == len(got.setdefault(r.conv_id, []))
        got[r.conv_id].append((r.role, r.rendered, r.given_turn, r.given_role, r.n_given))
    assert set(got) == {c for c, x in lines.items() if x}
    for c, turns in got.items():
        assert turns == plain_turns(lines[c], roles[c]), c


def test_repeated_and_empty_conversations(spark):
    rows = [(1, 0, "hi", "user"), (1, 0, "hi", "user"), (1, 1, "fine", "assistant")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string, role string")
    assert sum(r.rendered.count("hi") for r in chat.parse_conversations(df).collect()) == 2
    for f in (chat.parse_conversations, chat.format_turns):
        assert f(df.where("false")).collect() == []
    raw = spark.createDataFrame([(1, "User: a\n\n\nBot: b"), (1, "User: a\n\n\nBot: b"), (None, "x"), (2, ""), (3, " ")], "doc_id long, text string")
    assert [(r.id, r.turn, r.role) for r in chat.parse_transcripts(raw, chat.Model()).orderBy("id", "turn").collect()] == [(1, 0, "user"), (1, 1, "assistant")]
    assert chat.parse_transcripts(raw.where("false"), chat.Model()).collect() == []


def test_empty_tables(spark):
    docs = frame(spark, [(1, "token=abcdefgh one two three")])
    folder = shared_path(spark, "test-ledger-empty")
    assert secrets.findings_by_document(docs.where("false"), folder).collect() == []
    assert [r.doc_id for r in secrets.findings_by_document(docs, folder).collect()] == [1]
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.contamination(docs.where("false"), items).collect() == []
    none = decontaminate.contamination(docs, items.where("false")).collect()
    assert [(r.doc_id, r.n_hit, r.n_items, r.contaminated) for r in none] == [(1, 0, 0, False)]


CLASHES = "node long, root string, n int, component_id string, score double, gram string, label int"


def test_pipeline_on_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], f"doc_id long, text string, {CLASHES}")
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, SF_SMALL)
        assert out.columns == docs.columns and out.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect() == []


def test_pipeline_stages_on_odd_rows(spark):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(500)]
    item = next(r.text for r in table(spark, SF_SMALL, "benchmark").collect() if len(r.text.split()) > 30)
    base = " ".join(rnd.choice(words) for _ in range(300))
    long = " ".join(rnd.choice(words) for _ in range(30000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, base), (5, base.upper().lower()), (6, base + " tail"), (7, base.upper()), (8, "pad " + item), (9, long), (10, long + " end"), (11, "few words"),
            (12, "many " * 9000), (12, "many " * 9000), (None, base), (None, "only here"), (None, "only here"), (None, None), (13, "😀 ünï " * 40)]
    docs = spark.createDataFrame([(*r, 1, "r", 2, "c", 0.5, "g", 1) for r in rows], f"doc_id long, text string, {CLASHES}").repartition(3)
    steps = [step for _, step in corpus_pipeline.STAGES]
    judged = steps[0](spark, docs, SF_SMALL)
    assert judged.columns == docs.columns and {(r.doc_id, r.text) for r in judged.collect()} <= set(rows)
    kept = [rows]
    for step in steps[1:4]:  # the given odd rows, whatever their quality
        docs = stage(step(spark, docs, SF_SMALL), "test-odd")
        assert len(docs.columns) == 9
        kept.append([(r.doc_id, r.text) for r in docs.collect()])
    given, distinct, unlike, clean = kept
    order = lambda rs: sorted(rs, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    best = {}
    for d, t in given:
        k = low(t)
        best[k] = max(-1 if d is None else d, best.get(k, -1))
    assert sorted((-1 if d is None else d, low(t)) for d, t in distinct) == sorted((d, t) for t, d in best.items())
    groups = brute_groups([r for r in distinct if r[0] is not None])
    assert order(unlike) == order(r for r in distinct if r[0] is None or groups[r[0]][1] == r[0])
    assert {4, 5, 6, 7, 9, 10} & {d for d, _ in unlike} == {6, 9}  # 7 stands for 4 and 5, and 6 is its near copy
    assert order(clean) == order(r for r in unlike if r[0] != 8)
    packed = steps[4](spark, docs, SF_SMALL).collect()
    assert {r.doc_id for r in packed} == {d for d, _ in clean}
    filled = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
