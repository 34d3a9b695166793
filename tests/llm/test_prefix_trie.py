"""The prefix trie against a plain version of its contract: deep chains, shared starts, repeated rows, nulls; running totals."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from residuum.llm import prefix_trie as T
from residuum.llm import queries
from residuum.llm.running import running_totals
from residuum.session import shared_path


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain(rows):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            size = len(role.encode())
            talks[c].append((turn is not None, turn or 0, sha(f"{size}:{role}{text}"), role, text))
    talks = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in talks.items()}
    rebuilt = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = talks.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        key = ""
        members[0, key].append(c)
        for d, (role, text) in enumerate(turns, 1):
            key = sha(key + f"{len(role)}:{role}{text}")
            members[d, key].append(c)
    name = {k: (min(v), k[0]) for k, v in members.items()}
    at = {}
    for c, turns in rebuilt.items():
        key = ""
        at[c, 0] = name[0, ""]
        for d, (role, text) in enumerate(turns, 1):
            key = sha(key + f"{len(role)}:{role}{text}")
            at[c, d] = name[d, key]
    out = {}
    for k, v in sorted(members.items(), reverse=True, key=lambda x: x[0][0]):
        c, d = name[k]
        kids = [o for o in out.values() if o["depth"] == d + 1 and o["parent_conv_id"] == c]
        text = rebuilt[c][d - 1][1] if d else ""
        ends = sorted(m for m in v if len(rebuilt[m]) == d)
        out[c, d] = dict(conv_id=c, depth=d, parent_conv_id=at[c, d - 1][0] if d else None, n_convs=len(v), n_children=len(kids),
                         n_leaves=sum(o["n_leaves"] for o in kids) or 1, saved_tokens=(len(v) - 1) * len(text.encode()) + sum(o["saved_tokens"] for o in kids),
                         ends_sha256=sha(",".join(map(str, ends))))
    return sorted(map(repr, out.values()))


def answer(spark, rows):
    folder = shared_path(spark, "test-trie")
    spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, place string, s1 int") \
        .repartition(3).write.parquet(f"{folder}/conversations.parquet")
    return sorted(repr(r.asDict()) for r in queries.op12_prefix_trie(spark, folder).collect())


def test_odd_conversations(spark):
    rng = random.Random(4)
    rows = [(None, 1, "user", "no id"), (3, None, None, None), (3, 5, "user", ""), (3, 5, "user", ""), (3, 2, "a", "é\n😀"), (-7, 0, "user", "minus"), (-10, 0, "user", "base")]
    for c in range(5, 90):
        if c % 7:  # some bases are absent
            rows += [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["hi", "yes", f"own {c}"])) for t in range(rng.randrange(1, 12))]
    rows += [(c, t, "user", "copied") for c in range(100, 140) for t in range(4)]
    assert answer(spark, rows) == plain(rows)


def test_one_deep_conversation_and_copies_of_it(spark):
    rows = [(c, t, "user", f"t{t}") for c, n in ((20, 300), (21, 300), (22, 150), (25, 40)) for t in range(n)]
    assert answer(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert answer(spark, [(None, 1, "user", "no id")]) == []


@pytest.mark.parametrize("shape", ["chain", "star", "random", "caterpillar"])
def test_contraction_of_trees(spark, shape):
    rng = random.Random(shape)
    n = 400
    up = [None] + [i - 1 if shape == "chain" else 0 if shape == "star" else rng.randrange(i) if shape == "random" else (i - 1) // 2 * 2 for i in range(1, n)]
    depth = [0] * n
    for i in range(1, n):
        depth[i] = depth[up[i]] + 1
    kids = defaultdict(list)
    for i in range(1, n):
        kids[up[i]].append(i)
    want = [i + 1 for i in range(n)]
    for i in range(n - 1, 0, -1):
        want[up[i]] += want[i]

    def xor(values):
        out = 0
        for v in values:
            out ^= v
        return out
    tree = spark.createDataFrame([(i, depth[i], up[i], None if up[i] is None else depth[up[i]], len(kids[i]), xor(kids[i]), xor(depth[k] for k in kids[i]), i + 1)
                                  for i in range(n)], "conv_id long, depth long, up_conv long, up_depth long, n_kids long, x_conv long, x_depth long, w long")
    got = {r.conv_id: r.w for r in T.subtree_totals(tree, ["w"], max(depth).bit_length()).collect()}
    assert got == dict(enumerate(want))


def test_running_totals_of_a_group_over_many_tasks(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id") % 50).cast("bigint").alias("g"), F.col("id").alias("o"), (F.col("id") % 3).alias("v"))
    sums = defaultdict(int)
    want = {}
    for r in sorted(df.collect()):
        sums[r.g] += r.v
        want[r.g, r.o] = sums[r.g]
    out = running_totals(df, "g", ["o"], ["v"], "test-running")
    assert {(r.g, r.o): r.v for r in out.collect()} == want
    assert running_totals(df.limit(0), "g", ["o"], ["v"], "test-running").count() == 0
