"""The trie of conversations by shared turns, and subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. It is named by the smallest of its
members and its depth. A prefix is known by its depth and four running sums of
31-bit hashes of (place, SHA-256 of the turn); the sums are running totals over
range-partitioned rows, so one conversation may hold a third of all turns, and a
turn shared by a third of all conversations is one group of an aggregate that is
combined on the map side. Texts are read once and never shuffled.

Contraction. Every live node has the weight gathered so far and the weight waiting
on the edge to its parent. A round rakes, then compresses:

* rake: every leaf goes; its total is final and is added to its parent;
* compress: of nodes with one child, an independent set goes (a node whose coin is
  1 and whose parent's is 0); the child moves up to the parent, and the weight
  waits on its edge. The node keeps a note: my total is my child's plus this much.

The coin of round ``t`` is bit ``t`` of the depth, which halves a chain in every
round, and after the bits of the greatest depth a hash. So the rounds grow with
the logarithm of the nodes, for a chain of any depth too. A round is two joins by
node and one small aggregate; messages to a node are combined before the shuffle.

Re-expansion: the notes are followed by pointer doubling, in a number of joins
that grows with the logarithm of the rounds, and end at raked nodes.

The digest of the members that end at a node is a SHA-256 over their ids in order,
which is sequential by its nature: such ids (8 bytes each) are sorted by Spark and
stream through one task for one node, with nothing held.

Cases: a null conv_id can't be named, such rows are left out; null role and text
are empty; turns are ordered by number, null first, at equal numbers by the turn's
hash, and repeated rows are so many turns; conversations without turns end at the
root; an empty table gives no node; other columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from residuum.llm.running import running_totals
from residuum.llm.staging import discard, stage

KEY = ["depth", "s1", "s2", "s3", "s4"]
NODE = ["conv_id", "depth"]
MASK = 0x7FFFFFFF


def turns_of(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, place, digest, size`` of every turn: its place from 1, the SHA-256 of role and text, the UTF-8 bytes of the text."""
    text_ = F.coalesce(F.col(text).cast("string"), F.lit(""))
    role_ = F.coalesce(F.col(role).cast("string"), F.lit(""))
    said = F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)
    rows = (conversations.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"),
                                 F.sha2(said.cast("binary"), 256).alias("digest"), F.octet_length(text_).cast("bigint").alias("size"))
            .where("conv_id IS NOT NULL").groupBy("conv_id", "turn", "digest", "size").agg(F.count(F.lit(1)).alias("upto")))
    # a row repeated m times is one row here, and m places once the places are known
    once = rows.withColumn("copies", F.col("upto"))
    placed = running_totals(once, "conv_id", ["turn", "digest", "size"], ["upto"], "trie-turns")
    return placed.select("conv_id", F.explode(F.sequence(F.expr("upto - copies + 1"), F.col("upto"))).alias("place"), "digest", "size")


def with_shared_starts(turns: DataFrame, base: Column, length: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation with its first ``length`` turns replaced by those of conversation ``base`` (columns of ``conv_id``).

    Returns ``(turns, conversations(conv_id, n_turns))``, conversations without any turn left included. ``length`` is at
    most ``longest``.
    """
    n = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    plan = (n.select("conv_id", "n", base.alias("base"), length.cast("bigint").alias("h"))
            .join(n.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left")
            .withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
            .select("conv_id", "base", "k", "h", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    plan = stage(plan, "trie-conversations")
    own = (turns.where(F.col("place") > length).join(plan, "conv_id")
           .select("conv_id", (F.col("place") + F.col("k") - F.col("h")).alias("place"), "digest", "size"))
    starts = turns.where(F.col("place") <= longest).withColumnRenamed("conv_id", "base")
    shared = plan.where("k > 0").join(starts, "base").where("place <= k").select("conv_id", "place", "digest", "size")
    return own.unionByName(shared), plan.select("conv_id", "n_turns")


def _ends(members: DataFrame) -> DataFrame:
    """``conv_id, depth, ends_sha256`` from ``conv_id, depth, member``: the digest of the members in order."""
    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for batch in batches:
            conv, depth, member = (batch.column(i).to_numpy() for i in range(3))
            if not len(conv):
                continue
            cut = np.flatnonzero((conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1])) + 1
            done = []
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(conv)]):
                node, ids = (int(conv[a]), int(depth[a])), ",".join(map(str, member[a:b].tolist()))
                if node == last:
                    h.update(b"," + ids.encode())
                else:
                    if last is not None:
                        done.append((*last, h.hexdigest()))
                    last, h = node, hashlib.sha256(ids.encode())
            if done:
                yield pa.record_batch([pa.array(c) for c in zip(*done)], names=[*NODE, "ends_sha256"])
        if last is not None:
            yield pa.record_batch([pa.array([x]) for x in (*last, h.hexdigest())], names=[*NODE, "ends_sha256"])
    return members.repartition(*NODE).sortWithinPartitions(*NODE, "member").mapInArrow(digest, "conv_id bigint, depth bigint, ends_sha256 string")


def _coin(conv: str, depth: str, turn: int, bits: int) -> Column:
    if turn < bits:
        return F.getbit(F.col(depth), F.lit(turn)) == 1
    return F.getbit(F.xxhash64(F.lit(turn), F.col(conv), F.col(depth)), F.lit(0)) == 1


def subtree_totals(tree: DataFrame, values: list[str], bits: int) -> DataFrame:
    """``conv_id, depth`` and each of ``values`` summed over the subtree of the node, by contraction.

    ``tree``: ``conv_id, depth, up_conv, up_depth`` (null for the root), ``n_kids, x_conv, x_depth`` (number of children and
    exclusive or of their names) and ``values``. ``bits`` is the number of bits in the greatest depth.
    """
    live = tree.select(*NODE, "up_conv", "up_depth", "n_kids", "x_conv", "x_depth", *values, *[F.lit(0).cast("bigint").alias(f"e_{v}") for v in values])
    columns = live.columns
    raked, notes, old, turn = [], [], None, 0
    while True:
        up = F.col("up_conv").isNotNull()
        picked = (F.col("n_kids") == 1) & up & _coin("conv_id", "depth", turn, bits) & ~_coin("up_conv", "up_depth", turn, bits)
        seen = live.agg(F.count_if((F.col("n_kids") == 0) & up).alias("leaves"), F.count_if(picked).alias("picked"), F.count(F.lit(1)).alias("n")).first()
        if not seen.leaves:
            break
        # rake
        leaves = live.where("n_kids = 0 AND up_conv IS NOT NULL")
        raked.append(stage(leaves.select(*NODE, *values), "trie-raked"))
        given = leaves.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(
            F.count(F.lit(1)).alias("g_n"), F.bit_xor("conv_id").alias("g_conv"), F.bit_xor("depth").alias("g_depth"),
            *[F.sum(F.col(v) + F.col(f"e_{v}")).alias(f"g_{v}") for v in values])
        zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
        live = (live.where("n_kids > 0 OR up_conv IS NULL").join(given, NODE, "left")
                .select(*NODE, "up_conv", "up_depth", (F.col("n_kids") - zero("g_n")).alias("n_kids"), F.col("x_conv").bitwiseXOR(zero("g_conv")).alias("x_conv"),
                        F.col("x_depth").bitwiseXOR(zero("g_depth")).alias("x_depth"), *[(F.col(v) + zero(f"g_{v}")).alias(v) for v in values],
                        *[f"e_{v}" for v in values]))
        live, last = stage(live, "trie-live"), old
        if last is not None:
            discard(last)
        old = live
        # compress
        gone = live.where(picked)
        to_child = gone.select(F.col("x_conv").alias("conv_id"), F.col("x_depth").alias("depth"), F.struct(
            F.col("conv_id").alias("conv"), F.col("depth").alias("depth"), "up_conv", "up_depth", *[v for v in values], *[f"e_{v}" for v in values]).alias("m"),
            F.lit(0).cast("bigint").alias("d_conv"), F.lit(0).cast("bigint").alias("d_depth"))
        to_parent = gone.select(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth"), F.lit(None).cast(to_child.schema["m"].dataType).alias("m"),
                                F.col("conv_id").bitwiseXOR(F.col("x_conv")).alias("d_conv"), F.col("depth").bitwiseXOR(F.col("x_depth")).alias("d_depth"))
        told = to_child.unionByName(to_parent).groupBy(*NODE).agg(F.max("m").alias("m"), F.bit_xor("d_conv").alias("d_conv"), F.bit_xor("d_depth").alias("d_depth"))
        moved = stage(live.where(~picked).join(told, NODE, "left").select(
            *NODE, F.coalesce("m.up_conv", "up_conv").alias("up_conv"), F.coalesce("m.up_depth", "up_depth").alias("up_depth"), "n_kids",
            F.col("x_conv").bitwiseXOR(zero("d_conv")).alias("x_conv"), F.col("x_depth").bitwiseXOR(zero("d_depth")).alias("x_depth"), *values,
            *[(F.col(f"e_{v}") + zero(F.col(f"m.{v}")) + zero(F.col(f"m.e_{v}"))).alias(f"e_{v}") for v in values],
            F.col("m.conv").alias("gone_conv"), F.col("m.depth").alias("gone_depth"),
            *[(F.col(f"e_{v}") + F.col(f"m.{v}")).alias(f"add_{v}") for v in values]), "trie-moved")
        notes.append(moved.where("gone_conv IS NOT NULL").select(F.col("gone_conv").alias("conv_id"), F.col("gone_depth").alias("depth"),
                                                                 F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), *[f"add_{v}" for v in values]))
        live, turn = moved.select(*columns), turn + 1
    final = _all([*raked, live.select(*NODE, *values)])
    if not notes:
        return final
    return final.unionByName(_expanded(_all(notes), final, values, turn))


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _expanded(notes: DataFrame, final: DataFrame, values: list[str], rounds: int) -> DataFrame:
    """Totals of compressed nodes: their notes lead, through nodes compressed later, to raked ones."""
    notes = stage(notes, "trie-notes")
    for _ in range(math.ceil(math.log2(rounds + 1))):
        onward = notes.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("to_conv").alias("n_conv"), F.col("to_depth").alias("n_depth"),
                              *[F.col(f"add_{v}").alias(f"more_{v}") for v in values])
        notes = stage(notes.join(onward, ["to_conv", "to_depth"], "left").select(
            *NODE, F.coalesce("n_conv", "to_conv").alias("to_conv"), F.coalesce("n_depth", "to_depth").alias("to_depth"),
            *[(F.col(f"add_{v}") + F.coalesce(f"more_{v}", F.lit(0))).alias(f"add_{v}") for v in values]), "trie-notes")
    ends = final.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), *[F.col(v).alias(f"at_{v}") for v in values])
    return notes.join(ends, ["to_conv", "to_depth"]).select(*NODE, *[(F.col(f"add_{v}") + F.col(f"at_{v}")).alias(v) for v in values])


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns(conv_id, place, digest, size)`` of ``conversations(conv_id, n_turns)``.

    ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``
    """
    h1, h2 = F.xxhash64("place", "digest"), F.xxhash64("digest", "place")
    low = lambda h: h.bitwiseAND(F.lit(MASK).cast("bigint"))
    parts = [low(h1), F.shiftrightunsigned(h1, 33), low(h2), F.shiftrightunsigned(h2, 33)]
    walk = turns.select("conv_id", F.col("place").alias("depth"), "size", *[p.alias(f"s{i}") for i, p in enumerate(parts, 1)],
                        *[p.alias(f"t{i}") for i, p in enumerate(parts, 1)])
    walk = running_totals(walk, "conv_id", ["depth"], KEY[1:], "trie-walk")
    before = [(F.col(f"s{i}") - F.col(f"t{i}")).alias(f"p{i}") for i in range(1, 5)]
    nodes = stage(walk.select("conv_id", "size", *KEY, *before).groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("size").alias("size"),
        *[F.max(f"p{i}").alias(f"p{i}") for i in range(1, 5)]), "trie-nodes")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        "conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(None).cast("bigint").alias("up_conv"), F.lit(None).cast("bigint").alias("up_depth"),
        "n_convs", F.lit(0).cast("bigint").alias("size"))
    above = nodes.select((F.col("depth") + 1).alias("depth"), *[F.col(f"s{i}").alias(f"p{i}") for i in range(1, 5)], F.col("conv_id").alias("up_conv"))
    deep = nodes.where("depth > 1").join(above, ["depth", "p1", "p2", "p3", "p4"])
    first = nodes.where("depth = 1").crossJoin(F.broadcast(root.select(F.col("conv_id").alias("up_conv"))))  # one row
    named = _all([f.select(*NODE, "up_conv", (F.col("depth") - 1).alias("up_depth"), "n_convs", "size") for f in (deep, first)] + [root])
    named = stage(named, "trie-named")
    kids = named.where("up_conv IS NOT NULL").groupBy(F.col("up_conv").alias("conv_id"), F.col("up_depth").alias("depth")).agg(
        F.count(F.lit(1)).alias("n_kids"), F.bit_xor("conv_id").alias("x_conv"), F.bit_xor(F.col("depth")).alias("x_depth"))
    n_kids = F.coalesce("n_kids", F.lit(0).cast("bigint"))
    tree = stage(named.join(kids, NODE, "left").select(
        *NODE, "up_conv", "up_depth", "n_convs", n_kids.alias("n_kids"), *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("x_conv", "x_depth")],
        (n_kids == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")), "trie-tree")
    deepest = tree.agg(F.max("depth")).first()[0]
    totals = subtree_totals(tree, ["n_leaves", "saved_tokens"], (deepest or 0).bit_length())
    last = walk.join(conversations.select("conv_id", F.col("n_turns").alias("depth")), NODE).select(*KEY, F.col("conv_id").alias("member"))
    members = last.join(nodes.select(*KEY, "conv_id"), KEY).select(*NODE, "member").unionByName(
        conversations.where("n_turns = 0").withColumnRenamed("conv_id", "member").crossJoin(F.broadcast(root.select(*NODE))).select(*NODE, "member"))
    return (tree.select(*NODE, "up_conv", "n_convs", "n_kids").join(totals, NODE).join(_ends(members), NODE, "left")
            .select(*NODE, F.col("up_conv").alias("parent_conv_id"), "n_convs", F.col("n_kids").alias("n_children"), "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


def shared_start(conv_id: Column, every: int = 5, modulus: int = 9) -> tuple[Column, Column, int]:
    """Fixed rule of the registered query: the conversation whose start is taken, how many turns of it, and their greatest number."""
    return conv_id - F.pmod(conv_id, F.lit(every)), F.crc32(conv_id.cast("string").cast("binary")) % modulus, modulus - 1
