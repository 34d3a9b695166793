"""N-gram Jaccard join by vertical partitioning, and its groups.

A document is the set of its distinct ``SHINGLE``-word shingles (64-bit hashes)
after lower-casing A-Z; with fewer words, the whole sequence is its one shingle.
Two documents link when ``100 * intersection >= percent * union``.

Order. All shingles have one global order: by hash, but those that occur in many
documents come last, the most frequent at the very end. The frequent ones are
found by counting, over all documents, what repeats inside a task; the list has
at most ``HOT_LIST`` entries. It only shapes the order: any order gives the same
links.

Candidates. Documents with equal sets are one node. A pair of different sets that
links shares at least ``COMMON`` shingles (three against four is the smallest
case), and so shares that many among the first ``n - ceil(percent * n) + COMMON``
of either. Only those prefixes are shuffled. For one pair the bound is closer: with an
overlap of ``least = percent * (na + nb) / (100 + percent)`` or more, the first
``COMMON`` shared shingles have at least ``least - COMMON`` of either set after
them, so a shared shingle counts only where ``room`` (the shingles after it, and
``COMMON``) reaches ``least`` in both sets.

Counting. The order is cut into ``FRAGMENTS`` ranges. A candidate's set is stored
as one segment for each range; the overlap of a pair is counted for each fragment
on its own and summed over the fragments. The fragments are joined in ``ROUNDS``, so
that only a part of the shuffled segments is on disk at a time.

Large groups. In a posting list of more than ``SMALL_LIST`` rows each row is first
measured against one member, the hub (a star, not all pairs), and what links is
one group. The hub is the member whose prefix entries stand in the longest lists on
average: the text that most others are copies of, so that one star joins most of
them. Jaccard distance is a metric: two rows whose distances to the hub
differ by more than the limit can't link, so of the pairs still in different
groups only those whose distances are near are tried. Every pair that may link is
measured or already in one group, so no link between groups is missed, and a
group of thousands of near copies never becomes all its pairs.

Cases: null or empty text has no shingle and links with nothing; repeated rows
share their document's group.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from residuum.llm.graph import components
from residuum.llm.staging import discard, hold, id_text, one_text, stage
from residuum.llm.textops import LOWER, SPACE_SPLIT, blocks, find_words, mix, prefix_hash, span_hash, word_codes

SHINGLE = 5
PERCENT = 75
COMMON = 3
FRAGMENTS = 8
ROUNDS = 2
SMALL_LIST = 32
HOT_LIST = 1 << 16
HOT_COUNT = 100
BROADCAST_IDS = 1 << 20  # ids of candidates, counted first; beyond that their texts are found by a shuffled join
_BUFFER = 1 << 22


def shingle_sets(batches):
    """``(id, sorted distinct shingle hashes)`` of each document of the Arrow batches."""
    for b in blocks(batches):
        data = LOWER[b.data]
        words = find_words(data, b.off, SPACE_SPLIT)
        total = prefix_hash(word_codes(data, words))
        n = len(words.start)
        at = np.arange(max(0, n - SHINGLE + 1))
        grams = span_hash(total, at, at + SHINGLE)
        for i, doc in enumerate(b.ids.tolist()):
            low, high = words.first[i], words.first[i + 1]
            if high - low >= SHINGLE:
                yield doc, np.unique(grams[low:high - SHINGLE + 1])
            else:
                yield doc, span_hash(total, np.array([low]), np.array([high])) if high > low else grams[:0]


def _frequent(docs: DataFrame):
    """Broadcast ``(hashes sorted, their place by rising frequency)`` of the most frequent shingles."""
    def repeated(batches):
        def flush(held):
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1].astype(np.int64))], names=["h", "c"])
        held, size = [], 0
        for _, s in shingle_sets(batches):
            held.append(s)
            size += len(s)
            if size >= _BUFFER:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)
    spark = docs.sparkSession
    rows = (docs.mapInArrow(repeated, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT_COUNT)
            .orderBy(F.desc("c"), "h").limit(HOT_LIST).toPandas())
    h = rows["h"].to_numpy(np.int64)[::-1].copy().view(np.uint64)
    by = np.argsort(h)
    return hold(spark.sparkContext.broadcast((h[by], by)))


def _in_order(s: np.ndarray, hot) -> tuple[np.ndarray, int]:
    """A sorted set in the global order, and how many of it are not frequent."""
    known, place = hot
    if not len(known):
        return s, len(s)
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    is_hot = known[at] == s
    if not is_hot.any():
        return s, len(s)
    late = s[is_hot][np.argsort(place[at[is_hot]])]
    return np.concatenate([s[~is_hot], late]), len(s) - len(late)


def _lists(values: list[np.ndarray]) -> pa.Array:
    off = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=off[1:])
    flat = np.concatenate(values) if values else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))


def _batched(rows, make, size=1 << 18):
    """Record batches of the rows, cut where their sets reach ``size`` hashes."""
    held, full = [], 0
    for r in rows:
        held.append(r)
        full += len(r[-1]) + 1
        if full >= size:
            yield make(held)
            held, full = [], 0
    if held:
        yield make(held)


def _prefixes(docs: DataFrame, hot, percent: int) -> DataFrame:
    def rows(batches):
        for doc, s in shingle_sets(batches):
            n = len(s)
            cut = min(n, n - -(-percent * n // 100) + COMMON)
            yield doc, n, mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), _in_order(s, hot.value)[0][:cut]

    def make(held):
        doc, n, d1, d2, p = zip(*held)
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(np.array(d1, np.uint64).view(np.int64)),
                                pa.array(np.array(d2, np.uint64).view(np.int64)), _lists(list(p))], names=["doc_id", "n", "d1", "d2", "prefix"])
    return docs.mapInArrow(lambda batches: _batched(rows(batches), make), "doc_id bigint, n bigint, d1 bigint, d2 bigint, prefix array<bigint>")


def _segments(docs: DataFrame, hot) -> DataFrame:
    """``doc_id, fragment, grams``: each set cut where the global order is cut; the frequent shingles are the last fragment."""
    def rows(batches):
        for doc, s in shingle_sets(batches):
            s, cold = _in_order(s, hot.value)
            step = np.uint64(64 - (FRAGMENTS - 1).bit_length())
            cuts = np.searchsorted(s[:cold] >> step, np.arange(FRAGMENTS + 1, dtype=np.uint64))
            for f in range(FRAGMENTS):
                if cuts[f + 1] > cuts[f]:
                    yield doc, f, s[cuts[f]:cuts[f + 1]]
            if cold < len(s):
                yield doc, FRAGMENTS, s[cold:]

    def make(held):
        doc, f, s = zip(*held)
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(f, pa.int32()), _lists(list(s))], names=["doc_id", "fragment", "grams"])
    return docs.mapInArrow(lambda batches: _batched(rows(batches), make), "doc_id bigint, fragment int, grams array<bigint>")


def _overlaps(docs: DataFrame, hot, pairs: DataFrame, again: DataFrame) -> DataFrame:
    """``pairs(a, b, na, nb)`` with ``shared``: partial overlaps by fragment, summed for each pair.

    Texts are cut where they are read; only rows of the ids ``again``, which several rows carry, are shuffled first, one left of each.
    """
    named = stage(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "jaccard-named")
    ids = F.broadcast(named) if named.count() <= BROADCAST_IDS else named
    wanted = docs.join(ids, "doc_id", "leftsemi")
    texts = wanted.join(again, "doc_id", "leftanti").unionByName(one_text(wanted.join(again, "doc_id", "leftsemi")))
    segments = stage(_segments(texts, hot), "jaccard-segments")
    key, parts = ["a", "b", "na", "nb"], []
    for k in range(ROUNDS):
        some = segments.where(F.col("fragment") % ROUNDS == k)
        left = some.select(F.col("doc_id").alias("a"), "fragment", F.col("grams").alias("ga"))
        right = some.select(F.col("doc_id").alias("b"), "fragment", F.col("grams").alias("gb"))
        part = pairs.join(left, "a").join(right, ["b", "fragment"]).select(*key, F.size(F.array_intersect("ga", "gb")).cast("bigint").alias("shared"))
        parts.append(stage(part.groupBy(*key).agg(F.sum("shared").alias("shared")), "jaccard-overlaps"))
    discard(segments, named)
    out = stage(reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.sum("shared").alias("shared")), "jaccard-overlaps")
    discard(*parts)
    return out


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_shingles, component_id`` (smallest id of its group)."""
    if not 100 * (COMMON - 1) < percent * COMMON:
        raise ValueError(f"different sets with fewer than {COMMON} common shingles can link at {percent} %")
    docs = id_text(docs, id_col, text_col)
    hot = _frequent(docs)
    wide = stage(_prefixes(docs, hot, percent), "jaccard-prefixes")
    key = ["n", "d1", "d2"]
    sets = stage(wide.drop("prefix"), "jaccard-sets")
    again = stage(sets.groupBy("doc_id").count().where("count > 1").select("doc_id"), "jaccard-repeated")
    nodes = stage(wide.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix")), "jaccard-nodes")
    discard(wide)
    shared = _shared_prefixes(nodes, percent)
    narrow = stage(nodes.drop("prefix"), "jaccard-nodes")
    discard(nodes)
    links = _all_links(docs, hot, shared, percent, again)
    root = components(links)
    named = root.join(root.groupBy("root").agg(F.min("node").alias("component_id")), "root").select("node", "component_id")
    by_set = narrow.select(*key, "node").join(named, "node", "left").select(*key, F.coalesce("component_id", "node").alias("component_id"))
    return (sets.join(by_set, key, "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def _shared_prefixes(nodes: DataFrame, percent: int) -> DataFrame:
    """``node, n, room, gram, weight``: prefix entries in posting lists of two nodes or more, of nodes with ``COMMON``
    such entries; ``weight`` is the sum of the lengths of a node's lists over the length of its prefix."""
    entries = (nodes.select("node", "n", F.posexplode("prefix").alias("at", "gram"))
               .select("node", "n", (F.col("n") - F.col("at") - 1 + COMMON).alias("room"), "gram"))
    several = (entries.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("df > 1"))
    several = stage(several, "jaccard-postings")
    prefix = F.expr(f"least(n, n - ceil({percent} * n / 100) + {COMMON})")
    enough = (several.groupBy("node", "n").agg(F.count(F.lit(1)).alias("count"), F.sum("df").alias("total")).where(F.col("count") >= COMMON)
              .select("node", (F.col("total") / prefix).alias("weight")))
    out = stage(several.drop("df").join(enough, "node"), "jaccard-postings")
    discard(several)
    return out


def _all_links(docs: DataFrame, hot, shared: DataFrame, percent: int, again: DataFrame) -> DataFrame:
    """Links that give the groups of all links. ``shared`` is deleted when it has been read."""
    fits = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    placed = f"{percent} * (na + nb) <= {100 + percent} * least(ma, mb)"
    links = f"100 * shared >= {percent} * (na + nb - shared)"
    reach = 1 - percent / 100 + 1e-9
    rank = F.struct((-F.col("weight")).alias("rank"), F.col("node").alias("hub"), F.col("n").alias("hub_n"))
    hubs = shared.groupBy("gram").agg(F.min(rank).alias("h"), F.count(F.lit(1)).alias("df")).where(F.col("df") > SMALL_LIST).select("gram", "h.hub", "h.hub_n")
    lists = stage(shared.drop("weight").join(hubs, "gram", "left"), "jaccard-lists")
    discard(shared)
    first = F.col("node") < F.col("hub")
    star = stage(lists.where("hub IS NOT NULL AND hub <> node")
                 .select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"),
                         F.when(first, F.col("n")).otherwise(F.col("hub_n")).alias("na"), F.when(first, F.col("hub_n")).otherwise(F.col("n")).alias("nb"))
                 .where(fits).distinct(), "jaccard-star")
    measured = _overlaps(docs, hot, star, again)
    near = measured.where(links).select("a", "b")
    far = measured.select("a", "b", (1 - F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("d"))
    far = far.selectExpr("a AS node", "b AS hub", "d").unionByName(far.selectExpr("b AS node", "a AS hub", "d"))
    root = components(near).select("node", "root")
    sized = 1 - F.least("n", "hub_n") / F.greatest("n", "hub_n")
    known = F.when(F.col("hub") == F.col("node"), F.lit(0.0)).otherwise(F.col("d"))
    rows = stage(lists.join(far, ["node", "hub"], "left").join(root, ["node"], "left")
                 .select("gram", "node", "n", "room", F.coalesce("root", "node").alias("root"), F.when(F.col("hub").isNotNull(), F.coalesce(known, sized)).alias("low"),
                         F.when(F.col("hub").isNotNull(), F.coalesce(known, F.lit(1.0))).alias("high")), "jaccard-lists")
    discard(lists)
    mixed = rows.groupBy("gram").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one <> other").select("gram")
    still = stage(rows.join(mixed, "gram", "leftsemi"), "jaccard-open")
    discard(rows)
    x = still.selectExpr("gram AS ga", "node AS a", "n AS na", "room AS ma", "root AS ra", "low AS la", "high AS ha")
    y = still.selectExpr("gram AS gb", "node AS b", "n AS nb", "room AS mb", "root AS rb", "low AS lb", "high AS hb")
    rest = (x.join(y, F.expr(f"ga = gb AND a < b AND ra <> rb AND {fits} AND {placed} AND (la IS NULL OR (la - hb <= {reach} AND lb - ha <= {reach}))"))
            .groupBy("a", "b", "na", "nb").count().where(F.col("count") >= COMMON).drop("count").join(star.select("a", "b"), ["a", "b"], "leftanti"))
    rest = stage(rest, "jaccard-rest")
    discard(still, star)
    return near.unionByName(_overlaps(docs, hot, rest, again).where(links).select("a", "b"))
