"""What the two exact repeat finders share.

A window is a fixed number of consecutive units (words or bytes) of one document.
Each window has one anchor, chosen from the window's own content alone, so equal
windows have equal anchors at the same place; neighbouring windows mostly share
theirs. The jobs are then

1. all anchors by key: keys that occur once can't be in a repeated window;
2. for each repeated anchor, its run of windows, dealt out by the anchor's key and
   sorted by document and place;
3. in each key's rows, in order, a window that was seen before is a repeat; only
   the distinct windows of the present key are held, so a key with very many rows
   streams through;
4. the spans of repeats, gathered by document and cut out of its text.

A window is compared by a 64-bit hash of all its units, within its key.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from residuum.llm.staging import stage

CHUNK = 1 << 21
SPANS = "doc_id bigint, low bigint, high bigint"


def repeated_places(anchors: DataFrame, name: str) -> DataFrame:
    """``doc_id, places``: of ``anchors(key, doc_id, place)``, the places whose key occurs more than once."""
    several = anchors.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    return stage(several.groupBy("doc_id").agg(F.collect_set("place").alias("places")), name)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal neighbours."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate([[0], cut]).astype(np.int64)[:len(values)], np.concatenate([cut, [len(values)]]).astype(np.int64)[:max(len(values), 0)]


def later_windows(chunks, size: int):
    """Spans of windows seen before, as record batches.

    ``chunks`` yields ``(key, doc, first, count, hashes)`` in the order of key, document and
    place: row ``i`` has the windows ``first[i] ... first[i] + count[i] - 1`` of document ``doc[i]``,
    whose hashes are the next ``count[i]`` of ``hashes``. ``key`` is any array that can be compared.
    """
    last, seen = None, np.empty(0, np.uint64)
    for key, doc, first, count, hashes in chunks:
        if last is None or key[0] != last:
            seen = seen[:0]
        row = np.repeat(np.arange(len(doc)), count)
        by = np.argsort(hashes, kind="stable")
        ordered = hashes[by]
        again = np.zeros(len(hashes), dtype=bool)
        again[by[1:]] = ordered[1:] == ordered[:-1]
        if len(seen):
            at = np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)
            again |= seen[at] == hashes
        last = key[-1]
        same = np.flatnonzero(key != last)
        tail = hashes[np.repeat(np.arange(len(doc)) > (same[-1] if len(same) else -1), count)]
        seen = np.unique(np.concatenate([seen, tail]) if not len(same) else tail)
        begin = np.cumsum(count) - count
        start = first[row] + np.arange(len(hashes)) - begin[row]
        w = np.flatnonzero(again)
        if len(w):
            cut = np.flatnonzero((np.diff(row[w]) != 0) | (np.diff(start[w]) != 1)) + 1
            low, high = np.concatenate([[0], cut]), np.concatenate([cut, [len(w)]]) - 1
            yield pa.record_batch([pa.array(doc[row[w[low]]]), pa.array(start[w[low]]), pa.array(start[w[high]] + size)],
                                  names=["doc_id", "low", "high"])


def by_document(spans: DataFrame) -> DataFrame:
    """``doc_id, spans`` (an array of starts and ends, in turn)."""
    return spans.distinct().groupBy("doc_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("low", "high"))), lambda s: F.array(s["low"], s["high"]))).alias("spans"))


def covered(length: int, spans) -> np.ndarray:
    """Mask over ``length`` units of those inside a span."""
    edge = np.zeros(length + 1, np.int64)
    s = np.asarray(spans, np.int64)
    np.add.at(edge, s[::2], 1)
    np.add.at(edge, s[1::2], -1)
    return np.cumsum(edge[:-1]) > 0


def sha256(parts: bytes) -> str:
    return hashlib.sha256(parts).hexdigest()
