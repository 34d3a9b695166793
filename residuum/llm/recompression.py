"""Substring deduplication by recompression.

A window is ``WINDOW`` consecutive words (maximal runs without ASCII white space,
unchanged) of one document; every word inside a window whose words also start
earlier (smaller id, or earlier in the document) is removed.

Naming. Each of ``ROUNDS`` rounds names runs of equal symbols and then pairs: a
coin drawn from a symbol's name makes it left or right, and each left symbol that
a right one follows becomes a pair with it. A name is the hash of what it stands
for, so all tasks and documents give equal things the same name in every round
with no dictionary to shuffle between rounds; the rounds run one after another
inside the tasks of one Spark job. With each symbol goes the interval of words
that fixed it (a run needs its neighbours, an unpaired symbol the one it might
have paired with). A symbol whose interval lies inside a repeated window appears
in each of its copies: that is the consistent interior.

Anchors. Of the last round's symbols fixed inside a window, the window's anchor is
the one with the smallest hash; windows with none (long runs, odd spots) stand
for themselves. The global job keeps the anchors whose fixing words occur more
than once; only their windows are compared, whole, in order of document and place
(``repeats.py``).

Cases: null and short texts have no window and stay; a repeated document row is
the same document, not an earlier one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from residuum.llm import repeats
from residuum.llm.staging import discard, id_text, one_text, stage
from residuum.llm.textops import SPACE_SPLIT, blocks, find_words, mix, prefix_hash, span_hash, text_buffer, word_codes, Block

WINDOW = 20
ROUNDS = 3
_U = np.uint64


def recompress(name: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """``name, start, end, low, high`` of the symbols after the rounds; words ``low:high`` fix words ``start:end``'s symbol."""
    n = len(name)
    start, end = np.arange(n), np.arange(1, n + 1)
    low, high = start, end
    for turn in range(rounds):
        # runs
        a, b = repeats.runs_of(name)
        count = (b - a).astype(np.uint64)
        name = np.where(count > 1, mix(name[a] + count * _U(0x9FB21C651E98DF25)), name[a])
        before = np.concatenate([[-1], low[b[:-1] - 1]])
        after = np.concatenate([high[a[1:]], [n + 1]])
        start, end, low, high = start[a], end[b - 1], np.minimum(low[a], before), np.maximum(high[b - 1], after)
        # pairs
        right = (mix(name + _U(turn + 1) * _U(0xD1342543DE82EF95)) & _U(1)).astype(bool)
        pair = np.zeros(len(name), dtype=bool)
        pair[:-1] = ~right[:-1] & right[1:]
        second = np.zeros(len(name), dtype=bool)
        second[1:] = pair[:-1]
        before = np.concatenate([[-1], low[:-1]])
        after = np.concatenate([high[1:], [n + 1]])
        follow = np.concatenate([name[1:], name[:1]])
        follow_end = np.concatenate([end[1:], end[-1:]])
        name = np.where(pair, mix(name * _U(0x9E3779B97F4A7C15) + follow * _U(0xC2B2AE3D27D4EB4F) + _U(turn)), name)
        new_low = np.where(right & ~second, np.minimum(low, before), low)
        new_high = np.where(~right, np.maximum(high, after), high)
        end = np.where(pair, follow_end, end)
        name, start, end, low, high = name[~second], start[~second], end[~second], new_low[~second], new_high[~second]
    return name, start, end, low, high


def anchored(b: Block):
    """Of a block: ``key, doc index, place, first window, number of windows`` of each anchor, and all windows' hashes by place.

    Places are word numbers of the document; the last item maps a first window to its hashes.
    """
    words = find_words(b.data, b.off, SPACE_SPLIT)
    h = word_codes(b.data, words)
    docs, n = len(b.ids), len(h)
    # a mark before each document and one at the end: no symbol that it takes part in lies inside a window
    marked = np.insert(h, words.first, mix(np.arange(docs + 1, dtype=np.uint64) + _U(0xA5A5A5A5A5A5)))
    base = words.first[:-1] + np.arange(docs) + 1  # where each document's words begin in `marked`
    many = np.maximum(np.diff(words.first) - WINDOW + 1, 0)
    total = int(many.sum())
    doc = np.repeat(np.arange(docs), many)
    j = np.arange(total) - np.repeat(np.cumsum(many) - many, many) + base[doc]
    prefix = prefix_hash(marked)
    hashes = span_hash(prefix, j, j + WINDOW)
    _, _, _, low, high = recompress(marked)
    m = len(low)
    ok = (low >= 0) & (high <= len(marked)) & (high - low <= WINDOW)
    key = np.full(m, 0xFFFFFFFFFFFFFFFF, np.uint64)
    key[ok] = span_hash(prefix, low[ok], high[ok])
    bits = _U(max(21, int(m).bit_length()))  # the same at every block but of a huge document
    mask = (_U(1) << bits) - _U(1)
    ranked = (key & ~mask) | (mask - np.arange(m, dtype=np.uint64))
    first, last = np.searchsorted(low, j, "left"), np.searchsorted(high, j + WINDOW, "right")
    width = last - first
    best = np.full(total, 0xFFFFFFFFFFFFFFFF, np.uint64)
    layer, step = ranked, 1
    while True:
        here = np.flatnonzero((width >= step) & (width < 2 * step))
        best[here] = np.minimum(layer[first[here]], layer[last[here] - step])
        if 2 * step > WINDOW or len(layer) <= step:
            break
        layer = np.minimum(layer[:-step], layer[step:])
        step *= 2
    alone = width <= 0
    symbol = np.where(alone, -1 - np.arange(total), (mask - (best & mask)).astype(np.int64))
    a, z = repeats.runs_of(symbol * 1)
    if total:  # runs end with their document
        starts = np.unique(np.concatenate([a, (np.cumsum(many) - many)[many > 0]]))
        a, z = starts, np.concatenate([starts[1:], [total]])
    lone = alone[a] if total else alone
    s = np.where(lone, 0, symbol[a]) if total else symbol
    out_key = np.where(lone, hashes[a], key[s]) if total else hashes
    place = np.where(lone, j[a], low[s]) - base[doc[a]] if total else j
    return out_key, doc[a] if total else doc, place, (j[a] - base[doc[a]]) if total else j, z - a, hashes, a


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in blocks(batches):
            key, doc, place, first, _, _, _ = anchored(b)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(b.ids[doc]), pa.array(first)], names=["key", "doc_id", "place"])
    return docs.mapInArrow(run, "key bigint, doc_id bigint, place bigint")


def _windows(docs: DataFrame) -> DataFrame:
    """``key, doc_id, first, hashes`` of the anchors at ``places`` (by their first window)."""
    def run(batches):
        for batch in batches:
            for b, wanted in with_places(batch):
                key, doc, _, first, count, hashes, at = anchored(b)
                keep = np.flatnonzero(np.isin(doc.astype(np.int64) << 40 | first, wanted))
                if not len(keep):
                    continue
                off = np.concatenate([[0], np.cumsum(count[keep])])
                pick = np.repeat(at[keep] - off[:-1], count[keep]) + np.arange(off[-1])
                yield pa.record_batch([pa.array(key[keep].view(np.int64)), pa.array(b.ids[doc[keep]]), pa.array(first[keep]),
                                       pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(hashes[pick].view(np.int64)))],
                                      names=["key", "doc_id", "first", "hashes"])
    return docs.mapInArrow(run, "key bigint, doc_id bigint, first bigint, hashes array<bigint>")


def with_places(batch):
    """Blocks of a batch ``doc_id, text, places`` with the wanted places as ``document index << 40 | place``."""
    off = np.asarray(batch.column(2).offsets) if batch.num_rows else np.zeros(1, np.int64)
    flat = np.asarray(batch.column(2).values)
    done = 0
    for b in blocks([batch]):
        n = len(b.ids)
        o = off[done:done + n + 1]
        yield b, np.repeat(np.arange(n, dtype=np.int64), np.diff(o)) << 40 | flat[o[0]:o[-1]]
        done += n


def _compare(batches):
    def chunks():
        for batch in batches:
            lists = batch.column(3)
            off = np.asarray(lists.offsets)
            yield (np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.asarray(batch.column(2)), np.diff(off),
                   np.asarray(lists.values)[off[0]:off[-1]].view(np.uint64))
    yield from repeats.later_windows((c for c in chunks() if len(c[0])), WINDOW)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` over word numbers, of ``docs(doc_id, text)``; documents without repeats are left out."""
    places = repeats.repeated_places(_anchors(docs), "recompression-anchors")
    rows = _windows(one_text(docs.join(places, "doc_id"))).repartition("key").sortWithinPartitions("key", "doc_id", "first")
    spans = stage(rows.mapInArrow(_compare, repeats.SPANS), "recompression-spans")
    out = stage(repeats.by_document(spans), "recompression-spans")
    discard(places, spans)
    return out


def _cut(batches):
    for batch in batches:
        data, off = text_buffer(batch.column(1))
        out = []
        for doc, i, spans in zip(batch.column(0).to_pylist(), range(batch.num_rows), batch.column(2).to_pylist()):
            words = data[off[i]:off[i + 1]].tobytes().split()
            # bytes.split() takes the same six characters as white space
            kept = words
            if spans:
                kept = [w for w, gone in zip(words, repeats.covered(len(words), spans).tolist()) if not gone]
            text = b" ".join(kept)
            out.append((doc, len(words), len(words) - len(kept), repeats.sha256(text), text))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                              if out else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())],
                              names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` and ``kept``, the words that stay."""
    docs = id_text(docs, id_col, text_col)
    cut = docs.join(repeated_spans(docs), "doc_id", "left").mapInArrow(
        _cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept binary")
    return cut.withColumn("kept", F.col("kept").cast("string"))
