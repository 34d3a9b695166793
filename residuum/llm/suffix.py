"""Suffix-array deduplication over bytes, on a sparse set of suffixes.

A window is ``WINDOW`` bytes of one document's UTF-8 text; every byte inside a
window whose bytes also start earlier (smaller id, or earlier in the document) is
removed.

Suffixes. A full suffix array would shuffle a record for every byte. It is enough
to sort the suffixes that begin at anchors: of the ``LEAD``-byte strings inside a
window the one with the smallest hash (the last of equals) is its anchor, so equal
windows have equal anchors, and about two of ``WINDOW - LEAD + 2`` places are
anchors. Suffixes whose lead occurs once are left out; the rest are
range-partitioned by their leading bytes with splitters that Spark samples, so
all suffixes with one lead meet in one bucket, and a lead that crosses the border
of two batches of the bucket is carried over to the next.

Order. In a bucket, multikey quicksort (eight bytes at a time, ties alone are looked
at again) orders the suffixes by their bytes, and the same suffixes once more by the
bytes before the anchor, read backwards. The common length of neighbours in each
order tells which suffixes agree on any number of bytes: they are the stretches
whose neighbours all share that many. A window that begins ``k`` bytes before its
anchor equals another one exactly when the suffixes agree on ``WINDOW - k`` bytes
and the bytes before on ``k``; of those that do, all but the earliest are repeats.
Only bytes are compared here; hashes choose the anchors and nothing else.

Cases: null and short texts have no window and stay; a repeated document row is
the same document, not an earlier one; cuts may fall inside a character, so what
stays is bytes. An id with two different texts, one of them with a repeat, raises.

Memory: a task holds the different suffixes of one lead, with the bytes before them
(equal ones go as they come, all but the first being repeats as a whole).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from residuum.llm import repeats
from residuum.llm.recompression import with_places
from residuum.llm.staging import discard, id_text, one_text, stage
from residuum.llm.textops import BYTE_CODE, Block, blocks, prefix_hash, sliding, span_hash, text_buffer

WINDOW = 100
LEAD = 36
_U = np.uint64
_ROWS = 1 << 15
_SIDE = WINDOW - LEAD  # a window reaches no further than that to either side of its lead
_ROW = "lead binary, doc_id bigint, first bigint, before binary, after binary"


def anchored(b: Block):
    """``key, document index, anchor, first window, number of windows`` of each anchor of a block; places are bytes of the document."""
    n, docs = len(b.data), len(b.ids)
    many = np.maximum(np.diff(b.off) - WINDOW + 1, 0)
    if n < WINDOW or not many.sum():
        none = np.empty(0, np.int64)
        return none.view(np.uint64), none, none, none, none
    at = np.arange(n - LEAD + 1)
    key = span_hash(prefix_hash(BYTE_CODE[b.data]), at, at + LEAD)
    bits = _U(max(21, int(n).bit_length()))
    mask = (_U(1) << bits) - _U(1)
    low = sliding((key & ~mask) | (mask - at.astype(np.uint64)), WINDOW - LEAD + 1)
    doc = np.repeat(np.arange(docs), many)
    begin = np.cumsum(many) - many
    j = np.arange(len(doc)) - begin[doc] + b.off[doc]
    anchor = (mask - (low[j] & mask)).astype(np.int64)
    a = np.unique(np.concatenate([repeats.runs_of(anchor)[0], begin[many > 0]]))
    z = np.concatenate([a[1:], [len(doc)]])
    d = doc[a]
    return key[anchor[a]], d, anchor[a] - b.off[d], j[a] - b.off[d], z - a


def _anchors(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b in blocks(batches):
            key, doc, _, first, _ = anchored(b)
            yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(b.ids[doc]), pa.array(first)], names=["key", "doc_id", "place"])
    return docs.mapInArrow(run, "key bigint, doc_id bigint, place bigint")


def _suffixes(docs: DataFrame) -> DataFrame:
    """``lead, doc_id, first, before, after``: the bytes that the windows of a repeated anchor cover, around its lead; ``first`` is the first window."""
    def run(batches):
        for batch in batches:
            for b, wanted in with_places(batch):
                _, doc, anchor, first, count = anchored(b)
                raw = b.data.tobytes()
                for keep in np.array_split(np.flatnonzero(np.isin(doc << 40 | first, wanted)), 1 + len(wanted) // _ROWS):
                    begin = b.off[doc[keep]]
                    low, at, high = ((begin + x).tolist() for x in (first[keep], anchor[keep], first[keep] + count[keep] + WINDOW - 1))
                    yield pa.record_batch(
                        [pa.array([raw[x:x + LEAD] for x in at], pa.binary()), pa.array(b.ids[doc[keep]]), pa.array(first[keep]),
                         pa.array([raw[x:y] for x, y in zip(low, at)], pa.binary()), pa.array([raw[x + LEAD:y] for x, y in zip(at, high)], pa.binary())],
                        names=["lead", "doc_id", "first", "before", "after"])
    return docs.mapInArrow(run, _ROW)


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of eight-byte keys: by the first, then only the ties by the next, and so on. Stable."""
    order = np.argsort(words[:, 0], kind="stable")
    group = np.zeros(len(order), np.int64)
    np.cumsum(np.diff(words[order, 0], prepend=words[order[:1], 0]) != 0, out=group)
    for depth in range(1, words.shape[1]):
        tied = np.zeros(len(order), dtype=bool)
        tied[1:] = group[1:] == group[:-1]
        tied[:-1] |= tied[1:].copy()
        t = np.flatnonzero(tied)
        if not len(t):
            break
        value = words[order[t], depth]
        by = np.lexsort((value, group[t]))
        order[t] = order[t][by]
        step = np.zeros(len(order), dtype=bool)
        step[1:] = group[1:] != group[:-1]
        v = np.zeros(len(order), np.uint64)
        v[t] = value[by]
        step[1:] |= (v[1:] != v[:-1]) & ~step[1:]
        group = np.cumsum(step)
    return order


def _side(col: pa.Array, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """The bytes on one side of the leads as rows of eight-byte keys (read backwards, if asked), and their lengths."""
    data, off = text_buffer(col)
    data, length = data[off[0]:off[-1]], np.diff(off)
    padded = np.zeros((len(length), _SIDE), np.uint8)
    padded[np.arange(_SIDE) < length[:, None]] = data
    if backwards:
        from_end = length[:, None] - 1 - np.arange(_SIDE)
        padded = np.where(from_end >= 0, np.take_along_axis(padded, np.maximum(from_end, 0), 1), 0).astype(np.uint8)
    return padded.view(">u8").astype(np.uint64), length


def common_lengths(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it in ``order``; -1 where the first key, a number, differs."""
    now = words[order]
    differ = now[1:] ^ now[:-1]
    first = np.argmax(differ != 0, axis=1)
    value = differ[np.arange(len(first)), first]
    # whole equal bytes at the high end of the first key that differs
    equal = (value[:, None] < (_U(1) << np.arange(56, -1, -8, dtype=np.uint64))).sum(axis=1)
    out = np.full(len(order), -1, np.int64)
    out[1:] = np.where(value == 0, (words.shape[1] - 1) * 8, np.where(first == 0, -1, (first - 1) * 8 + equal))
    return out


def later_in_order(lead: np.ndarray, after: np.ndarray, before: np.ndarray, n_after: np.ndarray, n_before: np.ndarray) -> np.ndarray:
    """``[row, k]``: whether the row's window that begins ``k`` bytes before its lead equals a window of an earlier row."""
    n = len(lead)
    sides = []
    for words in (after, before):
        words = np.concatenate([lead.astype(np.uint64)[:, None], words], axis=1)
        order = multikey_order(words)
        sides.append((order, common_lengths(words, order)))
    (forth, shared_after), (back, shared_before) = sides
    group_after, group_before = np.empty(n, np.int64), np.empty(n, np.int64)
    again = np.zeros((n, _SIDE + 1), dtype=bool)
    for k in range(_SIDE + 1):
        rows = np.flatnonzero((n_before >= k) & (n_after >= _SIDE - k))
        if len(rows) < 2:
            continue
        group_after[forth] = np.cumsum(shared_after < _SIDE - k)
        group_before[back] = np.cumsum(shared_before < k)
        both = group_after[rows] * (n + 1) + group_before[rows]
        by = np.argsort(both, kind="stable")
        both = both[by]
        again[rows[by[1:][both[1:] == both[:-1]]], k] = True
    return again


def _whole_repeats(lead, after, before, n_after, n_before) -> np.ndarray:
    """Rows that equal an earlier row on both sides."""
    words = np.concatenate([(lead.astype(np.uint64) << _U(16) | (n_after << 8 | n_before).astype(np.uint64))[:, None], after, before], axis=1)
    order = multikey_order(words)
    same = np.zeros(len(order), dtype=bool)
    same[order[1:]] = (words[order[1:]] == words[order[:-1]]).all(axis=1)
    return same


def _spans(doc, low, high) -> pa.RecordBatch:
    return pa.record_batch([pa.array(doc), pa.array(low), pa.array(high)], names=["doc_id", "low", "high"])


def _compare(batches):
    """Spans of repeats of rows in the order of lead, document and place."""
    def numbers(held):
        col = held.column(0).combine_chunks()
        data, off = text_buffer(col)
        m = data[off[0]:off[-1]].reshape(len(col), LEAD)
        return np.concatenate([[0], np.cumsum((m[1:] != m[:-1]).any(axis=1))])

    def sides(held):
        (after, n_after), (before, n_before) = (_side(held.column(i).combine_chunks(), i == 3) for i in (4, 3))
        return after, before, n_after, n_before

    def finished(held):
        lead = numbers(held)
        cut = [0]  # chunks of whole leads of about _ROWS rows
        ends = np.append(np.flatnonzero(np.diff(lead)) + 1, len(lead))
        while cut[-1] < len(lead):
            fit = np.searchsorted(ends, cut[-1] + _ROWS, "right")
            here = ends[max(int(fit) - 1, int(np.searchsorted(ends, cut[-1], "right")))]
            cut.append(int(here))
        for x, y in zip(cut, cut[1:]):
            part = held.slice(x, y - x)
            after, before, n_after, n_before = sides(part)
            again = later_in_order(lead[x:y], after, before, n_after, n_before)
            doc, first = np.asarray(part.column(1)), np.asarray(part.column(2))
            edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            row, least = np.nonzero(edge == 1)  # runs of repeated windows, from the one that begins last to the one that begins first
            _, beyond = np.nonzero(edge == -1)
            yield _spans(doc[row], first[row] + n_before[row] - beyond + 1, first[row] + n_before[row] - least + WINDOW)

    held, settled = None, 0  # rows not compared yet; the first `settled` of them hold no whole repeats
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if len(held) - settled < max(_ROWS, settled):
            continue
        lead = numbers(held)
        same = _whole_repeats(lead, *sides(held))
        s = np.flatnonzero(same)
        if len(s):
            gone = held.take(pa.array(s))
            first = np.asarray(gone.column(2))
            n = np.asarray(pc.binary_length(gone.column(3))) + np.asarray(pc.binary_length(gone.column(4))) + LEAD
            yield _spans(np.asarray(gone.column(1)), first, first + n)
            held, lead = held.filter(pa.array(~same)), lead[~same]
        last = int(np.searchsorted(lead, lead[-1]))
        if last:
            yield from finished(held.slice(0, last))
        held = held.slice(last).combine_chunks()
        settled = len(held)
    if held is not None:
        yield from finished(held)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` over bytes, of ``docs(doc_id, text)``; documents without repeats are left out."""
    places = repeats.repeated_places(_anchors(docs), "suffix-anchors")
    rows = _suffixes(one_text(docs.join(places, "doc_id")))
    rows = rows.repartitionByRange("lead").sortWithinPartitions("lead", "doc_id", "first")
    spans = stage(rows.mapInArrow(_compare, repeats.SPANS), "suffix-spans")
    out = stage(repeats.by_document(spans), "suffix-spans")
    discard(places, spans)
    return out


def _cut(batches):
    for batch in batches:
        data, off = text_buffer(batch.column(1))
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for doc, i, spans in zip(batch.column(0).to_pylist(), range(batch.num_rows), batch.column(2).to_pylist()):
            text = data[off[i]:off[i + 1]]
            gone = repeats.covered(len(text), spans or ())
            kept = text[~gone].tobytes()
            runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            for k, v in zip(out, (doc, len(text), len(text) - len(kept), runs, repeats.sha256(kept), kept)):
                out[k].append(v)
        yield pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(),) * 4 + (pa.string(), pa.binary()))], names=list(out))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept``, the bytes that stay."""
    docs = id_text(docs, id_col, text_col)
    return docs.join(repeated_spans(docs), "doc_id", "left").mapInArrow(
        _cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
