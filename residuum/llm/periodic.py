"""Periodic runs of words: suffix trees of a text and its reversal, longest common extensions, Lyndon roots.

A run is a stretch of words with smallest period ``q`` that no neighbouring word
extends, here of at least ``least`` words and ``exponent`` periods. Every run has a
root that is, in one of two opposite orders of the words, the longest Lyndon word
at its place; so two candidates for each place are enough. The longest Lyndon word
at a place ends before the next place whose suffix is smaller. A candidate is
extended to the right by the longest common extension of two suffixes and to the
left by that of two suffixes of the reversal.

Both trees are built by Ukkonen's algorithm. A walk along each in symbol order
gives the leaves and, between neighbouring leaves, the depth of the node where the
tour turns; a table of range minima over that tour answers the depth of the lowest
common ancestor of any two leaves, and so their common extension, in constant time.
All extensions of a text are asked in one vectorised step.

What the trees are built of. A run of length ``L`` and period ``q`` repeats each of
its pieces of at most ``L - 2 * q + 1`` words at a distance of ``q``, so within a
quarter (one part in ``exponent``) of any stretch that holds the run. Places without
such a repeat cut the text; this is applied again to each piece until little more
falls away. It is exact: no run crosses a cut, and a stretch that holds a run holds
the words that could extend it. Ordinary prose is cut away whole; what remains goes
to the trees.

Work is per document, whole texts, in one narrow pass without a shuffle; memory
grows with the longest document (about 0.5 kB for a word that remains).

Cases: a null or empty text has no words and no run; rows with a null id and
repeated rows each get their row; other columns, of any name, are not read; a text
of one word repeated is one run. Words are compared whole, not by hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

RUN = "struct<start: bigint, length: bigint, period: bigint>"
SCHEMA = f"doc_id bigint, n_words bigint, runs array<{RUN}>, collapsed string"
ROWS = 256
Rewrite = Callable[[int | None, list], list]


def suffix_tree(s: list[int]) -> tuple[list[int], list[int], list[dict | None]]:
    """Ukkonen's tree of ``s``, whose last symbol stands nowhere else: starts and ends of the edges into each node, and its children."""
    n = len(s)
    start, end, link, kids = [0], [0], [0], [{}]
    node = edge = length = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                edge = i
            down = kids[node]
            symbol = s[edge]
            child = down.get(symbol)
            if child is None:
                down[symbol] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                kids.append(None)
                if last:
                    link[last] = node
                    last = 0
            else:
                begin = start[child]
                span = end[child]
                span = (span if span <= i else i + 1) - begin
                if length >= span:
                    node, edge, length = child, edge + span, length - span
                    continue
                if s[begin + length] == c:
                    if last:
                        link[last] = node
                    length += 1
                    break
                middle = len(start)
                start += (begin, i)
                end += (begin + length, n)
                link += (0, 0)
                kids += ({s[begin + length]: child, c: middle + 1}, None)
                down[symbol] = middle
                start[child] = begin + length
                if last:
                    link[last] = middle
                last = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return start, end, kids


def leaf_tour(tree, n: int, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of the leaves, and the depth at which the tour turns before each.

    Symbols rise along the tour, or fall; the last symbol of the text, 0, comes first either way.
    """
    start, end, kids = tree
    suffixes, turns = [], []
    stack = [(0, 0)]
    turn, fresh = 0, False  # fresh: a leaf was just left
    while stack:
        node, above = stack.pop()
        if fresh:
            turn, fresh = above, False
        depth = above + end[node] - start[node]
        down = kids[node]
        if down is None:
            suffixes.append(n - depth)
            turns.append(turn)
            fresh = True
        else:
            order = sorted(down)
            if falling and order[0] == 0:
                order = order[1:] + [0]  # popped last to first
            elif not falling:
                order.reverse()
            stack += [(down[c], depth) for c in order]
    return np.array(suffixes, np.int64), np.array(turns, np.int32)


class Extensions:
    """Longest common extensions of the suffixes of a text in constant time each."""

    def __init__(self, suffixes: np.ndarray, turns: np.ndarray):
        self.rank = np.empty(len(suffixes), np.int64)
        self.rank[suffixes] = np.arange(len(suffixes))
        self.minima = [turns]
        step = 1
        while 2 * step <= len(turns):
            self.minima.append(np.minimum(self.minima[-1][:-step], self.minima[-1][step:]))
            step *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each pair of different suffixes."""
        a, b = self.rank[a], self.rank[b]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = np.flatnonzero(level == k)
            out[m] = np.minimum(self.minima[k][low[m]], self.minima[k][high[m] - (1 << int(k))])
        return out


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one of smaller rank, or the end."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs_of_words(x: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows ``start, length, period`` of the runs of the codes ``x`` (1 and more), by start, then period."""
    n = len(x)
    text = x.tolist()
    tree = suffix_tree([*text, 0])
    rising, turns = leaf_tour(tree, n + 1)
    ahead = Extensions(rising, turns)
    falling = leaf_tour(tree, n + 1, falling=True)[0]
    del tree
    back = Extensions(*leaf_tour(suffix_tree([*text[::-1], 0]), n + 1))
    found = []
    for order in (rising, falling):
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.arange(n + 1)
        period = next_smaller(rank[:n].tolist()) - np.arange(n)
        i = np.flatnonzero((period * exponent <= n) & (np.arange(n) + period < n))
        p = period[i]
        right = ahead(i, i + p)
        left = np.zeros(len(i), np.int64)
        inner = np.flatnonzero(i > 0)
        # the words before i, read backwards, are the suffix n - i of the reversal
        left[inner] = back(n - i[inner], n - i[inner] - p[inner])
        length = left + p + right
        ok = length >= np.maximum(least, exponent * p)
        found.append(np.stack([i - left, length, p], 1)[ok])
    return np.unique(np.concatenate(found), axis=0)[:, [0, 1, 2]]


def stretches(x: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, int]]:
    """Stretches of ``x`` that hold every run (see the head of this module)."""
    k = min(max(least, exponent * q) - 2 * q + 1 for q in range(1, least + 1))
    work = [(0, len(x))]
    while work:
        lo, hi = work.pop()
        n = hi - lo
        if n < least:
            continue
        part = x[lo:hi].astype(np.uint64)
        grams = part[:n - k + 1].copy()  # equal pieces have equal values; unequal ones that do only stay in
        for j in range(1, k):
            grams *= np.uint64(0x9E3779B97F4A7C15)
            grams += part[j:n - k + 1 + j]
        by = np.argsort(grams, kind="stable")
        near = np.flatnonzero((grams[by[1:]] == grams[by[:-1]]) & (by[1:] - by[:-1] <= n // exponent))
        keep = np.zeros(len(grams) + 2, bool)
        keep[by[near] + 1] = keep[by[near + 1] + 1] = True
        edge = np.flatnonzero(keep[1:] != keep[:-1])
        pieces = [(lo + int(a), lo + int(b) + k - 1) for a, b in zip(edge[::2], edge[1::2])]
        if 10 * sum(b - a for a, b in pieces) > 9 * n:
            yield from pieces
        else:
            work += pieces


def document_runs(words: list, least: int, exponent: int) -> np.ndarray:
    """Rows ``start, length, period`` of the runs of a document, by start, then period."""
    if len(words) < least:
        return np.empty((0, 3), np.int64)
    code = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
    x = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
    found = []
    for lo, hi in stretches(x, least, exponent):
        got = runs_of_words(np.unique(x[lo:hi], return_inverse=True)[1] + 1, least, exponent)
        got[:, 0] += lo
        found.append(got)
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 3), np.int64)


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Mask over ``n`` words without those in a run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def find_runs(docs: DataFrame, least: int = 6, exponent: int = 4, rewrite: Rewrite | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, n_words, runs, collapsed``.

    ``runs`` is ordered by start, then period; ``collapsed`` the words left when of every run only the first period
    stays, joined by one space. ``rewrite`` (id, words -> words) may change a document's words before they are searched.
    Words are ``[^\\x20\\x09-\\x0D]+``.
    """
    if least < 2 or exponent < 2:
        raise ValueError("a run has at least 2 words and 2 periods")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                ids, sizes, off, runs, texts = rows.column(0).to_pylist(), [], [0], [], []
                for d, text in zip(ids, rows.column(1).to_pylist()):
                    words = text.split()  # of bytes: at ASCII white space
                    if rewrite:
                        words = rewrite(d, words)
                    found = document_runs(words, least, exponent)
                    if len(found):
                        words_kept = [words[i] for i in np.flatnonzero(kept_words(len(words), found)).tolist()]
                    else:
                        words_kept = words
                    sizes.append(len(words))
                    runs.append(found)
                    off.append(off[-1] + len(found))
                    texts.append(b" ".join(words_kept))
                flat = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(run)))
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), lists,
                                       pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return slim.mapInArrow(search, SCHEMA)


def greatest_run(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equal ones the first in the order of ``runs``."""
    higher = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda a, b: F.when(higher(a, b), b).otherwise(a))


def periodic_tail(doc_id: int | None, words: list) -> list:
    """Fixed rule of the registered query: one id in ten has its words after a place made periodic."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]
