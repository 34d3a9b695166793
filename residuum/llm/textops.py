"""Numpy helpers over Arrow batches of texts: blocks, words, hashes, sliding minima.

All work is on UTF-8 bytes of a block of whole documents at a time. Hashes are
64-bit polynomial prefix hashes with a final mix; spans of any length are hashed
in one vectorised step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE_SPLIT = np.ones(256, dtype=bool)
SPACE_SPLIT[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


class Block(NamedTuple):
    ids: np.ndarray
    data: np.ndarray
    off: np.ndarray


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of document i: words first[i] to first[i + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64), so that near hashes do not stay near."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        for name, base in (("_powers", _BASE), ("_inverse", _INVERSE)):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            globals()[name] = np.cumprod(t)
    return _powers, _inverse


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums ``C`` of ``codes[i] * base**i``; feed them to :func:`span_hash`."""
    p, _ = _tables(len(codes))
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * p[:len(codes)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span ``start:end``: equal content gives equal hashes wherever it stands."""
    _, inv = _tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start]
               + (end - start).astype(np.uint64) * _U(0xA0761D6478BD642F))


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and offsets of a string or binary column without nulls, not copied."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(off, kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), o


def blocks(batches: Iterable[pa.RecordBatch], max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole documents of about ``max_bytes``; a longer document is a block of its own."""
    for batch in batches:
        n = batch.num_rows
        ids = np.asarray(batch.column(0))
        data, off = text_buffer(batch.column(1))
        i = 0
        while i < n:
            j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1), i + 4096)
            yield Block(ids[i:j], data[off[i]:off[j]], off[i:j + 1] - off[i])
            i = j


def find_words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes; none crosses a document border."""
    m = is_word[data]
    n = len(m)
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n:
        before[1:], after[:-1] = m[:-1], m[1:]
        before[off[:-1][off[:-1] < n]] = False
        after[off[1:][off[1:] > 0] - 1] = False
    start = np.flatnonzero(m & ~before)
    return Words(start, np.flatnonzero(m & ~after) + 1, np.searchsorted(start, off))


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    return span_hash(prefix_hash(BYTE_CODE[data]), words.start, words.end)


LONG = 256


def word_codes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit code of each whole word: its bytes, eight at a time, through a chain of non-linear mixing steps.

    Unlike a polynomial modulo 2^64 (:func:`word_hashes`), no family of different words is known to share a code. Words
    of more than ``LONG`` bytes take BLAKE2b.
    """
    n = words.end - words.start
    out = mix(n.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(1))
    if not len(n):
        return out
    eight = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    at = np.flatnonzero(n <= LONG)
    done = 0
    while len(at):
        left = np.minimum(n[at] - done, 8).astype(np.uint64)
        part = eight[words.start[at] + done] & (_U(0xFFFFFFFFFFFFFFFF) >> (_U(64) - _U(8) * left))
        out[at] = mix(out[at] ^ mix(part + _U(0x9E3779B97F4A7C15)) + _U(0xA0761D6478BD642F))
        done += 8
        at = at[n[at] > done]
    for i in np.flatnonzero(n > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[words.start[i]:words.end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def sliding(x: np.ndarray, w: int, op=np.minimum) -> np.ndarray:
    """``op`` over each ``w`` consecutive values (length ``len(x) - w + 1``), by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """True where a value is the minimum of at least one window of ``w`` values (all ties)."""
    if len(h) < w:
        return np.zeros(len(h), dtype=bool)
    low = sliding(h, w)
    pad = np.zeros(w - 1, dtype=h.dtype)
    return sliding(np.concatenate([pad, low, pad]), w, np.maximum) == h
