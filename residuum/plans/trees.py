"""A boosted model as bit masks, and permutation importance over packed rows.

``TreeMasks`` holds the trees of a ``GBTRegressionModel`` for numpy. Each value of a feature is a code: a category's
number, or the number of the model's thresholds below a continuous value, so a code decides every split on its feature.
For each code and tree there is a mask with the leaves (at most 32 a tree, larger trees are cut) that the splits on that
feature leave open; the lowest bit that all features leave open is the leaf the row ends in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAVES = 32
DE_BRUIJN = 0x077CB531          # (1 << i) * DE_BRUIJN >> 27 is another number for each i of 32
SLAB = 100_000                  # rows permuted at a time
CHUNK = 1 << 16                 # rows scored together, so a place in a chunk has 16 bits
TREES_AND_ROWS = 1 << 16        # masks looked at together, so that they stay in the processor's cache


@dataclass
class Split:
    """``test`` is the threshold at or below which a value goes left, or the set of categories that do."""
    feature: int
    test: float | frozenset
    left: Split | float
    right: Split | float


def parse_trees(model) -> list[Split | float]:
    """The trees of a boosted model from its ``toDebugString`` (numbers are printed in full), leaves times the tree's weight."""
    trees, lines = [], iter(model.toDebugString.splitlines()[1:])

    def node(weight: float) -> Split | float:
        word, _, rest = next(lines).strip().partition(" ")
        if word == "Predict:":
            return float(rest) * weight
        _, feature, op, test = rest.strip("()").split(" ", 3)
        test = float(test) if op == "<=" else frozenset(int(float(c)) for c in test.strip("{}").split(",") if c)
        left = node(weight)
        next(lines)                                                         # Else
        return Split(int(feature), test, left, node(weight))
    for line in lines:
        if line.strip():
            trees.append(node(float(line.strip().rsplit(" ", 1)[1].rstrip("):"))))
    return trees


def _leaves(t: Split | float) -> int:
    return _leaves(t.left) + _leaves(t.right) if isinstance(t, Split) else 1


def _pieces(t: Split | float, room: int = LEAVES) -> list[Split | float]:
    """Trees of at most ``room`` leaves whose sum is ``t``: a piece is 0 beside the path to its part."""
    if _leaves(t) <= room:
        return [t]
    return ([Split(t.feature, t.test, p, 0.0) for p in _pieces(t.left, room - 1)]
            + [Split(t.feature, t.test, 0.0, p) for p in _pieces(t.right, room - 1)])


class TreeMasks:
    """``arity`` has the number of categories for each feature that is categorical, None for the others; ``cuts`` the
    thresholds that codes count for those, if not just the ones of the trees."""

    def __init__(self, trees: list[Split | float], arity: list[int | None], cuts: list[np.ndarray | None] | None = None):
        pieces = [p for t in trees for p in _pieces(t)]
        self.arity, self.cuts = arity, cuts
        if cuts is None:
            tests: dict[int, set[float]] = {}
            for p in pieces:
                self._thresholds(p, tests)
            self.cuts = [None if a else np.array(sorted(tests.get(f, ()))) for f, a in enumerate(arity)]
        self.codes = [a or len(c) + 1 for a, c in zip(arity, self.cuts)]
        self.masks = [np.full((n, len(pieces)), 0xFFFFFFFF, np.uint32) for n in self.codes]
        self.leaves = np.zeros(len(pieces) * LEAVES)
        self.first = np.arange(len(pieces), dtype=np.uint32) * np.uint32(LEAVES)
        for t, p in enumerate(pieces):
            self._fill(t, p, 0)
        self.dtype = np.min_scalar_type(max(self.codes))
        self.rows_at_once = max(1, TREES_AND_ROWS // max(1, len(pieces)))

    def _thresholds(self, t, tests) -> None:
        if isinstance(t, Split):
            if isinstance(t.test, float):
                tests.setdefault(t.feature, set()).add(t.test)
            self._thresholds(t.left, tests)
            self._thresholds(t.right, tests)

    def _fill(self, t: int, p: Split | float, leaf: int) -> int:
        """Number the leaves of ``p`` from ``leaf`` on; a split that fails closes the leaves on its left."""
        if not isinstance(p, Split):
            self.leaves[t * LEAVES + ((DE_BRUIJN << leaf & 0xFFFFFFFF) >> 27)] = p
            return leaf + 1
        right = self._fill(t, p.left, leaf)
        codes = np.arange(self.codes[p.feature])
        fails = codes > np.searchsorted(self.cuts[p.feature], p.test) if isinstance(p.test, float) else ~np.isin(codes, list(p.test))
        self.masks[p.feature][fails, t] &= np.uint32(0xFFFFFFFF ^ ((1 << right) - (1 << leaf)))
        return self._fill(t, p.right, right)

    def code(self, feature: int, values: np.ndarray) -> np.ndarray:
        """Codes of a feature's values; as in the model, NaN (a missing value) is above every threshold."""
        cuts = self.cuts[feature]
        return (values if cuts is None else np.searchsorted(cuts, values)).astype(self.dtype)

    def total(self, open_: np.ndarray) -> np.ndarray:
        """Sum over the trees of the leaf that ``open_`` (rows x trees, overwritten) leaves open first."""
        low = np.negative(open_)
        low &= open_
        low *= np.uint32(DE_BRUIJN)
        low >>= np.uint32(27)
        low += self.first
        return self.leaves.take(low).sum(axis=1)

    def predict(self, codes: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(codes[0]))
        for at in range(0, len(out), self.rows_at_once):
            rows = slice(at, at + self.rows_at_once)
            open_ = self.masks[0].take(codes[0][rows], axis=0)
            for m, c in zip(self.masks[1:], codes[1:]):
                open_ &= m.take(c[rows], axis=0)
            out[rows] = self.total(open_)
        return out

    def predict_changed(self, codes: list[np.ndarray], values: list[np.ndarray]) -> Iterator[tuple[int, int, slice, np.ndarray]]:
        """(feature, repeat, rows, predictions) with the feature's codes taken from ``values[feature]`` (repeats x rows)."""
        for at in range(0, len(codes[0]), self.rows_at_once):
            rows = slice(at, at + self.rows_at_once)
            own = [m.take(c[rows], axis=0) for m, c in zip(self.masks, codes)]
            for f, m in enumerate(self.masks):
                rest = np.full_like(own[f], 0xFFFFFFFF)
                for g, o in enumerate(own):
                    if g != f:
                        rest &= o
                given = values[f][:, rows]
                if len(m) <= len(given):                # fewer values than repeats: each value once
                    by_code = np.stack([self.total(rest & m[c]) for c in range(len(m))])
                    for r, v in enumerate(given):
                        yield f, r, rows, by_code[v, np.arange(len(v))]
                else:
                    for r, v in enumerate(given):
                        open_ = m.take(v, axis=0)
                        open_ &= rest
                        yield f, r, rows, self.total(open_)


def masks_of(model: PipelineModel) -> tuple[TreeMasks, list[str]]:
    """The masks of a fitted pipeline's boosted trees, and the columns its assembler puts together."""
    columns = model.stages[-2].getInputCols()
    labels = {s.getOutputCol(): len(s.labels) + 1 for s in model.stages[:-2]}
    return TreeMasks(parse_trees(model.stages[-1]), [labels.get(c) for c in columns]), columns


def predicted(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``model.transform(df)`` without the vector column: the indexed categories and ``prediction``, from the masks."""
    masks, columns = masks_of(model)

    def score(*values):
        return pd.Series(masks.predict([masks.code(f, v.to_numpy(float)) for f, v in enumerate(values)]))
    indexed = PipelineModel(stages=model.stages[:-2]).transform(df)
    return indexed.withColumn("prediction", F.pandas_udf(score, "double", F.PandasUDFType.SCALAR)(*[F.col(c).cast("double") for c in columns]))


# ---------------------------------------------------------------------------
# permutations
# ---------------------------------------------------------------------------

_P = [np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotate(x: np.ndarray, k: int) -> np.ndarray:
    return x << np.uint64(k) | x >> np.uint64(64 - k)


def _xxhash64(first: np.ndarray, *rest: int) -> np.ndarray:
    """Spark's ``xxhash64`` of a bigint column and integer constants."""
    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ h >> np.uint64(33)) * _P[1]
        h = (h ^ h >> np.uint64(29)) * _P[2]
        return h ^ h >> np.uint64(32)
    first = first.astype(np.uint64)
    h = np.full_like(first, 42) + _P[4] + np.uint64(8)
    h = mixed(_rotate(h ^ _rotate(first * _P[1], 31) * _P[0], 27) * _P[0] + _P[3])
    for c in rest:
        h = h + _P[4] + np.uint64(4)
        h = mixed(_rotate(h ^ np.full_like(h, c & 0xFFFFFFFF) * _P[0], 23) * _P[1] + _P[2])
    return h.view(np.int64)


class Shuffle:
    """``ordering.shuffled_index`` for the numbers 0 to n-1 and some integer seeds, the hashes of its grid's rows and columns kept as tables."""

    def __init__(self, n: int, a: int, b: int, *seeds: int, rounds: int = 4):
        self.n, self.a, self.b = n, a, b
        self.tables = [np.mod(_xxhash64(np.arange(b if k % 2 == 0 else a), k, *seeds), a if k % 2 == 0 else b) for k in range(rounds)]

    def _once(self, x: np.ndarray) -> np.ndarray:
        r, c = x // self.b, x % self.b
        for k, table in enumerate(self.tables):
            if k % 2 == 0:
                r += table[c]
                r[r >= self.a] -= self.a
            else:
                c += table[r]
                c[c >= self.b] -= self.b
        return r * self.b + c

    def __call__(self, i: np.ndarray) -> np.ndarray:
        x = self._once(i.astype(np.int64))
        while len(out := np.flatnonzero(x >= self.n)):
            x[out] = self._once(x[out])
        return x


# ---------------------------------------------------------------------------
# importance
# ---------------------------------------------------------------------------

_PACKED = "chunk bigint, f int, n binary, place binary, value binary"


def packed_copies(base: DataFrame, label: str, columns: list[str], masks: TreeMasks, n: int, shape: tuple[int, int],
                  seed: int, order: list[int], repeats: int) -> DataFrame:
    """The rows of ``base`` (numbered by ``_i``) and, for each feature and repeat, the codes they get from other rows, by the
    chunk of ``CHUNK`` numbers that receives them.

    For a chunk and the f-th feature of ``order``: how many codes each repeat has in ``value``, the receiving places in the
    chunk in ``place``; for f = -1 the rows themselves: labels in ``n``, codes of all features in ``value``.
    """
    def by_chunk(to: np.ndarray, arrays: list[np.ndarray]):
        chunk = (to // CHUNK).astype(np.min_scalar_type(n // CHUNK))         # short numbers are sorted by radix
        by = np.argsort(chunk, kind="stable")
        chunk, place, arrays = chunk[by], (to[by] % CHUNK).astype(np.uint16), [a[..., by] for a in arrays]
        at = [0, *(np.flatnonzero(np.diff(chunk)) + 1), len(chunk)]
        for lo, hi in pairwise(at):
            yield int(chunk[lo]), place[lo:hi], by[lo:hi], [a[..., lo:hi] for a in arrays]

    def pack(batches):
        shuffles = {}

        def out(i: np.ndarray, y: np.ndarray, codes: np.ndarray):
            rows = [(c, -1, ys.tobytes(), p.tobytes(), cs.tobytes()) for c, p, _, (ys, cs) in by_chunk(i, [y, codes])]
            for f, column in enumerate(order):
                for r in range(repeats):
                    if (f, r) not in shuffles:
                        shuffles[f, r] = Shuffle(n, *shape, seed, f, r)
                to = np.concatenate([shuffles[f, r](i) for r in range(repeats)])
                given = np.tile(codes[column], repeats)
                for c, p, by, (vs,) in by_chunk(to, [given]):
                    per = np.bincount(by // len(i), minlength=repeats).astype(np.int32)
                    rows.append((c, f, per.tobytes(), p.tobytes(), vs.tobytes()))
            names = ("chunk", "f", "n", "place", "value")
            types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 64]), types)], names=names)

        held, rows = [], 0
        for b in batches:
            i, y, *cols = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            held.append((i, y, np.stack([masks.code(f, v) for f, v in enumerate(cols)])))
            rows += len(i)
            if rows >= SLAB:
                yield from out(*(np.concatenate(x, axis=-1) for x in zip(*held)))
                held, rows = [], 0
        if rows:
            yield from out(*(np.concatenate(x, axis=-1) for x in zip(*held)))
    plain = [F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(f"_c{i}") for i, c in enumerate(columns)]
    return base.select("_i", F.col(label).cast("double").alias("_y"), *plain).mapInArrow(pack, _PACKED)


def squared_errors(copies: DataFrame, masks: TreeMasks, n: int, order: list[int], repeats: int) -> DataFrame:
    """(_f, _r, _e): sums of squared errors of ``packed_copies`` by chunk, feature and repeat; _f = -1 for the rows as they are."""
    back = {column: f for f, column in enumerate(order)}

    def score(key, table):
        rows = min(CHUNK, n - key[0].as_py() * CHUNK)
        y, codes = np.empty(rows), np.empty((len(masks.masks), rows), masks.dtype)
        given = np.empty((len(order), repeats, rows), masks.dtype)
        for f, per, place, value in zip(*(table[c].to_pylist() for c in ("f", "n", "place", "value"))):
            place, value = np.frombuffer(place, np.uint16), np.frombuffer(value, masks.dtype)
            if f < 0:
                y[place], codes[:, place] = np.frombuffer(per), value.reshape(len(codes), -1)
            else:
                given[f, np.repeat(np.arange(repeats), np.frombuffer(per, np.int32)), place] = value
        errors = np.zeros((len(order), repeats))
        taken = [given[back[c]] if c in back else given[0, :0] for c in range(len(codes))]
        for column, r, at, p in masks.predict_changed(list(codes), taken):
            errors[back[column], r] += ((y[at] - p) ** 2).sum()
        f, r = (x.ravel() for x in np.indices(errors.shape, np.int32))
        own = ((y - masks.predict(list(codes))) ** 2).sum()
        return pa.table({"_f": pa.array([-1, *f], pa.int32()), "_r": pa.array([0, *r], pa.int32()), "_e": pa.array([own, *errors.ravel()], pa.float64())})
    return copies.groupBy("chunk").applyInArrow(score, "_f int, _r int, _e double")
