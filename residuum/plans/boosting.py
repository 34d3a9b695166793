"""Boosted regression trees grown on packed rows: the trees of MLlib's ``GBTRegressor``, without its objects for each row.

The rows are kept as blocks of arrays: a code of one to four bytes for each feature (the category, or the number of
candidate thresholds below the value), the label and the prediction so far. A pass over the blocks adds up rows, labels
and squares by node, feature and code; the driver takes the splits from these sums by MLlib's rules (squared loss,
variance, categories in the order of their means, first best split, equal leaves merged). A tree of depth d takes d
passes. The result is MLlib's own ``GBTRegressionModel``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.plans.trees import Split, TreeMasks
from residuum.session import TASKS_PER_CORE

EPSILON = float(np.finfo(float).eps)
ROWS_IN_BLOCK = 1 << 16         # the arrays made in a pass stay in the processor's cache
BYTES_OF_SUMS = 64_000_000      # sums of one pass; a level with more nodes takes several passes
TREES_BETWEEN = 2               # then the predictions so far are kept; each pass adds the trees since
KEPT_IN_LINEAGE = 10            # then the predictions are made anew from all trees
REDUCED_IN_DRIVER = 64          # partitions
ROWS_PACKED_PER_TASK = 2_000_000
FEWEST_ROWS_PER_TASK = 100_000  # a pass over them takes about as long as starting its task


@dataclass
class Grown:
    """A node: rows, sum and sum of squares of the labels in it, and its split if it has one."""
    sums: np.ndarray
    impurity: float
    valid: bool = True
    gain: float = 0.0
    feature: int = -1
    test: float | frozenset | None = None
    left: Grown | None = None
    right: Grown | None = None

    @property
    def prediction(self) -> float:
        return float(self.sums[1] / self.sums[0]) if self.sums[0] else 0.0


def variance(sums: np.ndarray) -> np.ndarray:
    n, s, q = sums
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


def thresholds(values: np.ndarray, counts: np.ndarray, samples: float, most: int) -> np.ndarray:
    """MLlib's candidate thresholds of a continuous feature: between all its (sorted) values, or ``most`` at equal strides of rows."""
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) <= most:
        return middle
    stride, out, seen = samples / (most + 1), [], float(counts[0])
    target = stride
    for m, c in zip(middle.tolist(), counts[1:].tolist()):
        if abs(seen - target) < abs(seen + c - target):
            out.append(m)
            target += stride
        seen += c
    return np.array(out)


def _sampled(data: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The rows that MLlib samples of a partitioned table to find thresholds."""
    if fraction >= 1.0:
        return data
    spark = data.sparkSession
    first = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    return DataFrame(spark._jsparkSession.createDataFrame(data._jdf.toJavaRDD().sample(False, fraction, first), data._jdf.schema()), spark)


def candidate_cuts(data: DataFrame, columns: list[str], arity: list[int | None], rows: int, max_bins: int, seed: int) -> list[np.ndarray | None]:
    """Thresholds for each continuous column, from the rows that MLlib samples (all of them in a small table).

    As there, zeros are not counted but taken to be what is missing from the expected number of samples.
    """
    numeric = [f for f, a in enumerate(arity) if a is None]
    bins = min(max_bins, rows)
    fraction = min(1.0, max(bins * bins, 10_000) / rows)
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("f"), F.col(columns[f]).alias("v")) for f in numeric]))
    cuts: list[np.ndarray | None] = [None] * len(arity)
    if not numeric:
        return cuts
    found = _sampled(data, fraction, seed).select(each).where("v != 0").groupBy("f", "v").agg(F.count(F.lit(1)).alias("n")).toPandas()
    for f in numeric:
        of = found[found["f"] == f]
        values, counts = of["v"].to_numpy(float), of["n"].to_numpy(float)
        zeros = fraction * rows - counts.sum()
        if len(values) and zeros > EPSILON * counts.sum() * 100:
            values, counts = np.append(values, 0.0), np.append(counts, zeros)
        by = np.argsort(values)
        cuts[f] = thresholds(values[by], counts[by], fraction * rows, bins - 1)
    return cuts


def _pack(masks: TreeMasks):
    def pack(batches):
        held, rows = [], 0

        def out():
            y, *values = (np.concatenate(x) for x in zip(*held))
            if not all(np.isfinite(v).all() for v in (y, *values)):
                raise ValueError("labels and features must not be NaN or infinite")
            codes = np.stack([masks.code(f, v) for f, v in enumerate(values)])
            return pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["codes", "y"])
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False).astype(float) for c in b.columns])
            rows += b.num_rows
            if rows >= ROWS_IN_BLOCK:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()
    return pack


def _masks(tree: Split | float, like: TreeMasks) -> TreeMasks:
    return TreeMasks([tree], like.arity, like.cuts)


def _split_tree(node: Grown, leaf) -> Split | float:
    return leaf(node) if node.left is None else Split(node.feature, node.test, _split_tree(node.left, leaf), _split_tree(node.right, leaf))


def _advance(trees: list[tuple[TreeMasks, float]]):
    def advance(block):
        codes, label, p = block
        for masks, weight in trees:
            p = p + masks.predict(list(codes)) * weight
        return codes, label, p
    return advance


def _sums(place: TreeMasks, nodes: int, first: bool, since: list[tuple[TreeMasks, float]]):
    """Sums (rows, labels, squares) of a partition by feature, node and code; ``place`` gives a row's node plus 1, or 0."""
    def add(blocks):
        total = [np.zeros((3, (nodes + 1) * c)) for c in place.codes]
        for codes, label, p in map(_advance(since), blocks):
            y = label if first else 2.0 * (label - p)
            node, squares = place.predict(list(codes)).astype(np.int64), y * y
            for t, c, code in zip(total, place.codes, codes):
                cell = node * c + code
                t[0] += np.bincount(cell, minlength=t.shape[1])
                t[1] += np.bincount(cell, y, t.shape[1])
                t[2] += np.bincount(cell, squares, t.shape[1])
        yield total
    return add


def _added(blocks: RDD, place: TreeMasks, nodes: int, first: bool, since: list[tuple[TreeMasks, float]]) -> list[np.ndarray]:
    """[feature][sum, node, code] over all blocks."""
    plus = lambda a, b: [x + y for x, y in zip(a, b)]
    parts = blocks.mapPartitions(_sums(place, nodes, first, since))
    if blocks.getNumPartitions() > REDUCED_IN_DRIVER:
        total = parts.treeReduce(plus)
    else:
        total, *rest = parts.collect()
        for r in rest:
            total = plus(total, r)
    return [t.reshape(3, nodes + 1, c)[:, 1:] for t, c in zip(total, place.codes)]


def best_split(node: Grown | None, cells: list[np.ndarray], cuts: list[np.ndarray | None], min_rows: int, may_split: bool) -> Grown:
    """``node`` (None for the root) with the best split of its ``cells`` ([feature][sum, code]), if one gains and it may be split."""
    best = None
    for f, of in enumerate(cells):
        if of.shape[1] < 2:
            continue
        order = None
        if cuts[f] is None:
            with np.errstate(divide="ignore", invalid="ignore"):
                order = np.argsort(np.where(of[0] > 0, of[1] / of[0], np.finfo(float).max), kind="stable")
            of = of[:, order]
        upto = np.cumsum(of, axis=1)
        left, right = upto[:, :-1], upto[:, -1:] - upto[:, :-1]
        if node is None:
            sums = left[:, 0] + right[:, 0]
            node = Grown(sums, float(variance(sums)))
        n = left[0] + right[0]
        gain = node.impurity - left[0] / n * variance(left) - right[0] / n * variance(right)
        gain[(left[0] < min_rows) | (right[0] < min_rows) | ~(gain >= 0.0)] = -np.inf
        k = int(np.argmax(gain))
        if best is None or gain[k] > best[0]:
            best = (float(gain[k]), f, k, order, left[:, k], right[:, k])
    if node is None:                                # no feature has two values
        sums = cells[0].sum(axis=1)
        node = Grown(sums, float(variance(sums)))
    node.valid = best is not None and best[0] >= 0.0
    if node.valid and best[0] > 0.0 and may_split:
        node.gain, node.feature, k, order, left, right = best
        node.test = float(cuts[node.feature][k]) if order is None else frozenset(order[:k + 1].tolist())
        node.left, node.right = (Grown(s, float(variance(s))) for s in (left, right))
    return node


def _merged(node: Grown) -> Grown:
    """Leaves of one parent with the same prediction are one leaf."""
    if node.left is not None:
        left, right = _merged(node.left), _merged(node.right)
        if left.left is None and right.left is None and left.prediction == right.prediction:
            node.left = node.right = node.test = None
    return node


def grow_tree(blocks: RDD, like: TreeMasks, max_depth: int, min_rows: int, first: bool, since: list[tuple[TreeMasks, float]]) -> Grown:
    """A tree of the labels of ``blocks``, or, if not the ``first``, of what the predictions and the trees ``since`` leave of them."""
    most = max(1, BYTES_OF_SUMS // (24 * sum(like.codes)))
    root, level, depth = None, [None], 0
    while level:
        below = []
        for at in range(0, len(level), most):
            some = level[at:at + most]
            number = {id(node): i + 1.0 for i, node in enumerate(some)}
            tree = 1.0 if root is None else _split_tree(root, lambda node: number.get(id(node), 0.0))
            cells = _added(blocks, _masks(tree, like), len(some), first, since)
            for i, node in enumerate(some):
                node = best_split(node, [c[:, i] for c in cells], like.cuts, min_rows, depth < max_depth)
                root = root or node
                if node.left is not None and depth + 1 < max_depth:
                    below += [child for child in (node.left, node.right) if abs(child.impurity) >= EPSILON]
        level, depth = below, depth + 1
    return _merged(root)


def java_model(estimator: GBTRegressor, trees: list[Grown], weights: list[float], arity: list[int | None]) -> GBTRegressionModel:
    """The trees as MLlib's model. Numbers go to the JVM as one array."""
    from pyspark import SparkContext
    sc = SparkContext._active_spark_context
    jvm, gateway = sc._jvm, sc._gateway
    numbers: list[float] = []

    def collect(node: Grown) -> None:
        numbers.extend(node.sums.tolist())
        if node.left is not None:
            if not isinstance(node.test, float):
                numbers.extend(sorted(float(c) for c in node.test))
            collect(node.left)
            collect(node.right)
    for t in trees:
        collect(t)
    held = _py2java(sc, DenseVector(numbers + weights)).toArray()
    slice_, at = jvm.java.util.Arrays.copyOfRange, 0
    tree, spark_tree = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.ml.regression
    calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator

    def taken(n: int):
        nonlocal at
        at += n
        return slice_(held, at - n, at)

    def built(node: Grown):
        stats = calculator(taken(3), int(node.sums[0]))
        if node.left is None:
            return tree.LeafNode(node.prediction, node.impurity if node.valid else -1.0, stats)
        split = (tree.ContinuousSplit(node.feature, node.test) if isinstance(node.test, float)
                 else tree.CategoricalSplit(node.feature, taken(len(node.test)), arity[node.feature]))
        left = built(node.left)
        return tree.InternalNode(node.prediction, node.impurity, node.gain, left, built(node.right), split, stats)
    array = gateway.new_array(spark_tree.DecisionTreeRegressionModel, len(trees))
    for i, t in enumerate(trees):
        array[i] = spark_tree.DecisionTreeRegressionModel(built(t), len(arity))
    model = GBTRegressionModel(spark_tree.GBTRegressionModel(estimator.uid, array, taken(len(weights)), len(arity)))
    return estimator._copyValues(model)


def fit_boosted(estimator: GBTRegressor, data: DataFrame, rows: int, columns: list[str], arity: list[int | None], tasks: int) -> GBTRegressionModel:
    """What ``estimator.fit`` gives for ``columns`` put together as features; ``arity`` has the categories of a column, or None.

    Thresholds come from the partitions of ``data``, as MLlib's sample does; the blocks are made in ``tasks`` of them.
    """
    label, seed = estimator.getLabelCol(), estimator.getSeed()
    plain = data.select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_c{f}") for f, c in enumerate(columns)])
    plain = plain.na.fill(float("nan"))
    cuts = candidate_cuts(plain, [f"_c{f}" for f in range(len(columns))], arity, rows, estimator.getMaxBins(), seed)
    like = TreeMasks([], arity, cuts)
    dtype = like.dtype

    def arrays(row):
        y = np.frombuffer(row[1])
        return np.frombuffer(row[0], dtype).reshape(-1, len(y)), y, np.zeros(len(y))
    base = plain.coalesce(tasks).mapInArrow(_pack(like), "codes binary, y binary").rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)
    trees, weights, done, kept, blocks, before = [], [], [], 0, base, base
    try:
        for m in range(estimator.getMaxIter()):
            if m - kept == TREES_BETWEEN:           # made and kept by the first pass for the tree
                anew = m % (TREES_BETWEEN * KEPT_IN_LINEAGE) == 0
                before, blocks = blocks, base.map(_advance(done[:m])) if anew else blocks.map(_advance(done[kept:m]))
                blocks.persist(StorageLevel.MEMORY_AND_DISK)
                kept = m
            trees.append(grow_tree(blocks, like, estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), not m, done[kept:]))
            weights.append(estimator.getStepSize() if m else 1.0)
            done.append((_masks(_split_tree(trees[-1], lambda node: node.prediction), like), weights[-1]))
            if before is not base:
                before.unpersist()
                before = base
    finally:
        for r in (base, blocks, before):
            r.unpersist()
    return java_model(estimator, trees, weights, arity)


class PackedTrees(Estimator):
    """``trees`` as the last stage of a pipeline, fitted by ``fit_boosted`` on the columns that the stage before put together."""

    def __init__(self, trees: GBTRegressor, columns: list[str]):
        super().__init__()
        self.trees, self.columns = trees, columns

    def _fit(self, dataset: DataFrame) -> GBTRegressionModel:
        rows, cores = dataset.count(), dataset.sparkSession.sparkContext.defaultParallelism
        tasks = max(1, min(TASKS_PER_CORE * cores, -(-rows // FEWEST_ROWS_PER_TASK)), -(-rows // ROWS_PACKED_PER_TASK))
        kinds = [dataset.schema[c].metadata.get("ml_attr", {}) for c in self.columns]
        return fit_boosted(self.trees, dataset, rows, self.columns, [len(k["vals"]) if k.get("type") == "nominal" else None for k in kinds], tasks)
