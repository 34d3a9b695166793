"""Trees grown on packed rows against MLlib's own fit."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from residuum.plans import boosting as B
from residuum.plans import model as M
from residuum.plans.trees import TreeMasks
from residuum.session import shared_path
from tests.test_trees import _rows


def _both(df, features=M.RETRAIN_FEATURES, **kw):
    data = M.prepare_features(df, features)
    kw.setdefault("max_bins", M._max_bins(data, features))
    return M.gbt_pipeline(features, **kw).fit(data.select("rating", *features)), M.fit_gbt(df, features, **kw)


def _shape(model):
    """The trees with numbers apart: the text without them, and the numbers."""
    text = "\n".join(model.stages[-1].toDebugString.splitlines()[1:])
    return re.sub(r"Predict: \S+", "Predict", text), [float(x) for x in re.findall(r"Predict: (\S+)", text)]


@pytest.mark.parametrize("kw", [{}, {"max_depth": 0}, {"max_depth": 1, "max_iter": 13}, {"max_depth": 7}, {"max_bins": 64}])
def test_same_trees_as_mllib(spark, kw):
    want, got = _both(_rows(spark, 3000, 1).na.drop(), **({"max_iter": 4} | kw))
    (a, x), (b, y) = _shape(want), _shape(got)
    assert a == b and np.allclose(x, y, rtol=1e-9, atol=1e-12)
    assert got.stages[-1].treeWeights == want.stages[-1].treeWeights
    named = lambda m: {p.name: v for p, v in m.stages[-1].extractParamMap().items()}
    assert named(got) == named(want)


def test_same_trees_from_many_blocks_and_passes(spark, monkeypatch):
    df = _rows(spark, 3000, 70).na.drop()
    want, _ = _both(df.coalesce(1), max_iter=5)
    monkeypatch.setattr(B, "BYTES_OF_SUMS", 24 * 1000)       # few nodes a pass
    monkeypatch.setattr(B, "REDUCED_IN_DRIVER", 4)
    monkeypatch.setattr(B, "TREES_BETWEEN", 2)
    monkeypatch.setattr(B, "KEPT_IN_LINEAGE", 2)
    monkeypatch.setattr(B, "ROWS_PACKED_PER_TASK", 500)
    _, got = _both(df, max_iter=5)
    (a, x), (b, y) = _shape(want), _shape(got)
    assert a == b and np.allclose(x, y, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("rows", [16_000, 40_000])
def test_same_thresholds_from_a_sample(spark, rows):
    df = _rows(spark, rows, 6).na.drop()
    want, got = _both(df, max_iter=1)
    (a, x), (b, y) = _shape(want), _shape(got)
    assert a == b and np.allclose(x, y, rtol=1e-9, atol=1e-12)


def test_saved_and_loaded_model_is_complete(spark):
    """Node statistics too, which only the saved form shows."""
    want, got = _both(_rows(spark, 2000, 1).na.drop(), max_iter=2)
    flat = lambda m, name: (spark.read.parquet(M.save_model(m, shared_path(spark, name)) + "/stages/3_*/data").select("treeID", "nodeData.*")
                            .orderBy("treeID", "id").select("id", "prediction", "impurity", "gain", "rawCount", "leftChild", "rightChild", F.explode("impurityStats")).toPandas())
    a, b = flat(want, "mllib"), flat(got, "packed")
    assert len(a) and np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_constant_features_and_missing_numbers(spark):
    df = _rows(spark, 300, 1).na.drop().withColumns({c: F.lit(1.0) for c in ("log_reviews", "cluster_density")}).withColumn("is_chain", F.lit(False))
    want, got = _both(df, ["log_reviews", "is_chain", "cluster_density"], max_iter=3)
    assert _shape(want) == _shape(got)
    with pytest.raises(Exception, match="NaN"):
        M.fit_gbt(df.withColumn("log_reviews", F.expr("CASE WHEN venue_id > 100 THEN 1.0D END")), M.RETRAIN_FEATURES, max_iter=1)


def test_thresholds_at_strides():
    assert B.thresholds(np.array([1.0, 2.0, 4.0]), np.array([1.0, 1.0, 1.0]), 3, 2).tolist() == [1.5, 3.0]
    assert B.thresholds(np.arange(8.0), np.ones(8), 8, 3).tolist() == [1.5, 3.5, 5.5]
    assert len(B.thresholds(np.array([5.0]), np.array([9.0]), 9, 3)) == 0


def test_a_row_is_few_bytes(spark):
    """Blocks of arrays are kept, not an object for each row; a fit passes over them, not over the rows."""
    like = TreeMasks([], [30, None], [None, np.arange(60.0)])
    rows = spark.range(0, 200_000, 1, 2).select(F.lit(3.0).alias("_y"), F.col("id") % 30, (F.col("id") % 61).cast("double"))
    blocks = rows.mapInArrow(B._pack(like), "codes binary, y binary").collect()
    assert len(blocks) <= 4 and sum(len(b.codes) + len(b.y) for b in blocks) == 200_000 * 10


def test_residuals_are_the_models(spark):
    df = _rows(spark, 1500, 3)
    model = M.fit_gbt(df.na.drop(), M.RETRAIN_FEATURES, max_iter=5)
    got = M.gbt_residuals(model, df, M.RETRAIN_FEATURES)
    want = model.transform(M.prepare_features(df, M.RETRAIN_FEATURES))
    assert got.columns == [*df.columns, "predicted_rating", "residual"]
    key = ["rating", *M.RETRAIN_FEATURES]
    a = sorted(tuple(map(str, r[:-1])) + (r[-1],) for r in want.select(*key, "prediction").collect())
    b = sorted(tuple(map(str, r[:-1])) + (r[-1],) for r in got.select(*key, "predicted_rating").collect())
    assert [x[:-1] for x in a] == [x[:-1] for x in b] and np.allclose([x[-1] for x in a], [x[-1] for x in b], rtol=1e-12)
    assert got.where("abs(residual - (rating - predicted_rating)) > 1e-12").isEmpty()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "features" not in plan
