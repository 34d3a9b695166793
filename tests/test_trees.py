"""Boosted trees as bit masks, and importance over packed rows, against the model itself and the copies row by row."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from residuum.operators.ordering import shuffle_grid, shuffled_index
from residuum.plans import model as M
from residuum.plans import trees as T


def _rows(spark, n, parts=5):
    h = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m))
    one_in = lambda k, c: F.when(F.pmod("id", F.lit(k)) != 0, c)
    return spark.range(0, n, 1, parts).select(
        (F.col("id") - F.pmod("id", F.lit(2))).alias("venue_id"),                       # each id twice
        one_in(41, 1.0 + 0.1 * h(0, 41) + 0.3 * h(3, 6)).alias("rating"),
        one_in(7, F.log1p(h(1, 700).cast("double"))).alias("log_reviews"), (h(2, 5) == 0).alias("is_chain"),
        one_in(11, h(3, 60)).alias("cluster_density"), F.concat(F.lit("C"), h(4, 30)).alias("category"),
        one_in(13, F.concat(F.lit("A"), h(5, 9))).alias("planning_area"))


@pytest.fixture(scope="module")
def fitted(spark):
    df = _rows(spark, 4000).cache()
    return df, M.fit_gbt(df.na.drop(), M.RETRAIN_FEATURES, max_iter=6)       # a fit refuses missing numbers, a model scores them


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 101, 9973])
def test_tables_give_the_same_permutation(spark, n):
    got = T.Shuffle(n, *shuffle_grid(n), 42, 3, 7)(np.arange(n))
    want = spark.range(n).select("id", shuffled_index(F.col("id"), n, F.lit(42), F.lit(3), F.lit(7)).alias("to")).orderBy("id").collect()
    assert got.tolist() == [r.to for r in want] and sorted(got.tolist()) == list(range(n))


@pytest.mark.parametrize("depth", [0, 1, 5, 8])
def test_masks_predict_what_the_model_predicts(spark, fitted, depth):
    df, _ = fitted
    model = M.fit_gbt(df.na.drop(), M.RETRAIN_FEATURES, max_iter=3, max_depth=depth)
    masks, columns = T.masks_of(model)
    if depth == 8:
        assert max(T._leaves(t) for t in T.parse_trees(model.stages[-1])) > T.LEAVES        # cut into pieces
    rows = model.transform(M.prepare_features(df, M.RETRAIN_FEATURES)).select("prediction", *columns).toPandas()
    got = masks.predict([masks.code(f, rows[c].to_numpy(float)) for f, c in enumerate(columns)])
    assert rows[columns].isna().any().any() and np.allclose(got, rows["prediction"], rtol=1e-12, atol=0)


def test_importance_is_that_of_copies_scored_row_by_row(spark, fitted, monkeypatch):
    df, model = fitted
    df = df.withColumn("venue_id", F.monotonically_increasing_id())          # rows of one id have no set order among each other
    monkeypatch.setattr(T, "SLAB", 150)
    got = {r.feature: r for r in M.permutation_importance(model, df, M.RETRAIN_FEATURES, repeats=3).collect()}
    head = PipelineModel(stages=model.stages[:-2]).transform(M.prepare_features(df, M.RETRAIN_FEATURES))
    cols = [f"{c}_idx" if c in M.CATEGORICAL else c for c in M.RETRAIN_FEATURES]
    base = M.materialize(M.global_row_number(head.select("venue_id", "rating", *cols), ["venue_id"], out="_i").withColumn("_i", F.col("_i") - 1))
    n, tail = base.count(), PipelineModel(stages=model.stages[-2:])
    j = M.permuted_values(base, cols, n, 3).join(base, "_i")
    j = j.withColumns({c: F.when(F.col("_f") == i, F.col("_v")).otherwise(F.col(c)) for i, c in enumerate(cols)})
    error = F.sum((F.col("rating") - F.col("prediction")) ** 2).alias("e")
    own, total = tail.transform(base).select(error).first()[0], base.select(F.var_pop("rating") * n).first()[0]
    drops = {f: [] for f in M.RETRAIN_FEATURES}
    for r in tail.transform(j).groupBy("_f", "_r").agg(error).collect():
        drops[M.RETRAIN_FEATURES[r._f]].append((r.e - own) / total)
    for f, d in drops.items():
        assert got[f].importance_mean == pytest.approx(np.mean(d), rel=1e-9) and got[f].importance_std == pytest.approx(np.std(d), rel=1e-6)


def test_copies_are_packed(spark, fitted):
    """One row for a slab, receiving chunk and feature, not one for each copied value; every value has its place once."""
    _, model = fitted
    masks, columns = T.masks_of(model)
    n, repeats = 70_000, 3
    base = spark.range(0, n, 1, 2).select(F.col("id").alias("_i"), F.lit(3.0).alias("rating"), *[F.lit(0.0).alias(c) for c in columns])
    rows = T.packed_copies(base, "rating", columns, masks, n, shuffle_grid(n), 42, [0, 1, 2, 3, 4], repeats).collect()
    assert len(rows) <= 2 * 2 * 6
    for f in range(5):
        for r in range(repeats):
            to = []
            for x in (x for x in rows if x.f == f):
                per = np.frombuffer(x.n, np.int32)
                to += [x.chunk * T.CHUNK + p for p in np.frombuffer(x.place, np.uint16)[per[:r].sum():per[:r + 1].sum()].tolist()]
            assert sorted(to) == list(range(n))
