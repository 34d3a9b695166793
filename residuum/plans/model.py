"""Expected value, residuals, cross-validation and importance.

Two regressors:

* ``context_residual`` — expected value = shrunken mean of the target over a
  context group, ``(Σ y + λ·ȳ) / (n + λ)``. One ``groupBy`` (partial
  aggregation) joined back on the group keys; the global mean is a scalar
  subquery. Exact, so every downstream operator has a SQL oracle.
* ``fit_gbt`` — MLlib gradient-boosted trees on the original feature sets,
  with categorical features indexed by ``StringIndexer`` (alphabetical codes).

Folds are contiguous in an explicit order (``kfold_contiguous``); permutation
importance permutes by seeded bijections of the row numbers and scores all
(feature, repeat) copies in one pass over packed rows (``trees``).
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.functions import constants as K
from residuum.operators.ordering import global_row_number, shuffle_grid, shuffled_index
from residuum.plans.boosting import PackedTrees
from residuum.plans.trees import masks_of, packed_copies, predicted, squared_errors
from residuum.session import materialize, useful_partitions

TRAIN_FEATURES = ["log_reviews", "price_level_num", "is_chain", "cluster_density",
                  "category_encoded", "planning_area"]
RETRAIN_FEATURES = ["log_reviews", "is_chain", "cluster_density", "category", "planning_area"]
CATEGORICAL = {"category_encoded", "category", "planning_area"}


def _null_safe_join(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    g = groups.select(*[F.col(k).alias(f"_g_{k}") for k in keys],
                      *[c for c in groups.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(g[f"_g_{k}"]) for k in keys])
    return df.join(g, cond, "left").drop(*[f"_g_{k}" for k in keys])


# ---------------------------------------------------------------------------
# M7 — expected value by context
# ---------------------------------------------------------------------------

EXACT = "decimal(38,10)"


def exact_sum(c) -> "F.Column":
    """Order-independent sum: decimal addition is exact, so the result does not
    depend on partitioning or task order (doubles would differ in the last bits)."""
    return F.sum(F.col(c).cast(EXACT) if isinstance(c, str) else c.cast(EXACT))


def context_residual(df: DataFrame, keys: list[str], target: str = "rating", lam: float = 1.0,
                     pred: str = "predicted_rating", res: str = "residual") -> DataFrame:
    """Add ``pred`` = (Σ target + λ·global mean) / (n + λ) per context group and ``res`` = target − pred.

    Sums are exact (decimal), so predictions are the same on every run and layout.
    """
    valid = df.where(F.col(target).isNotNull())
    groups = valid.groupBy(*keys).agg(exact_sum(target).alias("_s"), F.count(F.lit(1)).alias("_n"))
    # global mean from the (small) group table: no second pass over the rows
    gmean = groups.select(F.sum("_s").cast("double") / F.sum("_n").cast("double")).scalar()
    groups = groups.withColumn("_s", F.col("_s").cast("double"))
    j = _null_safe_join(df, groups, keys)
    p = (F.coalesce(F.col("_s"), F.lit(0.0)) + F.lit(lam) * gmean) / (F.coalesce(F.col("_n"), F.lit(0)) + F.lit(lam))
    return j.withColumn(pred, p).withColumn(res, F.col(target) - F.col(pred)).drop("_s", "_n")


def cv_context_residual(df: DataFrame, keys: list[str], fold: str = "fold", target: str = "rating",
                        lam: float = 1.0) -> DataFrame:
    """Out-of-fold predictions of the context model: group and global statistics
    are taken from the other folds (totals minus the fold's own share)."""
    valid = df.where(F.col(target).isNotNull())
    per = valid.groupBy(*keys, fold).agg(exact_sum(target).cast("double").alias("_fs"), F.count(F.lit(1)).alias("_fn"))
    tot = valid.groupBy(*keys).agg(exact_sum(target).cast("double").alias("_ts"), F.count(F.lit(1)).alias("_tn"))
    fold_tot = valid.groupBy(fold).agg(exact_sum(target).alias("_ks"), F.count(F.lit(1)).alias("_kn"))
    # global totals from the per-fold table (one row per fold): no extra pass over the rows
    all_s = fold_tot.select(F.sum("_ks").cast("double")).scalar()
    all_n = fold_tot.select(F.sum("_kn")).scalar()
    fold_tot = fold_tot.withColumn("_ks", F.col("_ks").cast("double"))
    j = _null_safe_join(valid, tot, keys)
    per_r = per.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col(fold).alias("_p_f"), "_fs", "_fn")
    cond = reduce(lambda a, b: a & b, [j[k].eqNullSafe(per_r[f"_p_{k}"]) for k in keys]) & (j[fold] == per_r["_p_f"])
    j = j.join(per_r, cond, "left").join(F.broadcast(fold_tot), fold)
    gm = (all_s - F.col("_ks")) / (all_n - F.col("_kn"))
    s = F.col("_ts") - F.coalesce(F.col("_fs"), F.lit(0.0))
    n = F.col("_tn") - F.coalesce(F.col("_fn"), F.lit(0))
    return j.withColumn("prediction", (s + F.lit(lam) * gm) / (n + F.lit(lam))).select(*df.columns, "prediction")


def fold_rmse(pred: DataFrame, fold: str = "fold", label: str = "rating", prediction: str = "prediction") -> DataFrame:
    e = F.col(label) - F.col(prediction)
    return pred.groupBy(fold).agg(F.sqrt(exact_sum(e * e).cast("double") / F.count(e).cast("double")).alias("rmse"))


def cv_rmse_summary(per_fold: DataFrame) -> DataFrame:
    """mean RMSE and ± 2·population-std over folds."""
    return per_fold.agg(F.avg("rmse").alias("rmse_mean"), (F.stddev_pop("rmse") * 2).alias("rmse_2std"),
                        F.count(F.lit(1)).alias("folds"))


def residual_stats(df: DataFrame, res: str = "residual") -> DataFrame:
    return df.agg(F.avg(res).alias("mean"), F.stddev_samp(res).alias("std"),
                  F.min(res).alias("min"), F.max(res).alias("max"))


# ---------------------------------------------------------------------------
# M1-M6 — MLlib boosted trees
# ---------------------------------------------------------------------------

def prepare_features(df: DataFrame, features: list[str], label: str = "rating") -> DataFrame:
    """Drop rows missing the label or a categorical feature; booleans → double."""
    cats = [f for f in features if f in CATEGORICAL]
    out = df.na.drop(subset=[label, *cats])
    return out.withColumns({f: F.col(f).cast("double") for f in features if f not in CATEGORICAL})


def gbt_pipeline(features: list[str], label: str = "rating", max_iter: int = 100, max_depth: int = 5,
                 max_bins: int = 128, seed: int = K.SEED) -> Pipeline:
    cats = [f for f in features if f in CATEGORICAL]
    nums = [f for f in features if f not in CATEGORICAL]
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", stringOrderType="alphabetAsc",
                         handleInvalid="keep") for c in cats]
    asm = VectorAssembler(inputCols=[f"{c}_idx" for c in cats] + nums, outputCol="features",
                          handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="prediction",
                       maxIter=max_iter, maxDepth=max_depth, maxBins=max_bins, stepSize=0.1,
                       minInstancesPerNode=20, seed=seed)
    return Pipeline(stages=[*idx, asm, gbt])


def ordinal_encode(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    """Alphabetical codes 0..n-1 (NULL and unseen → -1) via ``StringIndexer``."""
    out = out or f"{column}_code"
    m = StringIndexer(inputCol=column, outputCol=out, stringOrderType="alphabetAsc",
                      handleInvalid="keep").fit(df)
    code = F.col(out).cast("bigint")
    return m.transform(df).withColumn(out, F.when(code < len(m.labels), code).otherwise(F.lit(-1).cast("bigint")))


ROWS_PER_TASK = 500_000


def _for_fitting(data: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``data`` in no more partitions than a fit can use (``useful_partitions``).

    A fit of boosted trees passes over the rows several times for each tree, and each pass starts two tasks for each
    partition. Fewer partitions are left as they are.
    """
    data = data.select(*columns)
    return data.coalesce(useful_partitions(data.sparkSession, data.count(), ROWS_PER_TASK))


def _max_bins(data: DataFrame, features: list[str], floor: int = 32) -> int:
    """Bins enough for the largest categorical feature (its categories + the 'unseen' slot)."""
    cats = [f for f in features if f in CATEGORICAL]
    if not cats:
        return floor
    row = data.agg(*[F.countDistinct(c).alias(c) for c in cats]).first()
    return max(floor, max(row[c] for c in cats) + 2)


def fit_gbt(df: DataFrame, features: list[str], label: str = "rating", **kw) -> PipelineModel:
    """The model of ``gbt_pipeline``; its trees are grown on packed rows (``PackedTrees``)."""
    data = prepare_features(df, features, label)
    kw.setdefault("max_bins", _max_bins(data, features))
    pipeline = gbt_pipeline(features, label, **kw)
    *before, trees = pipeline.getStages()
    pipeline.setStages([*before, PackedTrees(trees, before[-1].getInputCols())])
    return pipeline.fit(_for_fitting(data, [label, *features]))


def gbt_residuals(model: PipelineModel, df: DataFrame, features: list[str], label: str = "rating",
                  pred: str = "predicted_rating", res: str = "residual") -> DataFrame:
    scored = predicted(model, prepare_features(df, features, label))
    drop = [c for c in scored.columns if c.endswith("_idx")]
    return (scored.withColumnRenamed("prediction", pred).withColumn(res, F.col(label) - F.col(pred))
                  .drop(*drop))


ROWS_FITTED_TOGETHER = 10_000_000


def cv_gbt(df: DataFrame, features: list[str], fold: str = "fold", label: str = "rating", **kw) -> DataFrame:
    """5-fold CV with user folds; returns (rmse_mean, rmse_2std) like the original report.

    One model is fitted for each fold and scored on the rows it has not seen; no model of all rows is fitted, as none is
    returned. The rows are cached once and each fold filters them. A fit keeps its rows as objects in memory, so folds are
    fitted side by side only as long as their rows together are at most ``ROWS_FITTED_TOGETHER``.
    """
    data = prepare_features(df, features, label)
    kw.setdefault("max_bins", _max_bins(data, features))
    data = _for_fitting(data, [label, *features, fold]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = {r[0]: r[1] for r in data.groupBy(fold).count().collect()}
        folds, rows = max((f for f in sizes if f is not None), default=-1) + 1, sum(sizes.values())
        if folds < 2 or set(sizes) != set(range(folds)):
            raise ValueError(f"folds must be numbered from 0, two or more, none of them empty: {sorted(sizes, key=str)}")
        ev = RegressionEvaluator(labelCol=label, predictionCol="prediction", metricName="rmse")
        estimator = gbt_pipeline(features, label, **kw)

        def rmse(i: int) -> float:
            model = estimator.copy().fit(data.where(F.col(fold) != i))
            return ev.evaluate(model.transform(data.where(F.col(fold) == i)))
        with ThreadPool(max(1, min(folds, ROWS_FITTED_TOGETHER // max(rows, 1)))) as pool:
            found = pool.map(inheritable_thread_target(df.sparkSession)(rmse), range(folds))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame([(float(np.mean(found)), 2.0 * float(np.std(found)))],
                                           "rmse_mean double, rmse_2std double")


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def permuted_values(base: DataFrame, cols: list[str], n: int, repeats: int, seed: int = K.SEED) -> DataFrame:
    """(_f, _r, _i, _v): for each of ``cols`` and repeat, the value that row ``_i`` (numbered 0 to n-1) gets from another row.

    One row for each copied value; ``permutation_importance`` has the same copies packed (``packed_copies``).
    """
    copies = F.array(*[F.struct(F.lit(fi).alias("_f"), F.lit(r).alias("_r"), F.col(c).cast("double").alias("_v"))
                       for fi, c in enumerate(cols) for r in range(repeats)])
    rep = base.select(F.col("_i").alias("_from"), F.inline(copies))
    to = shuffled_index(F.col("_from"), n, F.lit(seed), F.col("_f"), F.col("_r"))
    return rep.select("_f", "_r", to.alias("_i"), "_v")


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], label: str = "rating",
                           repeats: int = K.PERM_REPEATS, seed: int = K.SEED, id_col: str = "venue_id") -> DataFrame:
    """Mean/std drop of R² when one feature is shuffled, per feature (desc by mean).

    Every (feature, repeat) copy is a seeded bijection of the row numbers (``shuffled_index``). The rows are numbered once
    and not copied: codes of the permuted values are packed by the chunk of numbers that receives them, and each chunk is
    scored with the masks of the model's trees, the splits on the other features looked up once for all repeats.
    """
    data = prepare_features(df, features, label)
    feat_stage = PipelineModel(stages=model.stages[:-2])
    head = feat_stage.transform(data)
    masks, columns = masks_of(model)
    base = materialize(global_row_number(head.select(id_col, label, *columns), [id_col], out="_i").withColumn("_i", F.col("_i") - 1))
    order = [columns.index(f"{c}_idx" if c in CATEGORICAL else c) for c in features]
    n = base.count()
    copies = packed_copies(base, label, columns, masks, n, shuffle_grid(n) if n else (1, 1), seed, order, repeats)
    errors = materialize(squared_errors(copies, masks, n, order, repeats).groupBy("_f", "_r").agg(F.sum("_e").alias("_e")))
    mean_y = base.select(F.avg(label)).scalar()
    ss_tot = base.select(F.sum((F.col(label) - mean_y) ** 2)).scalar()
    base_r2 = 1.0 - errors.where("_f < 0").select("_e").scalar() / ss_tot
    per = errors.where("_f >= 0").select("_f", "_r", (F.lit(base_r2) - (1.0 - F.col("_e") / ss_tot)).alias("drop"))
    names = F.element_at(F.array(*[F.lit(f) for f in features]), F.col("_f") + 1)
    return (per.groupBy("_f").agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"))
               .select(names.alias("feature"), "importance_mean", "importance_std")
               .orderBy(F.desc("importance_mean"), "feature"))
