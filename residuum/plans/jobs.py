"""The three end-to-end jobs, composed from the operators.

* ``build``   — raw records → features → boosted-tree fit → residuals (+ saved model)
* ``refresh`` — keep-best dedup → keyword labels → external labels for the
  leftovers → refit → residuals, written as a new table version
* ``serve``   — URL coordinates → bounds → dedup → user filters → top-k and the
  per-row tooltip table

Each returns DataFrames (and the model); nothing is collected on the driver
except the model fit itself, which MLlib distributes.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.operators import classify as CL
from residuum.operators.features import dedup_best, is_chain
from residuum.plans import model as M
from residuum.plans import serve as SV
from residuum.plans.preprocess import preprocess
from residuum.session import materialize
from residuum.sources import scan as SC


@dataclass
class Fitted:
    table: DataFrame
    model: PipelineModel


def build(raw: DataFrame, anchors: DataFrame | None, edges: DataFrame | None,
          features: list[str] = M.TRAIN_FEATURES, model_path: str | None = None,
          table_root: str | None = None, **gbt) -> Fitted:
    """Features on the raw rows, fit, and residual for every row with a rating."""
    feats = materialize(preprocess(raw, anchors, edges))
    model = M.fit_gbt(feats, features, **gbt)
    table = M.gbt_residuals(model, feats, features)
    if model_path:
        M.save_model(model, model_path)
    if table_root:
        SC.sink_parquet(table, table_root)
    return Fitted(table, model)


def default_columns(t: DataFrame) -> DataFrame:
    """Model features that a table lacks: review logarithm and chain flag from its own rows, ``DEFAULT_DENSITY`` neighbours."""
    if "log_reviews" not in t.columns:
        t = t.withColumn("log_reviews", C.log_reviews())
    if "is_chain" not in t.columns:
        t = is_chain(t)
    if "cluster_density" not in t.columns:
        t = t.withColumn("cluster_density", F.lit(K.DEFAULT_DENSITY).cast("bigint"))
    return t


def refresh(table: DataFrame, lexicon: dict[str, list[str]] | None,
            classifier: Callable[[str], str] | None, features: list[str] = M.RETRAIN_FEATURES,
            parallelism: int | None = 1, table_root: str | None = None, calls_per_minute: float | None = None,
            answers: str | None = None, anchors: DataFrame | None = None, edges: DataFrame | None = None,
            rebuild: bool = False, basis: str = "raw", **gbt) -> Fitted:
    """Dedup → keyword categories → external labels for ``Other`` → features → refit.

    ``table`` is a previous build's output. Its features are kept (missing ones get ``default_columns``), or, with
    ``rebuild``, computed again from ``anchors`` and ``edges``: with ``basis="raw"`` chain flag and density count the rows
    of ``table`` before deduplication, with ``"current"`` the deduplicated rows (as the original does, by which no name is
    a chain any more). Writes a new version under ``table_root`` instead of overwriting what it read.
    """
    if basis not in ("raw", "current"):
        raise ValueError("basis is raw or current")
    if rebuild and basis == "raw":
        table = materialize(preprocess(table, anchors, edges))
    t = dedup_best(table)
    if rebuild and basis == "current":
        t = preprocess(t, anchors, edges)
    if lexicon:
        t = CL.keyword_classify(t, lexicon)
    if classifier is not None:
        t = CL.batch_inference(t, classifier, parallelism=parallelism, calls_per_minute=calls_per_minute, store=answers)
    t = materialize(default_columns(t.drop("predicted_rating", "residual")))
    model = M.fit_gbt(t, features, **gbt)
    out = M.gbt_residuals(model, t, features)
    if table_root:
        SC.sink_parquet(out, table_root)
    return Fitted(out, model)


def serve(table: DataFrame, spec: SV.FilterSpec = SV.FilterSpec(), k: int = K.TOP_K_SERVE):
    """(top-k list, tooltip rows, visible count, view state) for one filter setting."""
    visible = SV.user_filters(SV.clean_for_serving(table), spec)
    top = SV.top_visible(visible, k)
    tips = SV.tooltip_table(visible)
    count = visible.agg(F.count(F.lit(1)).alias("visible"))
    return top, tips, count, SV.view_state(visible, spec)
