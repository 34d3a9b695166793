"""Plan-shape tests: the physical plans keep the properties the design relies on."""


from residuum.functions.geo import project_local_m
from residuum.operators import classify as CL
from residuum.operators import spatial as S
from residuum.operators.features import dedup_best, is_chain, top_category_bucket
from residuum.operators.ordering import top_k
from residuum.plans.model import context_residual
from residuum.sources import fixtures as FX
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_combined_before_the_shuffle(spark):
    v = FX.venues_fx(spark, SF_SMALL)
    assert "partial_max_by" in plan(dedup_best(v))              # one row per key per map task
    assert "partial_count" in plan(is_chain(v))
    p = plan(context_residual(v, ["category"]))
    assert "partial_sum" in p and "Window" not in p


def test_keyword_scoring_is_map_only(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    p = plan(CL.keyword_classify(docs, {"a": ["la ", "el "], "b": ["com"]}, text="text"))
    assert "Exchange" not in p and "Join" not in p and "BatchEvalPython" not in p


def test_top_k_is_take_ordered(spark):
    v = FX.venues_fx(spark, SF_SMALL)
    assert "TakeOrderedAndProject" in plan(top_k(v, "rating", 20))


def test_top_bucket_broadcasts_only_k_rows(spark):
    p = plan(top_category_bucket(FX.venues_fx(spark, SF_SMALL)))
    assert "BroadcastExchange" in p and "TakeOrderedAndProject" in p


def test_scan_prunes_columns(spark):
    p = plan(FX.venues_fx(spark, SF_SMALL))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderpriority:string>" in p


def test_spatial_plans_use_equi_joins_without_python(spark):
    v = project_local_m(FX.venues_fx(spark, SF_SMALL))
    for df in (S.cluster_density(v), S.nearest_anchor(v, project_local_m(FX.anchors_fx(spark, SF_SMALL)))):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
