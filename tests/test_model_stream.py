"""Model operators (rows-only) and streaming ingest."""

import pytest
from pyspark.sql import functions as F

from residuum.plans import model as M
from residuum.session import shared_path
from residuum.sources import scan as SC
from residuum.sources.schema import VENUES
from residuum.streaming import ingest as ST
from tests.conftest import SF_SMALL


def _train_frame(spark):
    from residuum.catalog import venues
    from residuum.operators.features import is_chain
    v = is_chain(venues(spark, SF_SMALL)).withColumns({
        "log_reviews": F.log1p(F.coalesce(F.col("review_count").cast("double"), F.lit(0.0))),
        "cluster_density": (F.col("venue_id") % 7).cast("bigint"),
        "planning_area": F.concat(F.lit("A"), (F.col("venue_id") % 5).cast("string"))})
    return v


def test_gbt_fit_predict_save_load(spark):
    df = _train_frame(spark)
    model = M.fit_gbt(df, M.RETRAIN_FEATURES, max_iter=5, max_depth=3)
    res = M.gbt_residuals(model, df, M.RETRAIN_FEATURES)
    stats = res.agg(F.avg("residual").alias("m"), F.count(F.lit(1)).alias("n")).first()
    assert stats.n == df.na.drop(subset=["rating", "category", "planning_area"]).count()
    assert abs(stats.m) < 0.05
    path = M.save_model(model, shared_path(spark, "test_model"))
    again = M.gbt_residuals(M.load_model(path), df, M.RETRAIN_FEATURES)
    a = res.select("venue_id", F.col("predicted_rating").alias("p0"))
    b = again.select("venue_id", F.col("predicted_rating").alias("p1"))
    assert a.join(b, "venue_id").where(F.col("p0") != F.col("p1")).count() == 0


def test_rmse_beats_constant_and_importance_shape(spark):
    df = _train_frame(spark)
    model = M.fit_gbt(df, M.RETRAIN_FEATURES, max_iter=5, max_depth=3)
    imp = M.permutation_importance(model, df, M.RETRAIN_FEATURES, repeats=2)
    rows = imp.collect()
    assert sorted(r.feature for r in rows) == sorted(M.RETRAIN_FEATURES)
    assert [r.importance_mean for r in rows] == sorted((r.importance_mean for r in rows), reverse=True)


def test_context_residual_sums_to_zero_without_shrinkage(spark):
    df = _train_frame(spark)
    r = M.context_residual(df, ["category"], lam=0.0)
    per = r.groupBy("category").agg(F.sum("residual").alias("s")).collect()
    assert all(abs(x.s) < 1e-9 for x in per)


def test_ingest_stream_is_incremental_and_idempotent(spark):
    from residuum.catalog import venues
    src = shared_path(spark, "t_arrivals")
    v = venues(spark, SF_SMALL)
    v.where("venue_id % 2 = 0").write.parquet(src + "/part=a")
    sink, ck = shared_path(spark, "t_sink"), shared_path(spark, "t_ck")
    ST.ingest_stream(spark, src, VENUES, sink, ck)
    n1 = ST.read_ingested(spark, sink, VENUES).count()
    v.where("venue_id % 2 = 1").write.parquet(src + "/part=b")
    ST.ingest_stream(spark, src, VENUES, sink, ck)
    ST.ingest_stream(spark, src, VENUES, sink, ck)
    out = ST.read_ingested(spark, sink, VENUES)
    assert n1 == v.where("venue_id % 2 = 0").count()
    assert out.count() == v.count() and out.select("venue_id").distinct().count() == v.count()


def test_stream_dedup_over_many_micro_batches(spark):
    from residuum.catalog import venues
    from residuum.operators.features import dedup_best
    from residuum.streaming import runs as R
    src, table, ck = (shared_path(spark, n) for n in ("t_arr2", "t_best", "t_best_ck"))
    v = venues(spark, SF_SMALL)
    go = lambda: ST.stream_dedup_best(spark, src, VENUES, table, ck, max_files_per_trigger=1, fan_in=3)
    for k in range(5):
        v.where(f"venue_id % 5 = {k}").coalesce(1).write.parquet(f"{src}/p={k}")
        go()
    want = dedup_best(v)
    got = ST.read_best(spark, table, VENUES)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    log = R.entries(spark, table)
    batches = [e for e in log if "merge" not in e["name"]]
    assert len(batches) == 5 and len(log) > 5
    for k, e in enumerate(batches):                                           # a batch writes its own winners alone
        assert e["adds"][0]["rows"] == dedup_best(v.where(f"venue_id % 5 = {k}")).count()
    assert sum(a["rows"] for e in log for a in e["adds"]) <= 3 * v.count()
    go()                                                                      # nothing new: nothing written
    assert R.entries(spark, table) == log
    assert R.vacuum(spark, table, keep=0) == sum(len(e["drops"]) for e in log) > 0
    assert ST.read_best(spark, table, VENUES).exceptAll(want).count() == 0


def test_rows_and_ledger_are_published_together(spark, monkeypatch):
    from residuum.streaming import runs as R
    root = shared_path(spark, "t_ledger")
    seeds = spark.range(10).withColumnRenamed("id", "seed_id")
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "seed_id long, name string")
    ids = spark.createDataFrame([(1, "done"), (2, "done"), (3, "failed")], "seed_id long, status string")

    def die(*_):
        raise RuntimeError("killed")
    with monkeypatch.context() as m:                                          # after the rows and ids, before the log entry
        m.setattr(R, "publish", die)
        try:
            ST.commit_batch(spark, root, "b0", rows, ids)
        except RuntimeError:
            pass
    assert ST.committed_rows(spark, root, rows.schema).count() == 0 and ST.pending_seeds(seeds, ST.ledger(spark, root)).count() == 10

    try:                                                                      # between the two writes
        ST.commit_batch(spark, root, "b0", rows, type("D", (), {"select": lambda *_: die()})())
    except RuntimeError:
        pass
    assert ST.committed_rows(spark, root, rows.schema).count() == 0 and ST.ledger(spark, root).count() == 0
    assert ST.commit_batch(spark, root, "b0", rows, ids) and not ST.commit_batch(spark, root, "b0", rows, ids)
    assert ST.committed_rows(spark, root, rows.schema).exceptAll(rows).count() == 0 and ST.ledger(spark, root).count() == 3
    assert sorted(r.seed_id for r in ST.pending_seeds(seeds, ST.ledger(spark, root)).collect()) == [0, 4, 5, 6, 7, 8, 9]


def test_sink_versions_and_missing_scan(spark):
    root = shared_path(spark, "t_versions")
    df = spark.createDataFrame([(1, "a")], "venue_id long, name string")
    p0 = SC.sink_parquet(df, root)
    p1 = SC.sink_parquet(df.union(df), root)
    assert p0.endswith("v=0") and p1.endswith("v=1")
    assert SC.read_latest(spark, root).count() == 2
    assert SC.scan_parquet(spark, root + "/missing", VENUES).count() == 0


def test_cv_gbt_reports_mean_and_spread(spark):
    from residuum.operators.ordering import kfold_contiguous
    df = kfold_contiguous(_train_frame(spark), ["venue_id"])
    r = M.cv_gbt(df, M.RETRAIN_FEATURES, max_iter=3, max_depth=2).first()
    assert r.rmse_mean > 0 and r.rmse_2std >= 0
    per = M.fold_rmse(M.cv_context_residual(df, ["category"]))
    assert per.count() == 5


def test_cv_gbt_fits_one_model_for_each_fold_and_none_of_all_rows(spark, monkeypatch):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    from residuum.operators.ordering import kfold_contiguous
    df = M.prepare_features(kfold_contiguous(_train_frame(spark), ["venue_id"]), M.RETRAIN_FEATURES).cache()
    sizes = {r.fold: r["count"] for r in df.groupBy("fold").count().collect()}
    pipeline = M.gbt_pipeline(M.RETRAIN_FEATURES, max_iter=2, max_depth=2, max_bins=M._max_bins(df, M.RETRAIN_FEATURES))
    ev = RegressionEvaluator(labelCol="rating", predictionCol="prediction", metricName="rmse")
    want = CrossValidator(estimator=pipeline, estimatorParamMaps=ParamGridBuilder().build(), evaluator=ev, foldCol="fold", numFolds=5).fit(df)
    fitted, fit = [], M.Pipeline._fit
    monkeypatch.setattr(M.Pipeline, "_fit", lambda self, data: fitted.append(data.count()) or fit(self, data))
    got = M.cv_gbt(df, M.RETRAIN_FEATURES, max_iter=2, max_depth=2).first()
    assert sorted(fitted) == sorted(sum(sizes.values()) - n for n in sizes.values())
    assert abs(got.rmse_mean - want.avgMetrics[0]) < 1e-9 and abs(got.rmse_2std - 2 * want.stdMetrics[0]) < 1e-9
    with pytest.raises(ValueError):
        M.cv_gbt(df.where("fold <> 2"), M.RETRAIN_FEATURES, max_iter=2, max_depth=2)


def test_jobs_build_refresh_serve(spark):
    from residuum.catalog import venues
    from residuum.plans import jobs as P
    from residuum.plans.serve import FilterSpec
    from residuum.sources import fixtures as FX
    from residuum.operators import spatial as S
    raw = venues(spark, SF_SMALL)
    edges = S.edges_from_rectangles(FX.areas_fx(spark, SF_SMALL))
    built = P.build(raw, FX.anchors_fx(spark, SF_SMALL), edges, max_iter=3, max_depth=2,
                    table_root=shared_path(spark, "t_build"))
    assert {"residual", "planning_area", "cluster_density", "dist_to_hawker"} <= set(built.table.columns)
    lex = {"Even": ["0", "2", "4"], "Odd": ["1", "3"]}
    classifier = lambda prompt: ""          # answers nothing: leftovers stay Other
    ref = P.refresh(built.table, lex, classifier, max_iter=3, max_depth=2)
    names = ref.table.select("name").where(F.col("name").isNotNull())
    assert names.count() == names.distinct().count()
    assert {r.category for r in ref.table.select("category").distinct().collect()} <= {"Even", "Odd", "Other"}
    top, tips, count, view = P.serve(ref.table, FilterSpec(min_rating=0.0, min_reviews=0), k=5)
    assert top.count() == 5 and tips.count() == count.first().visible
    assert view.first().zoom == 11


def test_geojson_collection_multipolygon_and_fallbacks(spark):
    import json
    import os
    from residuum.operators import spatial as S
    from residuum.sources import geo_files as G
    root = shared_path(spark, "t_geojson")
    os.makedirs(root, exist_ok=True)
    sq = lambda x0, y0, x1, y1: [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "P"}, "geometry": {"type": "Polygon", "coordinates": [sq(0, 0, 2, 2)]}},
        {"type": "Feature", "properties": {"name": "M"},
         "geometry": {"type": "MultiPolygon", "coordinates": [[sq(5, 0, 6, 1)], [sq(7, 0, 8, 1)]]}},
        {"type": "Feature", "properties": {"name": "pt"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}]}
    path = os.path.join(root, "areas.geojson")
    with open(path, "w") as f:
        json.dump(fc, f, indent=2)                      # multi-line document
    feats = G.scan_geojson(spark, path)
    assert feats.count() == 3
    e = S.edges_from_rings(G.geojson_rings(feats))
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 7.5, 0.5), (3, 6.5, 0.5)], "venue_id long, longitude double, latitude double")
    got = {r.venue_id: r.area_within for r in S.point_in_area(pts, e, cell=0.5).collect()}
    assert got == {1: "P", 2: "M", 3: None}
    anchors = G.geojson_points(feats).collect()
    assert [(a.longitude, a.latitude) for a in anchors] == [(1.5, 2.5)]
    assert G.load_anchors(spark, path, None).count() == 1
    assert G.load_areas(spark, os.path.join(root, "missing.geojson")) is None
    seeds = G.load_seeds(spark, None).collect()
    assert [(s.latitude, s.longitude) for s in seeds] == [(1.3521, 103.8198)]


def test_gbt_handles_many_categories(spark):
    df = _train_frame(spark).withColumn("planning_area", F.concat(F.lit("A"), (F.col("venue_id") % 300).cast("string")))
    model = M.fit_gbt(df, M.RETRAIN_FEATURES, max_iter=2, max_depth=2)
    assert M.gbt_residuals(model, df, M.RETRAIN_FEATURES).count() > 0


def test_fits_and_checkpoints_take_few_partitions(spark, monkeypatch):
    from residuum.session import materialize, useful_partitions
    most = useful_partitions(spark, 4000)
    assert most < 90
    wide = spark.range(0, 4000, 1, 90)
    kept = materialize(wide)
    assert kept.rdd.getNumPartitions() <= most and kept.count() == 4000
    fitted, pipeline = [], M.gbt_pipeline

    def noted(*args, **kw):
        p = pipeline(*args, **kw)
        fit = p.fit
        p.fit = lambda data, *a: (fitted.append((data.rdd.getNumPartitions(), data.count())), fit(data, *a))[1]
        return p
    monkeypatch.setattr(M, "gbt_pipeline", noted)
    df = wide.select("id", F.lit(1.0).alias("rating"), (F.col("id") % 3).alias("log_reviews"))
    M.fit_gbt(df, ["log_reviews"], max_iter=1, max_depth=1)
    assert fitted == [(most, 4000)]


def test_batches_of_the_stream_arrive_in_files_of_bounded_size(spark, monkeypatch, tmp_path):
    from residuum import catalog_nosql as C
    from residuum.streaming import runs as R
    spark.range(4000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 900).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority")) \
        .write.parquet(f"{tmp_path}/orders.parquet")
    places = {}

    def noted(session, *parts, **kw):
        return places.setdefault(parts, shared_path(session, *parts, **kw))
    monkeypatch.setattr(C, "shared_path", noted)
    monkeypatch.setattr(C, "ROWS_PER_FILE", 200)
    got = C.q_stream_dedup_best(spark, str(tmp_path))
    sizes = spark.read.parquet(places[("arrivals",)]).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) <= 400
    assert len([e for e in R.entries(spark, places[("best",)]) if "merge" not in e["name"]]) == C.MICRO_BATCHES
    from residuum.operators.features import dedup_best
    want = dedup_best(C.venues(spark, str(tmp_path)))
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
