"""Hand-written boundary rows for the decisions in SURVEY §2.12."""

import math

import pytest
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.functions.geo import PY_MATH, tm_forward
from residuum.operators import classify as CL
from residuum.operators.features import dedup_best, is_chain, top_category_bucket
from residuum.operators.ordering import global_row_number, kfold_contiguous
from residuum.plans.serve import FilterSpec, bbox_inclusive, lat_band_strict, user_filters


def test_projection_matches_published_grid_coordinates():
    # FIXED VALUES: three anchor points with their published grid easting/northing (metres)
    pts = [(103.850164578087, 1.2844248503218, 29874.82, 29650.7),
           (103.779784899996, 1.43353885680037, 22042.51, 46139.03),
           (103.804715225285, 1.29748567106686, 24816.7, 31094.91)]
    for lon, lat, e, n in pts:
        x, y = tm_forward(lon, lat, PY_MATH)
        assert abs(x - e) < 0.006 and abs(y - n) < 0.006


def test_projection_spark_equals_python(spark):
    df = spark.createDataFrame([(103.85, 1.28), (103.6, 1.45)], "longitude double, latitude double")
    from residuum.functions.geo import project_local_m
    for r in project_local_m(df).collect():
        x, y = tm_forward(r.longitude, r.latitude, PY_MATH)
        assert abs(r.x - x) < 1e-6 and abs(r.y - y) < 1e-6


def test_keyword_ties_and_double_counting(spark):
    lex = {"Western": ["pizza", "cafe"], "Italian": ["pizza", "pasta"], "Thai": ["satay"],
           "Malay": ["satay"], "Chinese": ["canton", "house", "canton"]}
    df = spark.createDataFrame([(1, "pizza place"), (2, "satay stall"), (3, "canton house"), (4, ""), (5, None),
                                (6, "PIZZA pasta")], "id long, name string")
    out = {r.id: r.category for r in CL.keyword_classify(df, lex).collect()}
    assert out == {1: "Western", 2: "Thai", 3: "Chinese", 4: "Other", 5: "Other", 6: "Italian"}
    score = dict(CL.keyword_scores(F.lit("canton house"), lex))["Chinese"]
    assert spark.range(1).select(score).first()[0] == 17


def test_response_parse_validate_and_match(spark):
    text = "\n".join(["Classifications:", "- Foo | Chinese", "Bar Cafe | chinese food", "Baz | Hawker/Western",
                      "Qux | Martian", "no pipe here", "Quux | B | C", " | Thai"])
    resp = spark.createDataFrame([(0, text)], "batch_id long, response string")
    p = CL.response_parse(resp).withColumn("category", CL.label_validate(F.col("raw_category")))
    got = [(r.name, r.category) for r in p.orderBy("line_no").collect()]
    assert got == [("Foo", "Chinese"), ("Bar Cafe", "Chinese"), ("Baz", "Western"), ("Qux", "Other"),
                   ("Quux", "Other"), ("", "Thai")]
    members = spark.createDataFrame([(0, 0, "Alpha"), (0, 1, "Foo Garden"), (0, 2, "Bar Cafe Central"),
                                     (0, 3, "Baz"), (0, 4, "Qux")], "batch_id long, pos int, name string")
    m = {r.name: r.category for r in CL.fuzzy_match(p, members).collect()}
    # empty returned name matches the first original; a later line overwrites an earlier one
    assert m["Alpha"] == "Thai" and m["Foo Garden"] == "Chinese" and m["Bar Cafe Central"] == "Chinese"
    assert m["Baz"] == "Western" and m["Qux"] == "Other"


def test_batch_inference_error_batch_falls_back(spark):
    rows = [(i, f"name {i:03d}", "Other") for i in range(45)]
    df = spark.createDataFrame(rows, "venue_id long, name string, category string")

    def fn(prompt):
        block = prompt.split("Restaurant names:\n", 1)[1].split("\n\nClassifications:", 1)[0]
        names = [ln[2:] for ln in block.split("\n")]
        if "name 020" in names:
            raise RuntimeError("service down")
        return "\n".join(f"{n} | Thai" for n in names)
    out = {r.name: r.category for r in CL.batch_inference(df, fn, parallelism=4, back_off=0.1).collect()}
    assert out["name 000"] == "Thai" and out["name 044"] == "Thai"
    assert out["name 020"] == "Other" and out["name 039"] == "Other"
    assert len(out) == 45


def test_prompt_batches_numbering(spark):
    names = spark.createDataFrame([(f"n{i:02d}",) for i in range(45)], "name string")
    members, batches = CL.prompt_batches(names)
    b = {r.batch_id: r for r in batches.collect()}
    assert sorted(b) == [0, 1, 2] and [b[i].n_names for i in range(3)] == [20, 20, 5]
    assert "- n00\n- n01" in b[0].prompt and b[2].names == ["n40", "n41", "n42", "n43", "n44"]
    assert b[0].prompt.startswith("You are a cuisine classifier for Singapore restaurants. \n")


def test_url_coords(spark):
    df = spark.createDataFrame([(1, "x!3d1.30!4d103.8"), (2, "x!3d1.30"), (3, "x!3d-1.2!4d103"),
                                (4, "x!3d1.2.3!4d103"), (5, None)], "id long, url string")
    la, lo = C.url_coords()
    got = {r.id: (r.a, r.b) for r in df.select("id", la.alias("a"), lo.alias("b")).collect()}
    assert got == {1: (1.3, 103.8), 2: (None, None), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_residual_classes_and_text(spark):
    vals = [0.5, 0.1, 0.0, -0.1, -0.5, 1.234, -0.456, None, float("nan")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, r double")
    df = df.withColumn("r", C.nan_to_null("r"))
    out = df.select("id", C.colour_hex("r").alias("h"), C.value_label("r").alias("l"),
                    C.badge("r").alias("b"), C.gap_text("r").alias("g")).orderBy("id").collect()
    assert [o.h for o in out] == ["#2a9d8f", "#e9c46a", "#f4a261", "#f4a261", "#e76f51", "#2a9d8f",
                                  "#f4a261", "#e76f51", "#e76f51"]
    assert [o.l for o in out][:5] == ["Hidden Gem", "Fair Value", "Fair Value", "Overvalued", "Overvalued"]
    assert out[5].b == "Underrated +1.23" and out[6].b == "Overrated -0.46" and out[2].b == "Underrated +0.00"
    assert out[5].g == "+1.23" and out[6].g == "-0.46" and out[2].g == "0.00"


def test_number_text_is_that_of_the_exact_value(spark):
    vals = [-0.001, -0.004, -0.005, 0.125, -0.125, 0.375, 1.005, 1.115, 2.675, 4.25, 0.05, 0.0, -3.0] + [i / 1000 for i in range(-500, 500, 7)]
    got = spark.createDataFrame([(v,) for v in vals], "r double").select(
        "r", C.fixed_decimal("r", 2).alias("two"), C.fixed_decimal("r", 1).alias("one"), C.badge("r").alias("badge")).collect()
    assert [(g.two, g.one) for g in got] == [("%.2f" % v, "%.1f" % v) for v in vals]
    assert got[0].badge == "Overrated -0.00" and got[3].badge == "Underrated +0.12"


@pytest.mark.parametrize("reviews,density,expect", [
    (19, 4, "very few reviews, low competition nearby"),
    (20, 5, "20 reviews"),
    (99, 40, "99 reviews"),
    (100, 41, "highly competitive area"),
    (500, 10, "its profile"),
    (501, 10, "high popularity (501 reviews)"),
])
def test_explanation_factors(spark, reviews, density, expect):
    df = spark.createDataFrame([(4.5, 0.7, 3.8, reviews, density, "AREA 1", "Other")],
                               "rating double, residual double, predicted_rating double, review_count long, "
                               "cluster_density long, planning_area string, category string")
    s = df.select(C.explanation().alias("e")).first().e
    assert s == (f"With {expect}, similar spots in AREA 1 average 3.8★. "
                 "This place beats expectations at 4.5★ - a true gem!")


def test_explanation_templates(spark):
    rows = [(4.0, r) for r in (0.5, 0.3, 0.0, -0.3, -0.6)]
    df = spark.createDataFrame(rows, "rating double, residual double")
    df = df.select("*", F.lit(None).cast("double").alias("predicted_rating"), F.lit(150).alias("review_count"),
                   F.lit(10).alias("cluster_density"), F.lit(None).cast("string").alias("planning_area"),
                   F.lit("Thai").alias("category"))
    out = [r.e for r in df.select(C.explanation().alias("e")).collect()]
    assert out[0] == "With Thai cuisine, similar spots in this area average 3.5★. This place beats expectations at 4.0★ - a true gem!"
    assert out[1].startswith("Based on Thai cuisine, we'd expect 3.7★. Scoring 4.0★")
    assert out[2] == "Rating of 4.0★ is in line with expectations (4.0★) for Thai cuisine. No surprises here."
    assert out[3].startswith("Given Thai cuisine, similar places score 4.3★.")
    assert out[4].startswith("With Thai cuisine, we'd expect 4.6★. The 4.0★ rating")


def test_bounds(spark):
    df = spark.createDataFrame([(1.15, 103.6), (1.48, 104.05), (1.1499, 103.7), (1.3, 104.0501), (1.2, 99.0)],
                               "latitude double, longitude double")
    assert bbox_inclusive(df).count() == 2
    assert lat_band_strict(df).count() == 2   # 1.3 and 1.2 only: both ends are open


def test_dedup_chain_and_bucket(spark):
    rows = [(1, "a", 5), (2, "a", 9), (3, "a", None), (4, "b", None), (5, "b", None), (6, None, 1), (7, None, 3),
            (8, "a", 9)]
    df = spark.createDataFrame(rows, "venue_id long, name string, review_count long")
    best = {r.name: r.venue_id for r in dedup_best(df).collect()}
    assert best == {"a": 2, "b": 4, None: 7}
    ch = {r.venue_id: r.is_chain for r in is_chain(df).collect()}
    assert ch[1] and not ch[4] and not ch[6]
    cats = spark.createDataFrame([("x",)] * 3 + [("y",)] * 2 + [("z",)] * 2 + [(None,)], "category string")
    got = sorted(r.category_encoded for r in top_category_bucket(cats, k=2).collect())
    assert got == ["Other", "Other", "Other", "x", "x", "x", "y", "y"]


def test_folds_follow_ntile_sizes(spark):
    df = spark.range(13).withColumnRenamed("id", "venue_id")
    f = [r.fold for r in kfold_contiguous(df, ["venue_id"]).orderBy("venue_id").collect()]
    assert f == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 4, 4]
    rn = global_row_number(spark.range(1000).select((999 - F.col("id")).alias("k")), ["k"], out="rn")
    assert all(r.rn == r.k + 1 for r in rn.collect())


def test_user_filters(spark):
    df = spark.createDataFrame([(4.0, 10, 0.6, "Thai", "A"), (3.4, 10, 0.6, "Thai", "A"), (4.0, 4, 0.6, "Thai", "A"),
                                (4.0, 10, 0.4, "Thai", "A"), (4.0, 10, 0.6, "Malay", "B")],
                               "rating double, review_count long, residual double, category string, planning_area string")
    assert user_filters(df).count() == 3
    assert user_filters(df, FilterSpec(gems_only=True)).count() == 2
    assert user_filters(df, FilterSpec(cuisine="Thai", area="A", gems_only=True)).count() == 1
    flagged = df.withColumn("is_hawker", F.col("category") == "Malay")
    assert user_filters(flagged, FilterSpec(hide_anchor_sites=True)).count() == 2


def test_price_and_log(spark):
    df = spark.createDataFrame([("$",), ("$$$$",), ("$$$$$",), (None,)], "price_level string")
    assert [r.p for r in df.select(C.price_level_num().alias("p")).collect()] == [1.0, 4.0, 1.0, 1.0]
    d2 = spark.createDataFrame([(0,), (None,), (99,)], "review_count long")
    got = [r.l for r in d2.select(C.log_reviews().alias("l")).collect()]
    assert got[0] == 0.0 and got[1] == 0.0 and abs(got[2] - math.log(100)) < 1e-12


def test_coord_overrides_later_rule_wins(spark):
    df = spark.createDataFrame([("Hotel L Bistro",), ("luss restaurant & 9 plus bistro",), ("Other",), (None,)],
                               "name string").withColumns({"latitude": F.lit(1.0), "longitude": F.lit(100.0)})
    out = C.coord_overrides(df).collect()
    assert (out[0].latitude, out[0].longitude) == (1.3330, 103.7430)
    assert (out[1].latitude, out[1].longitude) == (1.2830, 103.7810)
    assert (out[2].latitude, out[3].latitude) == (1.0, 1.0)
    w = C.coord_overrides(df, mode="word").collect()
    assert w[0].latitude == 1.3330     # "L Bistro" is a whole word inside "Hotel L Bistro"
    assert K.COORD_OVERRIDES[-1][0] == "L Bistro"
