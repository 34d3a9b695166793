"""Property tests: invariants that must hold for any input."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from residuum.operators import spatial as S
from residuum.sources import fixtures as FX
from tests.conftest import SF_SMALL

coords = st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=80)
SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(coords, st.sampled_from([1, 6, 4096]))
def test_density_independent_of_refinement(spark, pts, leaf_pairs):
    """Same counts at every leaf size, and Σ density = 2 · #pairs within r (symmetry)."""
    rows = [(i, float(x) * 10.0, float(y) * 10.0) for i, (x, y) in enumerate(pts)]   # many duplicates
    df = spark.createDataFrame(rows, "venue_id long, x double, y double")
    got = {r.venue_id: r.cluster_density for r in S.cluster_density(df, radius=100.0, leaf_pairs=leaf_pairs).collect()}
    brute = {i: sum(1 for (_, bx, by) in rows if ((ax - bx) ** 2 + (ay - by) ** 2) ** 0.5 <= 100.0) - 1
             for i, ax, ay in rows}
    assert got == brute
    pairs = sum(1 for a in rows for b in rows
                if a[0] < b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 <= 100.0)
    assert sum(got.values()) == 2 * pairs


def test_every_row_gets_exactly_one_area(spark):
    v = FX.venues_fx(spark, SF_SMALL)
    e = S.edges_from_rectangles(FX.areas_fx(spark, SF_SMALL))
    out = S.assign_area(v, e)
    assert out.count() == v.count()
    assert out.select("venue_id").distinct().count() == v.count()
    assert out.where(F.col("planning_area").isNull()).count() == 0


def test_nearest_anchor_never_exceeds_any_anchor_distance(spark):
    from residuum.functions.geo import project_local_m
    v = project_local_m(FX.venues_fx(spark, SF_SMALL))
    a = project_local_m(FX.anchors_fx(spark, SF_SMALL))
    nn = S.nearest_anchor(v, a).select("venue_id", "x", "y", "dist_to_hawker")
    for r in a.orderBy("anchor_id").limit(3).collect():     # three anchors as literals
        d = F.sqrt((F.col("x") - r.x) ** 2 + (F.col("y") - r.y) ** 2)
        assert nn.where(d < F.col("dist_to_hawker") - 1e-6).count() == 0
