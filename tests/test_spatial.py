"""Spatial operators equal brute force, including hot spots and boundary cases."""

import math
import random


from pyspark.sql import functions as F

from residuum.operators import spatial as S


def _brute_density(pts, r):
    out = {}
    for i, (a, ax, ay) in enumerate(pts):
        out[a] = sum(1 for (_, bx, by) in pts if math.sqrt((ax - bx) ** 2 + (ay - by) ** 2) <= r) - 1
    return out


def test_density_equals_brute_force_with_hot_spots(spark):
    rnd = random.Random(7)
    pts = []
    i = 0
    for _ in range(300):                       # spread points
        pts.append((i, rnd.uniform(0, 3000), rnd.uniform(0, 3000))); i += 1
    for _ in range(400):                       # one dense cluster (> leaf size per cell)
        pts.append((i, 1500 + rnd.gauss(0, 60), 1500 + rnd.gauss(0, 60))); i += 1
    for _ in range(150):                       # a hot group of co-located copies
        pts.append((i, 700.0, 700.0)); i += 1
    pts += [(i, 2000.0, 0.0), (i + 1, 2200.0, 0.0)]   # exactly 200 m apart: counted
    df = spark.createDataFrame(pts, "venue_id long, x double, y double")
    got = {r.venue_id: r.cluster_density for r in S.cluster_density(df, leaf_pairs=8).collect()}
    assert got == _brute_density(pts, 200.0)
    assert got[150 + 700 - 1] >= 149


def test_density_null_coordinates(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, None, None), (3, 10.0, 0.0)], "venue_id long, x double, y double")
    got = {r.venue_id: r.cluster_density for r in S.cluster_density(df).collect()}
    assert got == {1: 1, 2: None, 3: 1}


def test_nearest_anchor_equals_brute_force(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.uniform(-5000, 25000), rnd.uniform(-5000, 25000)) for i in range(600)]
    pts.append((600, 100.0, 50.0))
    anchors = [(j, rnd.uniform(0, 20000), rnd.uniform(0, 20000)) for j in range(40)] + [(40, 100.0, 0.0)]
    p = spark.createDataFrame(pts, "venue_id long, x double, y double")
    a = spark.createDataFrame(anchors, "anchor_id long, x double, y double")
    got = {r.venue_id: (r.dist_to_hawker, r.is_hawker) for r in S.nearest_anchor(p, a).collect()}
    for vid, x, y in pts:
        d = min(math.sqrt((x - ax) ** 2 + (y - ay) ** 2) for _, ax, ay in anchors)
        assert abs(got[vid][0] - d) < 1e-9
        assert got[vid][1] == (d < 50.0)
    assert got[600] == (50.0, False)        # exactly 50 m is not flagged


def test_nearest_anchor_without_anchors(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "venue_id long, x double, y double")
    r = S.nearest_anchor(p, None).first()
    assert (r.dist_to_hawker, r.is_hawker) == (9999.0, False)


def _poly_edges(spark):
    # area A: square with a square hole; B: overlaps A's right half; C: multipolygon (two squares)
    sq = lambda x0, y0, x1, y1: [[float(a), float(b)] for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    rows = [("A", 0, [sq(0, 0, 10, 10), sq(4, 4, 6, 6)]),
            ("B", 1, [sq(8, 0, 12, 10)]),
            ("C", 2, [sq(20, 0, 21, 1), sq(22, 0, 23, 1)])]
    polys = spark.createDataFrame(rows, "area string, area_ord long, rings array<array<array<double>>>")
    return S.edges_from_rings(polys)


def test_point_in_polygon_holes_overlap_multi_and_edges(spark):
    pts = [(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 9.0, 5.0), (4, 0.0, 5.0), (5, 10.0, 5.0), (6, 22.5, 0.5),
           (7, 21.5, 0.5), (8, 11.0, 5.0), (9, 5.0, 0.0), (10, 30.0, 30.0)]
    df = spark.createDataFrame(pts, "venue_id long, longitude double, latitude double")
    e = _poly_edges(spark)
    one = {r.venue_id: r.area_within for r in S.point_in_area(df, e, cell=0.7).collect()}
    assert one == {1: "A", 2: None, 3: "A", 4: None, 5: "B", 6: "C", 7: None, 8: "B", 9: None, 10: None}
    fan = S.point_in_area(df, e, cell=0.7, fanout=True)
    assert sorted(r.area_within for r in fan.where("venue_id = 3").collect()) == ["A", "B"]


def test_assign_area_radius_and_cutoffs(spark):
    # one rectangle in degrees near the reference latitude band; points probe the 100 m / 2000 m radii
    rect = spark.createDataFrame([("R", 0, 103.80, 103.82, 1.40, 1.46)],
                                 "area string, area_ord long, x0 double, x1 double, y0 double, y1 double")
    e = S.edges_from_rectangles(rect)
    pts = [(1, 103.81, 1.43),     # inside
           (2, 103.83, 1.43),     # ~1.1 km east, lat ≤ 1.44 → within 2000 m
           (3, 103.8205, 1.45),   # ~55 m east, lat > 1.44 → within 100 m
           (4, 103.822, 1.45),    # ~220 m east, lat > 1.44 → outside
           (5, 103.81, 1.4701),   # beyond the hard cutoff even though near
           (6, 103.85, 1.43),     # ~3.3 km → outside
           (7, 103.80, 1.43)]     # on the west edge: not within, distance 0 → nearest R
    df = spark.createDataFrame(pts, "venue_id long, longitude double, latitude double")
    got = {r.venue_id: r.planning_area for r in S.assign_area(df, e).collect()}
    assert got == {1: "R", 2: "R", 3: "R", 4: "Outside Singapore", 5: "Outside Singapore",
                   6: "Outside Singapore", 7: "R"}
    assert {r.planning_area for r in S.assign_area(df, None).collect()} == {"Unknown"}


def test_one_pass_features_equal_separate_operators(spark):
    from residuum.functions.geo import project_local_m
    from residuum.sources import fixtures as FX
    sf = "/root/testdata/sf0.01"
    v = FX.venues_fx(spark, sf)
    anchors = FX.anchors_fx(spark, sf)
    edges = S.edges_from_rectangles(FX.areas_fx(spark, sf))
    one = S.spatial_features(v, anchors, edges).select(
        "venue_id", "dist_to_hawker", "is_hawker", "cluster_density", "planning_area")
    sep = S.assign_area(S.cluster_density(S.nearest_anchor(project_local_m(v), project_local_m(anchors))), edges)
    sep = sep.select("venue_id", "dist_to_hawker", "is_hawker", "cluster_density", "planning_area")
    assert one.count() == sep.count() == v.count()
    assert one.exceptAll(sep).count() == 0
    none = S.spatial_features(v, None, None).select("dist_to_hawker", "planning_area").distinct().collect()
    assert [(r.dist_to_hawker, r.planning_area) for r in none] == [(9999.0, "Unknown")]


def _inside(rings, x, y):
    """Even-odd over all rings; None on an edge."""
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2) and (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1):
                return None
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


def test_point_in_slanted_polygons_at_every_cell_size(spark):
    """Stars, a hole, overlapping and tiny polygons; sparse and dense cells give the brute-force answer."""
    rnd = random.Random(11)

    def star(cx, cy, r, k):
        pts = [[cx + r * (0.4 if i % 2 else 1) * math.cos(math.pi * i / k + 0.1), cy + r * (0.4 if i % 2 else 1) * math.sin(math.pi * i / k + 0.1)]
               for i in range(2 * k)]
        return pts + pts[:1]
    polys = [("S", 0, [star(5, 5, 4.5, 7), star(5, 5, 1.2, 3)]), ("T", 1, [star(9, 6, 4, 5)]), ("U", 2, [star(20.3, 3.3, 0.05, 4)]),
             ("V", 3, [[[0.0, 10.0], [24.0, 10.5], [24.0, 10.6], [0.0, 10.1], [0.0, 10.0]]])]
    e = S.edges_from_rings(spark.createDataFrame(polys, "area string, area_ord long, rings array<array<array<double>>>"))
    pts = [(rnd.uniform(-1, 25), rnd.uniform(-1, 11)) for _ in range(2500)] + [(20.3 + rnd.gauss(0, 0.05), 3.3 + rnd.gauss(0, 0.05)) for _ in range(300)]
    pts += [(p[0], p[1]) for _, _, rings in polys for ring in rings for p in ring]          # vertices: on an edge
    p = spark.createDataFrame(sorted(set(pts)), "px double, py double")
    want = sorted((x, y, a) for x, y in set(pts) for a, _, rings in polys if _inside(rings, x, y))
    assert len(want) > 350
    for cell in (0.3, 2.0, 40.0):
        got = sorted((r.px, r.py, r.area) for r in S.point_in_area_pairs(p, e, cell).collect())
        assert got == want, cell


def test_edge_rows_grow_with_length_not_with_the_box(spark):
    """A diagonal across the map: cells in proportion to its length, for clipping and for a corridor."""
    e = spark.createDataFrame([("D", 0, 0.0, 0.0, 1000.0, 900.0), ("V", 1, 5.0, 0.0, 5.0, 1000.0), ("H", 2, 1000.0, 7.0, 0.0, 7.0)],
                              "area string, area_ord long, x1 double, y1 double, x2 double, y2 double")
    for reach, most in ((1e-6, 2.2), (1.0, 12.0)):
        rows = {r.area: r["count"] for r in S.cells_along(e, 1.0, reach).groupBy("area").count().collect()}
        assert all(1000 <= n <= most * 1000 + 20 for n in rows.values()), rows
    # every cell within reach is there
    cells = {(r.cx, r.cy) for r in S.cells_along(e.where("area = 'D'"), 10.0, 10.0).collect()}
    for k in range(0, 1000, 3):
        x, y = float(k), 0.9 * k
        for a in range(0, 360, 15):
            assert (math.floor((x + 9.99 * math.cos(a)) / 10), math.floor((y + 9.99 * math.sin(a)) / 10)) in cells


def _rows(frames):
    return sum(f.count() for f in frames)


def test_density_rows_do_not_grow_with_the_pairs_of_dense_groups(spark):
    """Two dense groups one radius apart: the circles' edges run through both. 4 x the points are 16 x the pairs."""
    def made(n, gap):
        rnd = random.Random(n)
        pts = [(i, k * gap + rnd.uniform(-20, 20), rnd.uniform(-20, 20)) for k in (0, 1) for i in range(n)]
        d = S.distinct_points(spark.createDataFrame(pts, "i long, x double, y double"), "x", "y")
        settled, compared, decided = S.density_rounds(d, 200.0, 64)
        counts = {(r.px, r.py): r._n for r in S.density_points(d, 200.0, 64).collect()}
        for _, x, y in pts[::n // 20]:
            assert counts[x, y] == sum(math.sqrt((x - a) ** 2 + (y - b) ** 2) <= 200.0 for _, a, b in pts)
        return _rows(decided) + _rows(compared)
    few, many = made(400, 200.0), made(1600, 200.0)
    assert many < 8 * few and many < 1600 * 1600 / 4
    # apart by more than their size: decided by the cells alone, however many points
    assert made(1600, 260.0) <= 1.3 * made(400, 260.0) + 50


def test_nearest_anchor_with_all_anchors_in_a_hundred_metres(spark):
    rnd = random.Random(2)
    anchors = [(j, 5000 + rnd.uniform(0, 100), 5000 + rnd.uniform(0, 100)) for j in range(3000)] + [(9000, 40000.0, 40000.0)]
    pts = [(i, rnd.uniform(0, 20000), rnd.uniform(0, 20000)) for i in range(700)] + [(1000 + i, 5000 + rnd.uniform(0, 100), 5000 + rnd.uniform(0, 100)) for i in range(700)]
    p = spark.createDataFrame(pts, "venue_id long, x double, y double")
    a = spark.createDataFrame(anchors, "anchor_id long, x double, y double")
    leaves = S.capacity_tree(a.select(F.col("x").alias("px"), F.col("y").alias("py")), 8)
    sizes = [r["count"] for r in leaves.groupBy("node").count().collect()]
    assert sum(sizes) == 3001 and max(sizes) <= 8
    near = S.nearest_leaves(p.select(F.col("x").alias("px"), F.col("y").alias("py")), leaves)
    assert near.count() <= 12 * len(pts)                                      # leaves per point
    assert near.join(leaves, "node").count() <= 40 * len(pts)                 # anchors compared per point, of 3001
    got = {r.venue_id: r.dist_to_hawker for r in S.nearest_anchor(p, a).collect()}
    for vid, x, y in pts:
        assert abs(got[vid] - min(math.sqrt((x - ax) ** 2 + (y - ay) ** 2) for _, ax, ay in anchors)) < 1e-9


def test_capacity_tree_of_ties(spark):
    """Many anchors with one x, and a few far away: every leaf still fits."""
    rows = [(3.0, float(i)) for i in range(500)] + [(1e6, 0.0), (-1e6, 5.0)]
    leaves = S.capacity_tree(spark.createDataFrame(rows, "px double, py double"), 4)
    assert leaves.count() == 502 and max(r["count"] for r in leaves.groupBy("node").count().collect()) <= 4


def test_nearest_anchor_single_and_collinear_anchors(spark):
    import math
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 5000.0, 12000.0)], "venue_id long, x double, y double")
    for anchors in ([(1, 100.0, 100.0)], [(1, 0.0, 50.0), (2, 0.0, 900.0), (3, 0.0, 30000.0)]):
        a = spark.createDataFrame(anchors, "anchor_id long, x double, y double")
        got = {r.venue_id: r.dist_to_hawker for r in S.nearest_anchor(p, a).collect()}
        for vid, x, y in [(1, 0.0, 0.0), (2, 5000.0, 12000.0)]:
            want = min(math.hypot(x - ax, y - ay) for _, ax, ay in anchors)
            assert abs(got[vid] - want) < 1e-9
