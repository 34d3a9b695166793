"""Spatial joins expressed as equi-joins on cells and tree nodes.

Catalyst plans a bare distance predicate as a nested-loop join, so every
operator here turns proximity into an equality on keys and keeps the exact
predicate as a post-join filter. Shared rules:

* Work is done on *distinct coordinates* carrying a multiplicity ``w``:
  any number of co-located copies (one hot source, duplicate scrapes) is a
  single row before the first shuffle, and results are joined back at the end.
* No operator emits all pairs of a dense region. The radius count decides pairs
  of quadtree cells as a whole and splits both sides of the undecided ones;
  nearest-neighbour search descends a capacity-split tree of the anchors and
  keeps, per point, only nodes that can still hold the nearest; point in polygon
  looks at the clipped edges of the point's own cell; the nearest polygon looks
  at the edges whose corridor covers that cell.
* There is one path at every size and no fixed number of rounds or levels.
  Whether a side is broadcast is Spark's decision by its size in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from residuum.functions import constants as K
from residuum.functions.geo import euclid, project_local_m, segment_distance
from residuum.session import materialize

AREA_CELL = 0.005       # degrees


def distinct_points(df: DataFrame, x: str, y: str) -> DataFrame:
    """(px, py, w): distinct coordinates with their multiplicity (partial agg before shuffle).

    The NULL group is kept here and dropped by callers after materialising:
    a null test on a computed coordinate would be pushed below its projection
    and inline the whole formula into the filter.
    """
    return df.groupBy(F.col(x).alias("px"), F.col(y).alias("py")).agg(F.count(F.lit(1)).alias("w"))


def _non_null(df: DataFrame) -> DataFrame:
    return df.where(F.col("px").isNotNull() & F.col("py").isNotNull())


# ---------------------------------------------------------------------------
# J2 — radius self-join count
# ---------------------------------------------------------------------------

def cluster_density(df: DataFrame, radius: float = K.DENSITY_RADIUS_M, x: str = "x", y: str = "y",
                    out: str = "cluster_density", leaf_pairs: int = 1024, eps: float | None = None) -> DataFrame:
    """Number of *other* rows within ``radius`` (inclusive, Euclidean, same units as x/y).

    Co-located rows count each other; NULL coordinates count NULL. Exact: equal
    to the brute-force pair count (see ``density_points``).
    """
    d = _non_null(materialize(distinct_points(df, x, y)))
    counts = density_points(d, radius, leaf_pairs, eps)
    return (df.join(counts, (df[x] == counts["px"]) & (df[y] == counts["py"]), "left")
              .withColumn(out, (F.col("_n") - 1).cast("bigint")).drop("px", "py", "_n"))


def density_points(d: DataFrame, radius: float = K.DENSITY_RADIUS_M, leaf_pairs: int = 1024,
                   eps: float | None = None) -> DataFrame:
    """(px, py, _n): total weight within ``radius`` of each distinct point (itself included).

    ``d`` holds distinct, non-null points with weights ``w``. Pairs of quadtree
    cells are decided as a whole, from side ``radius`` downwards: if the farthest
    corners are within the radius each cell is credited with the other's total, if
    the nearest points are beyond it the pair is dropped, if it stands for at most
    ``leaf_pairs`` pairs of points these are compared, and otherwise both cells are
    split and their children paired. Credits are carried by the points and pushed
    down with them; only points of cells that are split again go to the next level,
    and the recursion ends when no pair is left. The rows made grow with the points
    whose circle's edge runs through dense cells (at most with power 1.5 of a dense
    group, when two such groups lie exactly one radius apart), never with its pairs.
    """
    settled, pairs, _ = density_rounds(d, radius, leaf_pairs, eps)
    total = settled[0]
    for part in settled[1:] + pairs:
        total = total.unionByName(part)
    return total.groupBy("px", "py").agg(F.sum("n").alias("_n"))


def _cells_of(d: DataFrame, side: float) -> DataFrame:
    return d.withColumns({"cx": F.floor(F.col("px") / side), "cy": F.floor(F.col("py") / side)})


def _pair_side(cells: DataFrame, s: str) -> DataFrame:
    return cells.select(*[F.col(c).alias(s + c) for c in ("cx", "cy", "n", "w")])


def density_rounds(d: DataFrame, radius: float, leaf_pairs: int, eps: float | None = None
                   ) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """The rounds of ``density_points``: credits of settled points, credits from compared points, decided pairs of cells."""
    eps = radius * 1e-9 if eps is None else eps
    side = float(radius)
    points = _cells_of(d.select("px", "py", "w", F.lit(0).cast("bigint").alias("n")), side)
    cells = points.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
    near = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    pairs = (_pair_side(cells, "a").select("*", F.inline(near))
             .withColumns({"bcx": F.col("acx") + F.col("dx"), "bcy": F.col("acy") + F.col("dy")}).drop("dx", "dy")
             .join(_pair_side(cells, "b"), ["bcx", "bcy"]))
    same = (F.col("acx") == F.col("bcx")) & (F.col("acy") == F.col("bcy"))
    settled, compared, decided = [], [], []
    while True:
        dx, dy = F.abs(F.col("acx") - F.col("bcx")), F.abs(F.col("acy") - F.col("bcy"))
        apart = lambda k: F.greatest(k - 1, F.lit(0)) * side  # noqa: E731, B023
        gap = F.sqrt(apart(dx) * apart(dx) + apart(dy) * apart(dy))
        reach = F.sqrt((dx + 1) * side * (dx + 1) * side + (dy + 1) * side * (dy + 1) * side)
        kind = (F.when(reach <= radius - eps, "full").when(gap > radius + eps, "none")
                .when(F.col("an") * F.col("bn") <= leaf_pairs, "leaf").otherwise("split"))
        pairs = materialize(pairs.withColumn("kind", kind).where("kind != 'none'"))
        decided.append(pairs)
        # what whole cells give each other, and which cells go on
        gives = F.when(F.col("kind") == "full", F.col("bw")), F.when((F.col("kind") == "full") & ~same, F.col("aw"))
        by_cell = (pairs.where("kind != 'leaf'").select(F.inline(F.array(*[
            F.struct(F.col(f"{s}cx").alias("cx"), F.col(f"{s}cy").alias("cy"), g.alias("given"), (F.col("kind") == "split").alias("on"))
            for s, g in zip("ab", gives)])))
            .groupBy("cx", "cy").agg(F.sum("given").alias("given"), F.max("on").alias("on")))
        here = points
        leaf = pairs.where("kind = 'leaf'").select("acx", "acy", "bcx", "bcy")
        side_of = lambda s: here.select(*[F.col(c).alias(s + c) for c in ("cx", "cy", "px", "py", "w")])  # noqa: E731, B023
        met = (leaf.join(side_of("a"), ["acx", "acy"]).join(side_of("b"), ["bcx", "bcy"])
               .where(euclid(F.col("apx"), F.col("apy"), F.col("bpx"), F.col("bpy")) <= radius))
        both = F.array(F.struct(F.col("apx").alias("px"), F.col("apy").alias("py"), F.col("bw").alias("n")),
                       F.struct(F.col("bpx").alias("px"), F.col("bpy").alias("py"), F.when(~same, F.col("aw")).alias("n")))
        compared.append(met.select(F.inline(both)))
        moved = materialize(points.join(by_cell, ["cx", "cy"], "left")
                            .select("px", "py", "w", (F.col("n") + F.coalesce("given", F.lit(0))).alias("n"), F.coalesce("on", F.lit(False)).alias("on"), "cx", "cy"))
        settled.append(moved.where("NOT on").select("px", "py", "n"))
        if moved.where("on").isEmpty():
            return settled, compared, decided
        side /= 2
        points = _cells_of(moved.where("on").select("px", "py", "w", "n"), side)
        cells = points.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))
        up = lambda s: _pair_side(cells, s).withColumns(  # noqa: E731, B023
            {f"{s}px": F.shiftright(f"{s}cx", 1), f"{s}py": F.shiftright(f"{s}cy", 1)})
        split = pairs.where("kind = 'split'").select(F.col("acx").alias("apx"), F.col("acy").alias("apy"), F.col("bcx").alias("bpx"), F.col("bcy").alias("bpy"))
        pairs = (split.join(up("a"), ["apx", "apy"]).join(up("b"), ["bpx", "bpy"])
                 .where("apx != bpx OR apy != bpy OR acx < bcx OR (acx = bcx AND acy <= bcy)")
                 .drop("apx", "apy", "bpx", "bpy"))


# ---------------------------------------------------------------------------
# J1 — nearest anchor distance
# ---------------------------------------------------------------------------

FAN = 16


def nearest_anchor(df: DataFrame, anchors: DataFrame | None, x: str = "x", y: str = "y",
                   ax: str = "x", ay: str = "y", dist_col: str = "dist_to_hawker",
                   flag_col: str = "is_hawker", flag_m: float = K.ANCHOR_FLAG_M, capacity: int = 8) -> DataFrame:
    """Distance to the nearest anchor and ``dist < flag_m``. No anchors ⇒ ``NO_ANCHOR_DIST`` / false."""
    best = nearest_points(df.select(F.col(x).alias("px"), F.col(y).alias("py")).distinct(), anchors, ax, ay, capacity)
    if best is None:
        return df.withColumns({dist_col: F.lit(K.NO_ANCHOR_DIST),
                               flag_col: F.lit(K.NO_ANCHOR_DIST < flag_m)})
    out = df.join(best, (df[x] == best["px"]) & (df[y] == best["py"]), "left")
    return (out.withColumn(dist_col, F.col("d"))
               .withColumn(flag_col, F.col("d") < flag_m)
               .drop("px", "py", "d"))


def nearest_points(points: DataFrame, anchors: DataFrame | None, ax: str = "x", ay: str = "y",
                   capacity: int = 8) -> DataFrame | None:
    """(px, py, d) for distinct points (px, py); None when there are no anchors.

    The anchors are split into leaves of at most ``capacity`` (``capacity_tree``); points descend the tree and are
    compared with the anchors of the leaves that remain (``nearest_leaves``).
    """
    if anchors is None:
        return None
    a = materialize(anchors.select(F.col(ax).alias("px"), F.col(ay).alias("py")).distinct())
    leaves = capacity_tree(_non_null(a), capacity)
    if leaves.isEmpty():
        return None
    near = nearest_leaves(_non_null(materialize(points)), leaves)
    met = near.join(leaves.select("node", F.col("px").alias("ax"), F.col("py").alias("ay")), "node")
    return met.groupBy("px", "py").agg(F.min(euclid(F.col("px"), F.col("py"), F.col("ax"), F.col("ay"))).alias("d"))


def capacity_tree(points: DataFrame, capacity: int) -> DataFrame:
    """(px, py, node) for distinct points: ``node`` is the path of a leaf, a digit (0-3) per level, of equal length everywhere.

    Each round splits every node that holds more than ``capacity`` points into ``FAN`` along the longer side of its box
    (two levels of four), at the approximate quantiles of its points and at the middle of the box (so that every round separates something). The
    splits follow the points, not the box: a dense cluster gets leaves of its own. A round is one aggregate with a
    bounded sketch per node and one join; rounds grow with the logarithm of the points.
    """
    out = points.select("px", "py", F.lit("").alias("node"))
    shares = [i / (FAN - 1) for i in range(1, FAN - 1)]
    while True:
        wide = F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")
        nodes = out.groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1"),
            F.percentile_approx("px", shares).alias("qx"), F.percentile_approx("py", shares).alias("qy")) \
            .select("node", "n", wide.alias("wide"), F.when(wide, F.col("qx")).otherwise(F.col("qy")).alias("q"),
                    F.when(wide, (F.col("x0") + F.col("x1")) / 2).otherwise((F.col("y0") + F.col("y1")) / 2).alias("mid"))
        v = F.when(F.col("wide"), F.col("px")).otherwise(F.col("py"))
        cuts = [F.col("q")[i] for i in range(FAN - 2)] + [F.col("mid")]
        part = sum((c < v).cast("int") for c in cuts)
        more = F.col("n") > capacity
        digits = F.when(more, F.concat((part / 4).cast("int").cast("string"), (part % 4).cast("string"))).otherwise(F.lit("00"))
        split = materialize(out.join(nodes, "node").select("px", "py", F.concat("node", digits).alias("node"), more.alias("more")))
        if split.where("more").isEmpty():
            return out
        out = split.select("px", "py", "node")


def nearest_leaves(points: DataFrame, leaves: DataFrame) -> DataFrame:
    """(px, py, node): for each point the leaves of ``capacity_tree`` that can hold its nearest neighbour.

    Branch and bound, one level of the tree per step: a point joins the nodes it still has, each with the boxes of its (at
    most four) children. A tight box surely holds an anchor within its smallest greatest distance (each side of it
    touches one); children farther away than the least such distance on the way down go. Points are not shuffled where
    the level is small enough for Spark to broadcast.
    """
    depth = leaves.select(F.length("node")).first()[0]
    boxes = materialize(leaves.groupBy("node").agg(
        F.min("px").alias("x0"), F.max("px").alias("x1"), F.min("py").alias("y0"), F.max("py").alias("y1")))
    kept = points.select("px", "py", F.lit("").alias("node"), F.lit(float("inf")).alias("least"))
    px, py = F.col("px"), F.col("py")
    sq = lambda c: c * c

    def bound(b: Column) -> Column:
        dx = F.abs(px - b["x0"]), F.abs(px - b["x1"])
        dy = F.abs(py - b["y0"]), F.abs(py - b["y1"])
        return F.least(sq(F.least(*dx)) + sq(F.greatest(*dy)), sq(F.greatest(*dx)) + sq(F.least(*dy)))
    gap = (sq(F.greatest(F.col("x0") - px, px - F.col("x1"), F.lit(0.0))) + sq(F.greatest(F.col("y0") - py, py - F.col("y1"), F.lit(0.0))))
    for level in range(1, depth + 1):
        children = (boxes.groupBy(F.left("node", F.lit(level)).alias("child")).agg(
            F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
            .groupBy(F.left("child", F.lit(level - 1)).alias("node")).agg(F.collect_list(F.struct("child", "x0", "x1", "y0", "y1")).alias("kids")))
        if level == 1:          # every point has the root: its (at most four) children are constants, not a join on one key
            kids = F.array(*[F.struct(*[F.lit(k[c]).alias(c) for c in ("child", "x0", "x1", "y0", "y1")]) for k in children.first()["kids"]])
            step = kept.withColumn("kids", kids)
        else:
            step = kept.join(children, "node")
        step = step.withColumn("least", F.least("least", *[bound(F.get("kids", F.lit(i))) for i in range(4)]))
        kept = (step.select("px", "py", "least", F.inline("kids")).where(gap <= F.col("least") * (1 + 1e-9))
                .select("px", "py", F.col("child").alias("node"), "least"))
    return kept.select("px", "py", "node")


# ---------------------------------------------------------------------------
# polygons as edges
# ---------------------------------------------------------------------------

def edges_from_rectangles(rects: DataFrame, area: str = "area", ordcol: str = "area_ord") -> DataFrame:
    """Rectangles (x0, x1, y0, y1) → 4 ring edges each, counter-clockwise."""
    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    seg = lambda a, b, c, d: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2"))
    return rects.select(
        F.col(area).alias("area"), F.col(ordcol).cast("bigint").alias("area_ord"), F.lit(0).cast("bigint").alias("ring"),
        F.inline(F.array(seg(x0, y0, x1, y0), seg(x1, y0, x1, y1), seg(x1, y1, x0, y1), seg(x0, y1, x0, y0))))


def edges_from_rings(polys: DataFrame, area: str = "area", ordcol: str = "area_ord",
                     rings: str = "rings") -> DataFrame:
    """``rings: ARRAY<ARRAY<ARRAY<DOUBLE>>>`` (each ring a list of [lon, lat]) → edges.

    Multipolygons and holes are flattened to rings; the even-odd rule over all
    rings gives the right inside test for both.
    """
    r = polys.select(F.col(area).alias("area"), F.col(ordcol).cast("bigint").alias("area_ord"),
                     F.posexplode(F.col(rings)).alias("ring", "pts"))
    return r.select("area", "area_ord", F.col("ring").cast("bigint").alias("ring"),
                    F.inline(F.transform(
                        F.sequence(F.lit(0), F.size("pts") - 2),
                        lambda i: F.struct(F.col("pts")[i][0].alias("x1"), F.col("pts")[i][1].alias("y1"),
                                           F.col("pts")[i + 1][0].alias("x2"), F.col("pts")[i + 1][1].alias("y2")))))


def project_edges(edges: DataFrame, params: dict = K.LOCAL_TM) -> DataFrame:
    """Project edge endpoints to metres (edges stay straight between projected vertices)."""
    e = project_local_m(edges, "x1", "y1", "_mx1", "_my1", params)
    e = project_local_m(e, "x2", "y2", "_mx2", "_my2", params)
    return (e.drop("x1", "y1", "x2", "y2")
             .withColumnsRenamed({"_mx1": "x1", "_my1": "y1", "_mx2": "x2", "_my2": "y2"}))


# ---------------------------------------------------------------------------
# J3 — point in polygon (strict: boundary excluded)
# ---------------------------------------------------------------------------

def cells_along(edges: DataFrame, cell: float, reach: float) -> DataFrame:
    """``edges`` with a row for each grid cell (cx, cy) within ``reach`` of the segment.

    The segment is clipped to each column it touches (widened by ``reach``); the rows of that column are those the clipped
    part, widened by ``reach``, runs through. A segment of length L gets at most about (L / cell + 2) times
    (2 + 2 * reach / cell) + L / cell cells whatever its direction.
    """
    swap = F.col("x1") <= F.col("x2")
    ends = {"_xa": F.least("x1", "x2"), "_xb": F.greatest("x1", "x2"),
            "_ya": F.when(swap, F.col("y1")).otherwise(F.col("y2")), "_yb": F.when(swap, F.col("y2")).otherwise(F.col("y1"))}
    e = edges.withColumns(ends)
    e = e.withColumn("cx", F.explode(F.sequence(F.floor((F.col("_xa") - reach) / cell), F.floor((F.col("_xb") + reach) / cell))))
    run, rise = F.col("_xb") - F.col("_xa"), F.col("_yb") - F.col("_ya")

    def height(x: Column, flat: Column) -> Column:
        t = F.least(F.greatest((x - F.col("_xa")) / run, F.lit(0.0)), F.lit(1.0))
        return F.when(run > 0, F.col("_ya") + t * rise).otherwise(flat)
    left = height(F.col("cx") * cell - reach, F.col("_ya"))
    right = height((F.col("cx") + 1) * cell + reach, F.col("_yb"))
    e = e.withColumns({"_l": left, "_r": right})
    rows = F.sequence(F.floor((F.least("_l", "_r") - reach) / cell), F.floor((F.greatest("_l", "_r") + reach) / cell))
    return e.withColumn("cy", F.explode(rows)).drop("_xa", "_xb", "_ya", "_yb", "_l", "_r")


# reference points of the cells, as shares of the side; the first that no edge touches is taken
REFERENCES = [(0.381966011, 0.618033989), (0.414213562, 0.267949192), (0.732050808, 0.236067977), (0.162277660, 0.872983346),
              (0.645751311, 0.449489743), (0.316624790, 0.123105626), (0.557438524, 0.795831523), (0.851640713, 0.385164807)]
BLOCK_BITS, BLOCK_LEVELS = 5, 5


def _side_of(x: Column, y: Column) -> Column:
    """Positive, negative or zero: on which side of the edge (x, y) lies."""
    return (F.col("x2") - F.col("x1")) * (y - F.col("y1")) - (F.col("y2") - F.col("y1")) * (x - F.col("x1"))


def _on_edge(x: Column, y: Column) -> Column:
    return ((x >= F.least("x1", "x2")) & (x <= F.greatest("x1", "x2")) &
            (y >= F.least("y1", "y2")) & (y <= F.greatest("y1", "y2")) & (_side_of(x, y) == 0.0))


def _covering_blocks(edges: DataFrame, cell: float, rx: float, ry: float) -> DataFrame:
    """(cy, level, block, area, area_ord): the runs of cells in a row whose reference point a polygon covers.

    The line through the references of row ``cy`` meets the polygon's edges; sorted, every other gap is inside. The cells
    of such a gap are given as blocks of 32^level cells, so a wide polygon takes few rows.
    """
    y = (F.col("cy") + ry) * cell
    rows = F.sequence(F.floor(F.least("y1", "y2") / cell) - 1, F.floor(F.greatest("y1", "y2") / cell) + 1)
    met = (edges.where("y1 != y2").withColumn("cy", F.explode(rows)).where((F.col("y1") > y) != (F.col("y2") > y))
           .select("cy", "area", "area_ord", (F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x")))
    line = Window.partitionBy("cy", "area", "area_ord").orderBy("x")
    gaps = met.withColumns({"k": F.row_number().over(line), "to": F.lead("x").over(line)}).where("k % 2 = 1 AND to IS NOT NULL")

    def first_cell(x: str) -> Column:
        """The first cell whose reference is at ``x`` or beyond, by the same product as everywhere else."""
        c = F.floor(F.col(x) / cell) - 1
        at = lambda i: (c + i + rx) * cell >= F.col(x)
        return F.when(at(0), c).when(at(1), c + 1).when(at(2), c + 2).otherwise(c + 3)
    spans = gaps.select("cy", "area", "area_ord", first_cell("x").alias("lo"), (first_cell("to") - 1).alias("hi")).where("lo <= hi")
    size = 1 << BLOCK_BITS
    blocks = None
    for level in range(BLOCK_LEVELS):
        up_lo, up_hi = F.shiftright(F.col("lo") + (size - 1), BLOCK_BITS), F.shiftright(F.col("hi") + 1, BLOCK_BITS) - 1
        whole = (up_lo > up_hi) if level < BLOCK_LEVELS - 1 else F.lit(True)
        ends = F.concat(F.when(F.col("lo") < up_lo * size, F.sequence(F.col("lo"), up_lo * size - 1)).otherwise(F.array().cast("array<bigint>")),
                        F.when(F.col("hi") >= (up_hi + 1) * size, F.sequence((up_hi + 1) * size, F.col("hi"))).otherwise(F.array().cast("array<bigint>")))
        here = spans.select("cy", F.lit(level).alias("level"), F.explode(F.when(whole, F.sequence("lo", "hi")).otherwise(ends)).alias("block"), "area", "area_ord")
        blocks = here if blocks is None else blocks.unionByName(here)
        spans = spans.where(~whole).select("cy", "area", "area_ord", up_lo.alias("lo"), up_hi.alias("hi"))
    return blocks


def point_in_area_pairs(pts: DataFrame, edges: DataFrame, cell: float = AREA_CELL) -> DataFrame:
    """(px, py, area, area_ord) for every polygon strictly containing the point.

    Each grid cell has a reference point. Which polygons cover it is found once per occupied cell; a point of the cell is
    in the same polygons, except where edges run between the two, and such edges run through the cell: crossings of the
    segment from point to reference are counted over the cell's own edges. A point on an edge is not within. Edge rows
    grow with the length of the boundary in cells (``cells_along``), cover rows with the rows of cells a polygon spans
    and with the occupied cells, point rows with the points.
    """
    g = float(cell)
    along = materialize(cells_along(edges.select("area", "area_ord", "x1", "y1", "x2", "y2"), g, g * 1e-6))
    for rx, ry in REFERENCES:
        refx, refy = (F.col("cx") + rx) * g, (F.col("cy") + ry) * g
        if along.where(_on_edge(refx, refy)).isEmpty():
            break
    else:
        raise ValueError("edges touch every reference point; choose another cell size")
    p = pts.select("px", "py", F.floor(F.col("px") / g).alias("cx"), F.floor(F.col("py") / g).alias("cy"))
    occupied = p.select("cx", "cy").distinct()
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("cx", BLOCK_BITS * i).alias("block")) for i in range(BLOCK_LEVELS)])
    cover = (occupied.select("cx", "cy", F.inline(levels)).join(_covering_blocks(edges, g, rx, ry), ["cy", "level", "block"])
             .select("cx", "cy", "area", "area_ord"))
    cover = materialize(cover)
    p = materialize(p.join(along.select("cx", "cy").distinct().withColumn("edged", F.lit(True)), ["cx", "cy"], "left"))
    plain = p.where("edged IS NULL").join(cover, ["cx", "cy"]).select("px", "py", "area", "area_ord")
    q = p.where("edged").select("px", "py", "cx", "cy")
    px, py = F.col("px"), F.col("py")
    seg = lambda x, y: (refx - px) * (F.col(y) - py) - (refy - py) * (F.col(x) - px) > 0
    crosses = ((_side_of(px, py) > 0) != (_side_of(refx, refy) > 0)) & (seg("x1", "y1") != seg("x2", "y2"))
    met = (q.join(along, ["cx", "cy"])
           .select("px", "py", "area", "area_ord", crosses.cast("int").alias("c"), _on_edge(px, py).alias("on")))
    base = q.join(cover, ["cx", "cy"]).select("px", "py", "area", "area_ord", F.lit(1).alias("c"), F.lit(False).alias("on"))
    near = (met.unionByName(base).groupBy("px", "py", "area", "area_ord").agg(F.sum("c").alias("c"), F.max("on").alias("on"))
            .where("c % 2 = 1 AND NOT on").select("px", "py", "area", "area_ord"))
    return plain.unionByName(near)


def point_in_area(df: DataFrame, edges: DataFrame, lon: str = "longitude", lat: str = "latitude",
                  out: str = "area_within", cell: float = AREA_CELL, fanout: bool = False) -> DataFrame:
    """Left join: the polygon containing each row (NULL if none).

    Overlapping polygons: one row per input row with the first polygon in
    polygon order, or one row per match when ``fanout``.
    """
    pts = df.select(F.col(lon).alias("px"), F.col(lat).alias("py")) \
            .where(F.col("px").isNotNull() & F.col("py").isNotNull()).distinct()
    hits = point_in_area_pairs(pts, edges, cell)
    if not fanout:
        hits = hits.groupBy("px", "py").agg(F.min_by("area", "area_ord").alias("area"))
    hits = hits.select("px", "py", F.col("area").alias(out))
    return df.join(hits, (df[lon] == hits["px"]) & (df[lat] == hits["py"]), "left").drop("px", "py")


# ---------------------------------------------------------------------------
# J4 — nearest polygon within a per-row radius (metres)
# ---------------------------------------------------------------------------

def nearest_area_pairs(pts_m: DataFrame, edges_m: DataFrame, max_radius: float,
                       radius_col: str = "radius") -> DataFrame:
    """For (px, py, mx, my, radius): nearest polygon edge within ``radius`` metres.

    Edges outside the band of the points (their box, widened by the radius) are left out; the others are dealt to the
    cells of side ``max_radius`` within that distance of the *segment*, so a point looks at its own cell only. Ties go
    to the first polygon in polygon order.
    """
    g = float(max_radius)
    box = pts_m.agg(F.min("mx").alias("x0"), F.max("mx").alias("x1"), F.min("my").alias("y0"), F.max("my").alias("y1")).first()
    inside = F.lit(False) if box.x0 is None else (
        (F.greatest("x1", "x2") >= box.x0 - g) & (F.least("x1", "x2") <= box.x1 + g) &
        (F.greatest("y1", "y2") >= box.y0 - g) & (F.least("y1", "y2") <= box.y1 + g))
    e = materialize(cells_along(edges_m.select("area", "area_ord", "x1", "y1", "x2", "y2").where(inside), g, g * (1 + 1e-9)))
    p = pts_m.select("px", "py", "mx", "my", radius_col, F.floor(F.col("mx") / g).alias("cx"), F.floor(F.col("my") / g).alias("cy"))
    dist = segment_distance(F.col("mx"), F.col("my"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    j = p.join(e, ["cx", "cy"]).withColumn("dist", dist).where(F.col("dist") <= F.col(radius_col))
    return (j.groupBy("px", "py")
             .agg(F.min_by(F.struct("area", "area_ord", "dist"), F.struct("dist", "area_ord")).alias("b"))
             .select("px", "py", F.col("b.area").alias("area"), F.col("b.dist").alias("dist")))


def assign_area(df: DataFrame, edges: DataFrame | None, lon: str = "longitude", lat: str = "latitude",
                out: str = "planning_area", border_lat: float = K.BORDER_LAT,
                border_radius: float = K.BORDER_RADIUS_M, mainland_radius: float = K.MAINLAND_RADIUS_M,
                cutoff_lat: float | None = K.HARD_CUTOFF_LAT, outside: str = K.OUTSIDE_AREA,
                unknown: str = K.UNKNOWN_AREA, cell: float = AREA_CELL, params: dict = K.LOCAL_TM) -> DataFrame:
    """Area label per row: polygon containing the point; else the nearest polygon
    within 100 m (lat > 1.44) or 2000 m (otherwise, NULL lat included); else
    ``outside``; and ``outside`` for lat > cutoff. No polygons ⇒ ``unknown``.
    One pass over distinct coordinates, joined back once.
    """
    if edges is None:
        return df.withColumn(out, F.lit(unknown))
    pts = df.select(F.col(lon).alias("px"), F.col(lat).alias("py")) \
            .where(F.col("px").isNotNull() & F.col("py").isNotNull()).distinct()
    lab = area_points(pts, edges, border_lat, border_radius, mainland_radius, cell, params)
    res = df.join(lab, (df[lon] == lab["px"]) & (df[lat] == lab["py"]), "left")
    return res.withColumn(out, area_label(F.col("lab"), F.col(lat), cutoff_lat, outside)).drop("px", "py", "lab")


def area_label(lab, lat, cutoff_lat: float | None = K.HARD_CUTOFF_LAT, outside: str = K.OUTSIDE_AREA):
    label = F.coalesce(lab, F.lit(outside))
    return label if cutoff_lat is None else F.when(lat > cutoff_lat, F.lit(outside)).otherwise(label)


def area_points(pts: DataFrame, edges: DataFrame, border_lat: float = K.BORDER_LAT,
                border_radius: float = K.BORDER_RADIUS_M, mainland_radius: float = K.MAINLAND_RADIUS_M,
                cell: float = AREA_CELL, params: dict = K.LOCAL_TM) -> DataFrame:
    """(px=lon, py=lat, lab) for distinct points that are inside a polygon or near one."""
    inside = (point_in_area_pairs(pts, edges, cell)
              .groupBy("px", "py").agg(F.min_by("area", "area_ord").alias("within")))
    # one row per distinct point with its containing area (or NULL), written once:
    # both the nearest-area pass and the final labels read it
    per_pt = materialize(pts.join(inside, ["px", "py"], "left"))
    inside = per_pt.where(F.col("within").isNotNull()).select("px", "py", "within")
    rest = per_pt.where(F.col("within").isNull()).select("px", "py")
    rest = project_local_m(rest, "px", "py", "mx", "my", params).withColumn(
        "radius", F.when(F.col("py") > border_lat, F.lit(border_radius)).otherwise(F.lit(mainland_radius)))
    # one pass per radius class, each with cells of its own radius: a 100 m
    # border search scans 100 m cells, not the 2 km mainland cells
    edges_m = project_edges(edges, params)
    near = None
    for r in sorted({float(border_radius), float(mainland_radius)}):
        part = nearest_area_pairs(rest.where(F.col("radius") == r), edges_m, r)
        near = part if near is None else near.unionByName(part)
    return inside.select("px", "py", F.col("within").alias("lab")).unionByName(
        near.select("px", "py", F.col("area").alias("lab")))


# ---------------------------------------------------------------------------
# all three point features in one pass
# ---------------------------------------------------------------------------

def spatial_features(df: DataFrame, anchors: DataFrame | None, edges: DataFrame | None,
                     lon: str = "longitude", lat: str = "latitude", radius: float = K.DENSITY_RADIUS_M,
                     flag_m: float = K.ANCHOR_FLAG_M, params: dict = K.LOCAL_TM,
                     cutoff_lat: float | None = K.HARD_CUTOFF_LAT) -> DataFrame:
    """dist_to_hawker, is_hawker, cluster_density and planning_area in one pass.

    The three features depend only on the coordinate, so they are computed on
    the distinct coordinates (with multiplicities, projected once and
    checkpointed) and joined back to the rows in a single join — one shuffle
    of the wide table instead of one per feature. ``anchors`` carry lon/lat.
    """
    g = (df.groupBy(F.col(lon).alias("_lon"), F.col(lat).alias("_lat")).agg(F.count(F.lit(1)).alias("w")))
    g = materialize(project_local_m(g, "_lon", "_lat", "px", "py", params)) \
        .where(F.col("_lon").isNotNull() & F.col("_lat").isNotNull())
    a = project_local_m(anchors, params=params) if anchors is not None else None
    nn = nearest_points(g.select("px", "py"), a)
    dens = density_points(g.groupBy("px", "py").agg(F.sum("w").alias("w")), radius)
    per = g.join(dens, ["px", "py"], "left")
    per = per.join(nn, ["px", "py"], "left") if nn is not None else per.withColumn("d", F.lit(K.NO_ANCHOR_DIST))
    if edges is not None:
        lab = area_points(g.select(F.col("_lon").alias("px"), F.col("_lat").alias("py")), edges, params=params)
        per = per.join(lab.withColumnsRenamed({"px": "_lon", "py": "_lat"}), ["_lon", "_lat"], "left")
    per = per.select("_lon", "_lat", "d", "_n", *(["lab"] if edges is not None else []))
    out = df.join(per, (df[lon] == per["_lon"]) & (df[lat] == per["_lat"]), "left")
    ok = F.col(lon).isNotNull() & F.col(lat).isNotNull()
    dist = F.when(ok, F.col("d")) if nn is not None else F.lit(K.NO_ANCHOR_DIST)   # no anchors: every row
    out = out.withColumns({
        "dist_to_hawker": dist,
        "is_hawker": dist < flag_m,
        "cluster_density": F.when(ok, F.col("_n") - 1).cast("bigint"),
        "planning_area": (area_label(F.col("lab"), F.col(lat), cutoff_lat) if edges is not None
                          else F.lit(K.UNKNOWN_AREA)),
    })
    return out.drop("_lon", "_lat", "d", "_n", "lab")
