"""Registered queries: one Spark callable and (where SQL can say it) one DuckDB oracle per operator.

Every query reads the test tables (through the fixture views) over their whole
extent; results grow with the tables. Keys follow the operator inventory.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum import oracle as O
from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.functions.geo import project_local_m, project_web_mercator
from residuum.operators import classify as CL
from residuum.operators import features as FE
from residuum.operators import spatial as S
from residuum.operators.ordering import kfold_contiguous, top_k
from residuum.plans import model as M
from residuum.plans import serve as SV
from residuum.session import shared_path
from residuum.sources import fixtures as FX
from residuum.sources import scan as SC
from residuum.sources.schema import VENUES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


# fixture parameters (the registered queries' own inputs, not reference data)
FX_OVERRIDES = [("venue 10", 1.30, 103.80), ("venue 1000", 1.31, 103.81), ("VENUE 12", 1.32, 103.82)]
FX_PART_LEXICON = {"Red": ["red", "ring"], "Blue": ["blue", "bolt"], "Hot": ["hot", "plate", "red"],
                   "Old": ["old", "widget", "rod"]}
FX_DOC_LEXICON = {"Latin": ["la ", "el ", "los "], "Web": ["com", "net", "www"], "Pub": ["pub", "bar", "wine"],
                  "Food": ["food", "eat", "kitchen", "cafe"]}
STUB_VARIANTS = ["Chinese", "chinese food", "Hawker/Western", "Martian", "Thai | extra", "western", "Other", "BBQ"]
FX_FILTER = SV.FilterSpec(cuisine="C1", min_rating=3.5, min_reviews=5, gems_only=False)
FX_AREA = "AREA 7"


def rnd(c, d: int):
    """Round to d decimals as ``round(x * 10^d) / 10^d`` (half away from zero on the
    scaled double): the same arithmetic as the oracle's ``round``, so ties agree."""
    c = F.col(c) if isinstance(c, str) else c
    m = float(10 ** d)
    return F.round(c * m, 0) / m


def _r(c, d):
    return rnd(c, d).alias(c)


# ---------------------------------------------------------------------------
# shared building blocks
# ---------------------------------------------------------------------------

def venues(spark, sf):
    return FX.venues_fx(spark, sf)


def edges(spark, sf):
    return S.edges_from_rectangles(FX.areas_fx(spark, sf))


def anchors_m(spark, sf):
    return project_local_m(FX.anchors_fx(spark, sf))


def clean(spark, sf):
    return FE.dedup_best(SV.bbox_inclusive(venues(spark, sf)))


def scored(spark, sf):
    return M.context_residual(clean(spark, sf), list(O.M7_KEYS))


def areas_assigned(spark, sf):
    return S.assign_area(venues(spark, sf), edges(spark, sf))


def density(spark, sf):
    return S.cluster_density(project_local_m(venues(spark, sf)))


def with_bucket(spark, sf):
    return FE.top_category_bucket(venues(spark, sf))


def batches(spark, sf):
    names = CL.leftover_names(with_bucket(spark, sf), category="category_encoded")
    return CL.prompt_batches(names)


def stub_responses(batch_df: DataFrame) -> DataFrame:
    """A deterministic stand-in answer per batch built by Spark from the batch's names."""
    variants = F.array(*[F.lit(v) for v in STUB_VARIANTS])
    lines = F.transform("names", lambda n, i: F.concat(
        F.lit("- "), F.when(i % 3 == 0, F.substring(n, 1, 9)).otherwise(n), F.lit(" | "),
        F.element_at(variants, (i % len(STUB_VARIANTS)) + 1)))
    return batch_df.select("batch_id", F.array_join(F.concat(F.array(F.lit("Classifications:")), lines), "\n")
                           .alias("response"))


def parsed(spark, sf):
    members, b = batches(spark, sf)
    p = CL.response_parse(stub_responses(b))
    return members, p.withColumn("category", CL.label_validate(F.col("raw_category")))


# SQL building blocks for the classifier chain
_MEMBERS = ("members", """SELECT CAST((rn - 1) // 20 AS BIGINT) AS batch_id, CAST((rn - 1) % 20 AS INTEGER) AS pos, name FROM (
  SELECT name, row_number() OVER (ORDER BY name) AS rn FROM (SELECT DISTINCT name FROM vce WHERE category_encoded = 'Other' AND name IS NOT NULL))""")
_variants = "[" + ", ".join(O.lit(v) for v in STUB_VARIANTS) + "]"
_LINES = ("lines", f"""SELECT batch_id, CAST(pos + 1 AS BIGINT) AS line_no,
  '- ' || CASE WHEN pos % 3 = 0 THEN substring(name, 1, 9) ELSE name END || ' | ' || {_variants}[(pos % {len(STUB_VARIANTS)}) + 1] AS line
FROM members""")


def _label_validate_sql(c: str) -> str:
    exact = f"CASE WHEN {c} IN (" + ", ".join(O.lit(l) for l in K.CUISINE_LABELS) + f") THEN {c} END"
    sub = "CASE " + " ".join(f"WHEN contains(lower({c}), {O.lit(l.lower())}) THEN {O.lit(l)}" for l in K.CUISINE_LABELS) + " END"
    return f"coalesce({exact}, {sub}, 'Other')"


_PARSED = ("parsed", f"""SELECT batch_id, line_no, name, raw_category, {_label_validate_sql('raw_category')} AS category FROM (
  SELECT batch_id, line_no, regexp_replace(trim(split_part(line, '|', 1)), '^[- ]+', '') AS name,
         trim(split_part(line, '|', 2)) AS raw_category FROM lines WHERE contains(line, '|'))""")
_MATCHED = ("matched", """SELECT orig AS name, arg_max(category, batch_id * 100000 + line_no) AS category FROM (
  SELECT p.batch_id, p.line_no, p.category, arg_min(m.name, m.pos) AS orig
  FROM parsed p JOIN members m ON p.batch_id = m.batch_id
   AND (starts_with(lower(m.name), substring(lower(p.name), 1, 20)) OR contains(lower(m.name), lower(p.name)))
  GROUP BY p.batch_id, p.line_no, p.category)
GROUP BY orig""")
CLASSIFY_CTES = (O.V, O.TOPCAT, O.VCE, _MEMBERS, _LINES, _PARSED, _MATCHED)
_CLEAN_M7 = (*O.CLEAN, O.m7("d"))


# ---------------------------------------------------------------------------
# 2.1 sources / sinks
# ---------------------------------------------------------------------------

@register("scan_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def q_scan_parquet(spark, sf):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                           T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType()),
                           T.StructField("o_orderpriority", T.StringType())])
    return SC.scan_parquet(spark, SC.table_path(sf, "orders"), schema)


@register("rows_to_table", O.with_(O.V) + "SELECT * FROM v")
def q_rows_to_table(spark, sf):
    js = venues(spark, sf).select(F.to_json(F.struct("*")).alias("record"))
    return SC.json_records_to_table(js, "record", VENUES)


@register("sink_parquet", O.with_(O.V) + "SELECT * FROM v")
def q_sink_parquet(spark, sf):
    root = shared_path(spark, "sink_parquet")
    SC.sink_parquet(venues(spark, sf), root)
    return SC.read_latest(spark, root, VENUES)


@register("sample_n", O.with_(O.V) + f"SELECT * FROM v ORDER BY md5('{K.SEED}:' || CAST(venue_id AS VARCHAR)), venue_id LIMIT {K.SAMPLE_N}")
def q_sample_n(spark, sf):
    return SC.sample_n(venues(spark, sf), K.SAMPLE_N, "venue_id", K.SEED)


@register("ingest_anti_join", """SELECT c_custkey AS seed_id FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'F')""")
def q_ingest_anti_join(spark, sf):
    from residuum.streaming.ingest import pending_seeds
    seeds = SC.read_table(spark, sf, "customer").select(F.col("c_custkey").alias("seed_id"))
    ledger = (SC.read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F")
              .select(F.col("o_custkey").alias("seed_id")))
    return pending_seeds(seeds, ledger)


@register("ledger_union", "SELECT DISTINCT o_custkey AS seed_id FROM orders WHERE o_orderstatus IN ('F', 'O')")
def q_ledger_union(spark, sf):
    from residuum.streaming.ingest import ledger_union
    o = SC.read_table(spark, sf, "orders")
    done = o.where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("seed_id"))
    new = o.where(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("seed_id"))
    return ledger_union(done, new)


@register("append_rows", O.with_(O.V) + "SELECT * FROM v")
def q_append_rows(spark, sf):
    o = SC.read_table(spark, sf, "orders")
    first = F.col("o_orderstatus").eqNullSafe("F")        # rows without a status are in the second part
    old, new = FX.venues_from_orders(o.where(first)), FX.venues_from_orders(o.where(~first))
    return old.unionByName(new)


# ---------------------------------------------------------------------------
# 2.2 projections
# ---------------------------------------------------------------------------

@register("project_local_m", O.with_(O.V, O.VX) + "SELECT venue_id, round(x, 3) AS x, round(y, 3) AS y FROM vx")
def q_project_local_m(spark, sf):
    return project_local_m(venues(spark, sf)).select("venue_id", _r("x", 3), _r("y", 3))


_WX, _WY = O.wm_sql("longitude", "latitude")


@register("project_web_mercator", O.with_(O.V) + f"SELECT venue_id, round({_WX}, 3) AS mx, round({_WY}, 3) AS my FROM v")
def q_project_web_mercator(spark, sf):
    return project_web_mercator(venues(spark, sf)).select("venue_id", _r("mx", 3), _r("my", 3))


@register("log_reviews", O.with_(O.V) + "SELECT venue_id, round(ln(1 + coalesce(CAST(review_count AS DOUBLE), 0.0)), 9) AS log_reviews FROM v")
def q_log_reviews(spark, sf):
    return venues(spark, sf).select("venue_id", rnd(C.log_reviews(), 9).alias("log_reviews"))


@register("price_level_num", O.with_(O.V) + """SELECT venue_id, CASE price_level WHEN '$' THEN 1.0::DOUBLE WHEN '$$' THEN 2.0::DOUBLE
  WHEN '$$$' THEN 3.0::DOUBLE WHEN '$$$$' THEN 4.0::DOUBLE ELSE 1.0::DOUBLE END AS price_level_num FROM v""")
def q_price_level_num(spark, sf):
    return venues(spark, sf).select("venue_id", C.price_level_num().alias("price_level_num"))


def _override_sql(col: str, idx: int) -> str:
    arms = " ".join(f"WHEN coalesce(contains(lower(name), {O.lit(p.lower())}), false) THEN {r[idx]!r}::DOUBLE"
                    for p, *r in reversed(FX_OVERRIDES))
    return f"CASE {arms} ELSE {col} END"


@register("coord_overrides", O.with_(O.V) + f"SELECT venue_id, name, {_override_sql('latitude', 0)} AS latitude, "
          f"{_override_sql('longitude', 1)} AS longitude FROM v")
def q_coord_overrides(spark, sf):
    return C.coord_overrides(venues(spark, sf), FX_OVERRIDES).select("venue_id", "name", "latitude", "longitude")


_URL = """SELECT {id}, CASE WHEN ok THEN TRY_CAST(la AS DOUBLE) END AS actual_lat, CASE WHEN ok THEN TRY_CAST(lo AS DOUBLE) END AS actual_lon FROM (
  SELECT {id}, la, lo, la <> '' AND lo <> '' AND TRY_CAST(la AS DOUBLE) IS NOT NULL AND TRY_CAST(lo AS DOUBLE) IS NOT NULL AS ok FROM (
    SELECT {id}, regexp_extract(url, '!3d([\\d.]+)', 1) AS la, regexp_extract(url, '!4d([\\d.]+)', 1) AS lo FROM {src}))"""


@register("url_coords", O.with_(O.V) + _URL.format(id="venue_id", src="v"))
def q_url_coords(spark, sf):
    la, lo = C.url_coords()
    return venues(spark, sf).select("venue_id", la.alias("actual_lat"), lo.alias("actual_lon"))


@register("url_coords_pages", _URL.format(id="page_id", src="pages"))
def q_url_coords_pages(spark, sf):
    la, lo = C.url_coords()
    return SC.read_table(spark, sf, "pages").select("page_id", la.alias("actual_lat"), lo.alias("actual_lon"))


@register("context_residual", O.with_(*_CLEAN_M7) +
          "SELECT venue_id, round(predicted_rating, 6) AS predicted_rating, round(residual, 6) AS residual FROM m7")
def q_context_residual(spark, sf):
    return scored(spark, sf).select("venue_id", _r("predicted_rating", 6), _r("residual", 6))


@register("residual", O.with_(O.V, O.m7("v", ("category",))) + "SELECT venue_id, round(residual, 6) AS residual FROM m7")
def q_residual(spark, sf):
    return M.context_residual(venues(spark, sf), ["category"]).select("venue_id", _r("residual", 6))


_RGBA = ["[" + ", ".join(str(x) for x in c) + "]::INTEGER[]" for c in K.COLOUR_RGBA]
_HEX = [O.lit(h) for h in K.COLOUR_HEX]


@register("colour_class", O.with_(*_CLEAN_M7) +
          f"SELECT venue_id, {O.colour_sql('residual', _RGBA)} AS color, {O.colour_sql('residual', _HEX)} AS hcolor FROM m7")
def q_colour_class(spark, sf):
    return scored(spark, sf).select("venue_id", C.colour_rgba().alias("color"), C.colour_hex().alias("hcolor"))


@register("value_label", O.with_(*_CLEAN_M7) + """SELECT venue_id, CASE WHEN residual >= 0.5::DOUBLE THEN 'Hidden Gem'
  WHEN residual >= 0.0::DOUBLE THEN 'Fair Value' WHEN residual < 0.0::DOUBLE THEN 'Overvalued' END AS value_label FROM m7""")
def q_value_label(spark, sf):
    return scored(spark, sf).select("venue_id", C.value_label().alias("value_label"))


@register("badge", O.with_(*_CLEAN_M7) + f"""SELECT venue_id, CASE WHEN residual >= 0.0::DOUBLE THEN 'Underrated +' || {O.fixed_sql('residual', 2)}
  WHEN residual < 0.0::DOUBLE THEN 'Overrated ' || {O.fixed_sql('residual', 2)} END AS badge FROM m7""")
def q_badge(spark, sf):
    return scored(spark, sf).select("venue_id", C.badge().alias("badge"))


@register("gap_text", O.with_(*_CLEAN_M7) + f"""SELECT venue_id, CASE WHEN residual > 0.0::DOUBLE THEN '+' || {O.fixed_sql('residual', 2)}
  ELSE {O.fixed_sql('residual', 2)} END AS gap FROM m7""")
def q_gap_text(spark, sf):
    return scored(spark, sf).select("venue_id", C.gap_text().alias("gap"))


@register("search_url", O.with_(O.V) + f"SELECT venue_id, {O.lit(K.SEARCH_URL_PREFIX)} || replace(name, ' ', '+') AS search_url FROM v")
def q_search_url(spark, sf):
    return venues(spark, sf).select("venue_id", C.search_url().alias("search_url"))


_EXPL_CTES = (O.V, O.VX, O.DENS, O.AR, O.WITHIN, O.EDGES_M, O.NEAR, O.ASSIGN,
              ("fullv", "SELECT v.*, dens.cluster_density, assigned.planning_area FROM v JOIN dens USING (venue_id) JOIN assigned USING (venue_id)"),
              O.m7("fullv", ("category", "planning_area")))


def explained(spark, sf):
    v = S.spatial_features(venues(spark, sf), None, edges(spark, sf))       # one join back for density and area
    return M.context_residual(v, ["category", "planning_area"])


@register("explanation", O.with_(*_EXPL_CTES) + f"SELECT venue_id, {O.explanation_sql()} AS explanation FROM m7")
def q_explanation(spark, sf):
    return explained(spark, sf).select("venue_id", C.explanation().alias("explanation"))


@register("tooltip_table", O.with_(*_EXPL_CTES) + f"""SELECT venue_id, name, rating, review_count, latitude AS lat, longitude AS lon,
  {O.colour_sql('residual', _RGBA)} AS color, {O.colour_sql('residual', _HEX)} AS hcolor,
  CASE WHEN residual >= 0.0::DOUBLE THEN 'Underrated +' || {O.fixed_sql('residual', 2)} WHEN residual < 0.0::DOUBLE THEN 'Overrated ' || {O.fixed_sql('residual', 2)} END AS badge,
  coalesce(planning_area, 'Unknown') AS area, {O.explanation_sql()} AS explanation FROM m7""")
def q_tooltip_table(spark, sf):
    return SV.tooltip_table(explained(spark, sf))


@register("display_columns", O.with_(*_CLEAN_M7) + f"""SELECT venue_id, name, CASE WHEN residual > 0.0::DOUBLE THEN '+' || {O.fixed_sql('residual', 2)}
  ELSE {O.fixed_sql('residual', 2)} END AS gap, coalesce(url, {O.lit(K.SEARCH_URL_PREFIX)} || replace(name, ' ', '+')) AS link
FROM m7 WHERE residual IS NOT NULL ORDER BY residual DESC, venue_id LIMIT 20""")
def q_display_columns(spark, sf):
    return SV.top_visible(scored(spark, sf), K.TOP_K_SERVE)


# ---------------------------------------------------------------------------
# 2.3 filters
# ---------------------------------------------------------------------------

@register("bbox_inclusive", O.with_(O.V, O.BBOX) + "SELECT * FROM b")
def q_bbox_inclusive(spark, sf):
    return SV.bbox_inclusive(venues(spark, sf))


@register("lat_band_strict", O.with_(O.V) + "SELECT * FROM v WHERE latitude > 1.15::DOUBLE AND latitude < 1.48::DOUBLE")
def q_lat_band_strict(spark, sf):
    return SV.lat_band_strict(venues(spark, sf))


_FILTERED = ("f", "SELECT * FROM m7 WHERE category = 'C1' AND rating >= 3.5::DOUBLE AND review_count >= 5")


@register("user_filters", O.with_(*_CLEAN_M7, _FILTERED) + "SELECT venue_id, name, rating, review_count, category FROM f")
def q_user_filters(spark, sf):
    return SV.user_filters(scored(spark, sf), FX_FILTER).select("venue_id", "name", "rating", "review_count", "category")


@register("user_filters_gems", O.with_(*_CLEAN_M7) + "SELECT venue_id FROM m7 WHERE rating >= 3.5::DOUBLE AND review_count >= 5 AND residual >= 0.5::DOUBLE")
def q_user_filters_gems(spark, sf):
    return SV.user_filters(scored(spark, sf), SV.FilterSpec(gems_only=True)).select("venue_id")


@register("visible_count", O.with_(*_CLEAN_M7, _FILTERED) + "SELECT count(*) AS visible FROM f")
def q_visible_count(spark, sf):
    return SV.user_filters(scored(spark, sf), FX_FILTER).agg(F.count(F.lit(1)).alias("visible"))


@register("dropna_subset", O.with_(O.V) + "SELECT * FROM v WHERE rating IS NOT NULL AND category IS NOT NULL AND review_count IS NOT NULL")
def q_dropna_subset(spark, sf):
    return venues(spark, sf).na.drop(subset=["rating", "category", "review_count"])


@register("leftover_names", O.with_(O.V, O.TOPCAT, O.VCE) + "SELECT DISTINCT name FROM vce WHERE category_encoded = 'Other' AND name IS NOT NULL")
def q_leftover_names(spark, sf):
    return CL.leftover_names(with_bucket(spark, sf), category="category_encoded")


# ---------------------------------------------------------------------------
# 2.4 joins
# ---------------------------------------------------------------------------

@register("nearest_anchor", O.with_(O.V, O.VX, O.AX) + """SELECT venue_id, round(d, 3) AS dist_to_hawker, d < 50.0::DOUBLE AS is_hawker FROM (
  SELECT vx.venue_id, min(sqrt((vx.x - ax.x) * (vx.x - ax.x) + (vx.y - ax.y) * (vx.y - ax.y))) AS d FROM vx, ax GROUP BY vx.venue_id)""")
def q_nearest_anchor(spark, sf):
    v = S.nearest_anchor(project_local_m(venues(spark, sf)), anchors_m(spark, sf))
    return v.select("venue_id", _r("dist_to_hawker", 3), "is_hawker")


@register("cluster_density", O.with_(O.V, O.VX, O.DENS) + "SELECT venue_id, cluster_density FROM dens")
def q_cluster_density(spark, sf):
    return density(spark, sf).select("venue_id", "cluster_density")


_DENS_WIDE = ("densw", O.DENS[1].replace("200.0", "2000.0"))


@register("cluster_density_wide", O.with_(O.V, O.VX, _DENS_WIDE) + "SELECT venue_id, cluster_density FROM densw")
def q_cluster_density_wide(spark, sf):
    """The same operator at a 2 km radius, where the fixture has ~75 neighbours per point."""
    return S.cluster_density(project_local_m(venues(spark, sf)), radius=2000.0).select("venue_id", "cluster_density")


@register("point_in_area", O.with_(O.V, O.AR, O.WITHIN) + "SELECT venue_id, area_within FROM within")
def q_point_in_area(spark, sf):
    return S.point_in_area(venues(spark, sf), edges(spark, sf)).select("venue_id", "area_within")


@register("point_in_area_dense", O.with_(O.V, O.AR, O.WITHIN) + "SELECT venue_id, area_within FROM within")
def q_point_in_area_dense(spark, sf):
    """The same operator with cells of 0.1 degrees, which hold hundreds of points and whole polygon corners each."""
    return S.point_in_area(venues(spark, sf), edges(spark, sf), cell=0.1).select("venue_id", "area_within")


@register("nearest_area", O.with_(O.V, O.AR, O.WITHIN, O.EDGES_M, O.NEAR) +
          "SELECT w.venue_id, n.near_area FROM within w LEFT JOIN near n ON w.venue_id = n.venue_id WHERE w.area_within IS NULL")
def q_nearest_area(spark, sf):
    """Nearest polygon within the per-row radius for rows inside no polygon (NULL if none)."""
    v = venues(spark, sf)
    e = edges(spark, sf)
    outside = S.point_in_area(v, e).where(F.col("area_within").isNull()).select("venue_id", "longitude", "latitude")
    pts = outside.select(F.col("longitude").alias("px"), F.col("latitude").alias("py")).distinct()
    pts = project_local_m(pts, "px", "py", "mx", "my").withColumn(
        "radius", F.when(F.col("py") > K.BORDER_LAT, F.lit(K.BORDER_RADIUS_M)).otherwise(F.lit(K.MAINLAND_RADIUS_M)))
    near = S.nearest_area_pairs(pts, S.project_edges(e), K.MAINLAND_RADIUS_M)
    j = outside.join(near, (outside["longitude"] == near["px"]) & (outside["latitude"] == near["py"]), "left")
    return j.select("venue_id", F.col("area").alias("near_area"))


@register("assign_area", O.with_(*O.AREA_CTES) + "SELECT venue_id, planning_area FROM assigned")
def q_assign_area(spark, sf):
    return areas_assigned(spark, sf).select("venue_id", "planning_area")


@register("is_chain", O.with_(O.V) + """SELECT v.venue_id, coalesce(c.n > 2, false) AS is_chain FROM v
LEFT JOIN (SELECT name, count(*) AS n FROM v WHERE name IS NOT NULL GROUP BY name) c ON v.name = c.name""")
def q_is_chain(spark, sf):
    return FE.is_chain(venues(spark, sf)).select("venue_id", "is_chain")


@register("top_category_bucket", O.with_(O.V, O.TOPCAT, O.VCE) + "SELECT venue_id, category_encoded FROM vce")
def q_top_category_bucket(spark, sf):
    return with_bucket(spark, sf).select("venue_id", "category_encoded")


@register("fuzzy_match", O.with_(*CLASSIFY_CTES) + "SELECT name, category FROM matched")
def q_fuzzy_match(spark, sf):
    members, p = parsed(spark, sf)
    return CL.fuzzy_match(p, members)


@register("apply_labels", O.with_(*CLASSIFY_CTES) + """SELECT vce.venue_id, CASE WHEN vce.category_encoded = 'Other' THEN coalesce(m.category, 'Other')
  ELSE coalesce(vce.category_encoded, 'Other') END AS category FROM vce LEFT JOIN matched m ON vce.name = m.name""")
def q_apply_labels(spark, sf):
    members, p = parsed(spark, sf)
    mapping = CL.fuzzy_match(p, members)
    out = CL.apply_labels(with_bucket(spark, sf), mapping, category="category_encoded")
    return out.select("venue_id", F.col("category_encoded").alias("category"))


# ---------------------------------------------------------------------------
# 2.5 aggregations
# ---------------------------------------------------------------------------

@register("value_counts", O.with_(O.V) + "SELECT category, count(*) AS count FROM v WHERE category IS NOT NULL GROUP BY category")
def q_value_counts(spark, sf):
    return FE.value_counts(venues(spark, sf), "category")


@register("value_counts_head", O.with_(O.V) + "SELECT category, count(*) AS count FROM v WHERE category IS NOT NULL GROUP BY category ORDER BY count DESC, category LIMIT 5")
def q_value_counts_head(spark, sf):
    return FE.value_counts(venues(spark, sf), "category").limit(5)


@register("other_share", O.with_(O.V, O.TOPCAT, O.VCE) + """SELECT CAST(count_if(category_encoded = 'Other') AS BIGINT) AS remaining_other,
  round(100.0 * count_if(category_encoded = 'Other') / count(*), 6) AS other_pct FROM vce""")
def q_other_share(spark, sf):
    b = with_bucket(spark, sf)
    n_other = F.count_if(F.col("category_encoded") == K.OTHER)
    return b.agg(n_other.alias("remaining_other"), rnd(100.0 * n_other / F.count(F.lit(1)), 6).alias("other_pct"))


@register("residual_stats", O.with_(*_CLEAN_M7) + """SELECT round(avg(residual), 6) AS mean, round(stddev_samp(residual), 6) AS std,
  round(min(residual), 6) AS min, round(max(residual), 6) AS max FROM m7""")
def q_residual_stats(spark, sf):
    return M.residual_stats(scored(spark, sf)).select(*[_r(c, 6) for c in ("mean", "std", "min", "max")])


@register("view_state", O.with_(*O.AREA_CTES) + f"""SELECT round(avg(v.latitude), 9) AS latitude, round(avg(v.longitude), 9) AS longitude, {K.ZOOM_AREA} AS zoom
FROM v JOIN assigned a USING (venue_id) WHERE a.planning_area = '{FX_AREA}'""")
def q_view_state(spark, sf):
    vis = areas_assigned(spark, sf).where(F.col("planning_area") == FX_AREA)
    return SV.view_state(vis, SV.FilterSpec(area=FX_AREA)).select(_r("latitude", 9), _r("longitude", 9),
                                                                  F.col("zoom"))


@register("facets", O.with_(O.V) + """SELECT value FROM (SELECT 'All Cuisines' AS value UNION ALL
  SELECT DISTINCT coalesce(CAST(category AS VARCHAR), 'None') FROM v)""")
def q_facets(spark, sf):
    return SV.facets(venues(spark, sf), "category", K.ALL_CUISINES)


@register("facets_area", O.with_(*O.AREA_CTES) + """SELECT value FROM (SELECT 'All Areas' AS value UNION ALL
  SELECT DISTINCT planning_area FROM assigned)""")
def q_facets_area(spark, sf):
    return SV.facets(areas_assigned(spark, sf), "planning_area", K.ALL_AREAS)


_FOLDS = ("fv", "SELECT *, CAST(ntile(5) OVER (ORDER BY venue_id) - 1 AS INTEGER) AS fold FROM d")
_XS = "CAST(sum(CAST(rating AS DECIMAL(38,10))) AS DOUBLE)"
_CV = ("cvp", f"""SELECT d.venue_id, d.rating, d.fold,
  (t.ts - coalesce(p.fs, 0.0) + 1.0::DOUBLE * ((SELECT {_XS} FROM fv WHERE rating IS NOT NULL) - ft.Fs)
     / ((SELECT count(*) FROM fv WHERE rating IS NOT NULL) - ft.Fn))
  / (t.tn - coalesce(p.fn, 0) + 1.0::DOUBLE) AS prediction
FROM (SELECT * FROM fv WHERE rating IS NOT NULL) d
JOIN (SELECT category, price_level, {_XS} ts, count(*) tn FROM fv WHERE rating IS NOT NULL GROUP BY ALL) t
  ON d.category IS NOT DISTINCT FROM t.category AND d.price_level IS NOT DISTINCT FROM t.price_level
LEFT JOIN (SELECT category, price_level, fold, {_XS} fs, count(*) fn FROM fv WHERE rating IS NOT NULL GROUP BY ALL) p
  ON d.category IS NOT DISTINCT FROM p.category AND d.price_level IS NOT DISTINCT FROM p.price_level AND d.fold = p.fold
JOIN (SELECT fold, {_XS} Fs, count(*) Fn FROM fv WHERE rating IS NOT NULL GROUP BY fold) ft ON d.fold = ft.fold""")


def cv_predictions(spark, sf):
    f = kfold_contiguous(clean(spark, sf), ["venue_id"])
    return M.cv_context_residual(f, list(O.M7_KEYS))


@register("cv_rmse_summary", O.with_(*O.CLEAN, _FOLDS, _CV) + """SELECT round(avg(rmse), 6) AS rmse_mean, round(2 * stddev_pop(rmse), 6) AS rmse_2std, count(*) AS folds
FROM (SELECT fold, sqrt(CAST(sum(CAST((rating - prediction) * (rating - prediction) AS DECIMAL(38,10))) AS DOUBLE)
                        / CAST(count(*) AS DOUBLE)) AS rmse FROM cvp GROUP BY fold)""")
def q_cv_rmse_summary(spark, sf):
    s = M.cv_rmse_summary(M.fold_rmse(cv_predictions(spark, sf)))
    return s.select(_r("rmse_mean", 6), _r("rmse_2std", 6), "folds")


# ---------------------------------------------------------------------------
# 2.6 window / dedup, 2.7 top-k
# ---------------------------------------------------------------------------

@register("dedup_best", O.with_(O.V, O.DEDUP) + "SELECT * FROM d")
def q_dedup_best(spark, sf):
    return FE.dedup_best(venues(spark, sf))


@register("kfold_contiguous", O.with_(*O.CLEAN, _FOLDS) + "SELECT venue_id, fold FROM fv")
def q_kfold_contiguous(spark, sf):
    return kfold_contiguous(clean(spark, sf), ["venue_id"]).select("venue_id", "fold")


def _top_sql(where: str, order: str, k: int) -> str:
    return (O.with_(*_CLEAN_M7) + f"""SELECT venue_id, name, rating, review_count, round(predicted_rating, 6) AS predicted_rating,
  round(residual, 6) AS residual FROM m7 WHERE residual IS NOT NULL {where} ORDER BY residual {order}, venue_id LIMIT {k}""")


def _top(spark, sf, k, desc, floor=None):
    s = scored(spark, sf)
    if floor is not None:
        s = s.where(F.col("review_count") >= floor)
    return top_k(s, "residual", k, desc).select("venue_id", "name", "rating", "review_count",
                                                _r("predicted_rating", 6), _r("residual", 6))


@register("top_gems", _top_sql("", "DESC", K.TOP_K_SERVE))
def q_top_gems(spark, sf):
    return _top(spark, sf, K.TOP_K_SERVE, True)


@register("top_overvalued", _top_sql("", "ASC", K.TOP_K_RETRAIN))
def q_top_overvalued(spark, sf):
    return _top(spark, sf, K.TOP_K_RETRAIN, False)


@register("top_gems_floor", _top_sql("AND review_count >= 10", "DESC", K.TOP_K_RETRAIN))
def q_top_gems_floor(spark, sf):
    return _top(spark, sf, K.TOP_K_RETRAIN, True, floor=10)


@register("top_overhyped_floor", _top_sql("AND review_count >= 100", "ASC", K.TOP_K_RETRAIN))
def q_top_overhyped_floor(spark, sf):
    return _top(spark, sf, K.TOP_K_RETRAIN, False, floor=100)


# ---------------------------------------------------------------------------
# 2.2 / 2.9 classification
# ---------------------------------------------------------------------------

@register("keyword_classify", f"SELECT p_partkey, {O.keyword_sql('p_name', FX_PART_LEXICON)} AS category FROM part")
def q_keyword_classify(spark, sf):
    return CL.keyword_classify(SC.read_table(spark, sf, "part").select("p_partkey", "p_name"),
                               FX_PART_LEXICON, text="p_name").select("p_partkey", "category")


@register("keyword_classify_docs", f"SELECT doc_id, {O.keyword_sql('text', FX_DOC_LEXICON)} AS category FROM documents")
def q_keyword_classify_docs(spark, sf):
    return CL.keyword_classify(SC.read_table(spark, sf, "documents").select("doc_id", "text"),
                               FX_DOC_LEXICON, text="text").select("doc_id", "category")


LEXICON_WORDS = 120     # of each language; at four languages a lexicon of 480 entries
_LEXICON = ("lexicon", f"""SELECT lang, word FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS k
  FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{{4,}}')) AS word FROM documents WHERE lang IS NOT NULL) GROUP BY lang, word) WHERE k <= {LEXICON_WORDS}""")


def language_lexicon(spark, sf) -> dict[str, list[str]]:
    """The most frequent words of four letters and more of each language (``LEXICON_WORDS`` of each: a bounded list)."""
    from pyspark.sql import Window
    words = SC.read_table(spark, sf, "documents").where("lang IS NOT NULL").select(
        "lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]{4,}"), F.lit(0))).alias("word"))
    best = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = words.groupBy("lang", "word").count().withColumn("k", F.row_number().over(best)).where(F.col("k") <= LEXICON_WORDS)
    out: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "k").collect():
        out.setdefault(r.lang, []).append(r.word)
    return out


@register("keyword_classify_lexicon", O.with_(_LEXICON, ("s", """SELECT doc_id, lexicon.lang, sum(length(word)) AS s
  FROM documents JOIN lexicon ON contains(lower(text), word) GROUP BY doc_id, lexicon.lang"""),
  ("b", "SELECT doc_id, lang FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1")) +
  "SELECT doc_id, coalesce(b.lang, 'Other') AS category FROM documents LEFT JOIN b USING (doc_id)")
def q_keyword_classify_lexicon(spark, sf):
    """Keyword scoring with hundreds of words, themselves taken from the table."""
    docs = SC.read_table(spark, sf, "documents").select("doc_id", "text")
    return CL.keyword_classify(docs, language_lexicon(spark, sf), text="text").select("doc_id", "category")


_HEAD, _TAIL = K.PROMPT_TEMPLATE.split("{names}")
_HEAD = _HEAD.replace("{categories}", ", ".join(K.CUISINE_LABELS))


@register("prompt_batches", O.with_(O.V, O.TOPCAT, O.VCE, _MEMBERS) + f"""SELECT batch_id, count(*) AS n_names,
  {O.lit(_HEAD)} || string_agg('- ' || name, chr(10) ORDER BY pos) || {O.lit(_TAIL)} AS prompt FROM members GROUP BY batch_id""")
def q_prompt_batches(spark, sf):
    _, b = batches(spark, sf)
    return b.select("batch_id", F.col("n_names").cast("bigint").alias("n_names"), "prompt")


@register("response_parse", O.with_(*CLASSIFY_CTES[:-1]) + "SELECT batch_id, line_no, name, raw_category FROM parsed")
def q_response_parse(spark, sf):
    _, p = parsed(spark, sf)
    return p.select("batch_id", F.col("line_no").cast("bigint").alias("line_no"), "name", "raw_category")


@register("label_validate", O.with_(*CLASSIFY_CTES[:-1]) + "SELECT batch_id, line_no, category FROM parsed")
def q_label_validate(spark, sf):
    _, p = parsed(spark, sf)
    return p.select("batch_id", F.col("line_no").cast("bigint").alias("line_no"), "category")


@register("ordinal_encode", O.with_(O.V) + """SELECT v.venue_id, CAST(coalesce(c.code, -1) AS BIGINT) AS category_code
FROM v LEFT JOIN (SELECT category, dense_rank() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT category FROM v WHERE category IS NOT NULL)) c
ON v.category = c.category""")
def q_ordinal_encode(spark, sf):
    return M.ordinal_encode(venues(spark, sf), "category").select("venue_id", "category_code")


# ---------------------------------------------------------------------------
# flagship
# ---------------------------------------------------------------------------

@register("flagship", O.with_(*_CLEAN_M7) + """SELECT venue_id, name, rating, round(predicted_rating, 6) AS predicted_rating, round(residual, 6) AS residual,
  CASE WHEN residual >= 0.5::DOUBLE THEN 'Hidden Gem' WHEN residual >= 0.0::DOUBLE THEN 'Fair Value' WHEN residual < 0.0::DOUBLE THEN 'Overvalued' END AS value_label
FROM m7 WHERE residual IS NOT NULL ORDER BY residual DESC, venue_id LIMIT 20""")
def q_flagship(spark, sf):
    s = scored(spark, sf).withColumn("value_label", C.value_label())
    return top_k(s, "residual", K.TOP_K_SERVE).select("venue_id", "name", "rating", _r("predicted_rating", 6),
                                                       _r("residual", 6), "value_label")
