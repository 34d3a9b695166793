"""Serving chain: clean → bounds → dedup → filter → top-k → decorate.

Everything is a projection, filter, aggregate or top-k on the table the
model stage wrote; the driver only ever receives the k rows of a report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from residuum.functions import columns as C
from residuum.functions import constants as K
from residuum.operators.features import dedup_best
from residuum.operators.ordering import top_k


def bbox_inclusive(df: DataFrame, lat: str = "latitude", lon: str = "longitude",
                   box=K.BBOX_INCLUSIVE) -> DataFrame:
    """lat_min ≤ lat ≤ lat_max and lon_min ≤ lon ≤ lon_max (pushed to the scan on raw columns)."""
    a, b, c, d = box
    return df.where(F.col(lat).between(a, b) & F.col(lon).between(c, d))


def lat_band_strict(df: DataFrame, lat: str = "latitude", band=K.LAT_BAND_STRICT) -> DataFrame:
    a, b = band
    return df.where((F.col(lat) > a) & (F.col(lat) < b))


def apply_url_coords(df: DataFrame, url: str = "url", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """actual_lat/actual_lon from the URL; where both parse they replace the point."""
    ulat, ulon = C.url_coords(url)
    df = df.withColumns({"actual_lat": ulat, "actual_lon": ulon})
    return df.withColumns({lat: F.coalesce(F.col("actual_lat"), F.col(lat)),
                           lon: F.coalesce(F.col("actual_lon"), F.col(lon))})


def clean_for_serving(df: DataFrame) -> DataFrame:
    """URL coordinates → inclusive bounds → keep-best per name (the load step)."""
    return dedup_best(bbox_inclusive(apply_url_coords(df)))


@dataclass(frozen=True)
class FilterSpec:
    area: str = K.ALL_AREAS
    cuisine: str = K.ALL_CUISINES
    min_rating: float = K.DEFAULT_MIN_RATING
    min_reviews: int = K.DEFAULT_MIN_REVIEWS
    gems_only: bool = False
    hide_anchor_sites: bool = False      # optional: drop rows flagged is_hawker (off by default)


def user_filters(df: DataFrame, spec: FilterSpec = FilterSpec(), area: str = "planning_area",
                 cuisine: str = "category") -> DataFrame:
    out = df
    if spec.area != K.ALL_AREAS:
        out = out.where(F.col(area) == spec.area)
    if spec.cuisine != K.ALL_CUISINES:
        out = out.where(F.col(cuisine) == spec.cuisine)
    out = out.where((F.col("rating") >= spec.min_rating) & (F.col("review_count") >= spec.min_reviews))
    if spec.gems_only:
        out = out.where(F.col("residual") >= K.GEM_THRESHOLD)
    if spec.hide_anchor_sites:
        out = out.where(~F.coalesce(F.col("is_hawker"), F.lit(False)))
    return out


def facets(df: DataFrame, column: str, all_label: str) -> DataFrame:
    """``all_label`` first, then the sorted distinct values as strings (NULL shown as 'None')."""
    vals = df.select(F.coalesce(F.col(column).cast("string"), F.lit("None")).alias("value")).distinct()
    head = df.sparkSession.range(1).select(F.lit(all_label).alias("value"))
    return (head.withColumn("_r", F.lit(0)).unionByName(vals.withColumn("_r", F.lit(1)))
                .orderBy("_r", "value").drop("_r"))


def view_state(df: DataFrame, spec: FilterSpec = FilterSpec(), lat: str = "latitude",
               lon: str = "longitude") -> DataFrame:
    """Map centre: mean of the visible rows for one area, else the fixed city centre."""
    if spec.area == K.ALL_AREAS:
        return df.sparkSession.range(1).select(F.lit(K.DEFAULT_CENTRE[0]).alias("latitude"),
                                               F.lit(K.DEFAULT_CENTRE[1]).alias("longitude"),
                                               F.lit(K.ZOOM_ALL).alias("zoom"))
    return df.agg(F.avg(lat).alias("latitude"), F.avg(lon).alias("longitude")) \
             .withColumn("zoom", F.lit(K.ZOOM_AREA))


def top_visible(df: DataFrame, k: int = K.TOP_K_SERVE) -> DataFrame:
    """Top-k by residual with gap text and a link (search URL when the row has none)."""
    t = top_k(df, "residual", k)
    return t.select("venue_id", "name", C.gap_text("residual").alias("gap"),
                    F.coalesce(F.col("url"), C.search_url("name")).alias("link"))


def tooltip_table(df: DataFrame) -> DataFrame:
    """Per visible row: position, colours, badge, area text and explanation."""
    return df.select(
        "venue_id", "name", "rating", "review_count",
        F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
        C.colour_rgba("residual").alias("color"), C.colour_hex("residual").alias("hcolor"),
        C.badge("residual").alias("badge"), C.area_text("planning_area").alias("area"),
        C.explanation().alias("explanation"))
