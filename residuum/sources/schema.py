"""Canonical schemas. Optional columns absent at the source are added as typed
NULLs so no later operator has to test for a column's presence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VENUES = T.StructType([
    T.StructField("venue_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("review_count", T.LongType()),
    T.StructField("category", T.StringType()),
    T.StructField("price_level", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
])

ANCHORS = T.StructType([
    T.StructField("anchor_id", T.LongType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
])

# polygons as exploded edges: one row per ring segment, degrees
EDGES = T.StructType([
    T.StructField("area", T.StringType()),
    T.StructField("area_ord", T.LongType()),
    T.StructField("ring", T.LongType()),
    T.StructField("x1", T.DoubleType()),
    T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()),
    T.StructField("y2", T.DoubleType()),
])

SEEDS = T.StructType([
    T.StructField("seed_id", T.LongType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
])

DOUBLE_COLS = ("rating", "longitude", "latitude")


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"DataFrame must have columns {list(names)}; missing {missing}")


def canonical_venues(df: DataFrame, schema: T.StructType = VENUES) -> DataFrame:
    """Cast to the venue schema, add missing optional columns, NaN → NULL.

    ``longitude``/``latitude`` are required (the point cannot be built
    without them); extra columns are kept after the canonical ones.
    """
    require_columns(df, "longitude", "latitude")
    cols = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in DOUBLE_COLS:
            c = F.nanvl(c, F.lit(None).cast("double"))
        cols.append(c.alias(f.name))
    extra = [c for c in df.columns if c not in schema.fieldNames()]
    return df.select(*cols, *extra)
