"""Fixture views derived from the test tables (see FIXTURES.md).

``venues_fx`` (from ``orders``), ``areas_fx`` (from ``nation``) and
``anchors_fx`` (from ``supplier``) give the engine located, rated records,
area polygons and anchor points whose size grows with the input tables.
Integer arithmetic first and one double division last, so Spark and DuckDB
produce identical values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residuum.sources.scan import read_table
from residuum.sources.schema import canonical_venues


def venues_from_orders(orders: DataFrame) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    name = (F.when(k % 211 == 0, F.lit(None).cast("string"))
            .when(k % 4 == 0, F.concat(F.lit("venue "), c.cast("string")))
            .otherwise(F.concat(F.lit("venue "), (F.lit(1000000) + k - k % 2).cast("string"))))
    lat_digits = (F.lit(13000) + (k * 104729) % 36000).cast("string")
    lon_digits = (F.lit(55000) + (k * 7919) % 45000).cast("string")
    url = (F.when(k % 10 == 0, F.lit("https://maps.example/none"))
           .otherwise(F.concat(F.lit("https://maps.example/p!3d1."), F.lpad(lat_digits, 5, "0"),
                               F.lit("!4d103."), F.lpad(lon_digits, 5, "0"))))
    pr = F.col("o_orderpriority")
    price = (F.when(pr == "1-URGENT", "$$$$").when(pr == "2-HIGH", "$$$")
             .when(pr == "3-MEDIUM", "$$").when(pr == "4-NOT SPECIFIED", "$"))
    out = orders.select(
        k.alias("venue_id"),
        name.alias("name"),
        ((F.lit(10) + (k * 31) % 41).cast("double") / F.lit(10).cast("double")).alias("rating"),
        F.when(k % 97 == 0, F.lit(None).cast("bigint")).otherwise((k * 613) % 700).alias("review_count"),
        F.when(k % 89 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("C"), ((c * c) % 97).cast("string"))).alias("category"),
        price.alias("price_level"),
        url.alias("url"),
        ((F.lit(10355000) + (k * 7919) % 55000).cast("double") / F.lit(100000).cast("double")).alias("longitude"),
        ((F.lit(113000) + (k * 104729) % 36000).cast("double") / F.lit(100000).cast("double")).alias("latitude"),
    )
    return canonical_venues(out)


def venues_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["o_orderkey", "o_custkey", "o_orderpriority"]
    return venues_from_orders(read_table(spark, sf_dir, "orders").select(*cols))


def areas_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rectangles (area, area_ord, x0, x1, y0, y1) in degrees."""
    n = F.col("n_nationkey").cast("bigint")
    return read_table(spark, sf_dir, "nation").select(
        F.concat(F.lit("AREA "), n.cast("string")).alias("area"),
        n.alias("area_ord"),
        ((F.lit(10360) + (n % 5) * 9).cast("double") / F.lit(100.0)).alias("x0"),
        ((F.lit(10368) + (n % 5) * 9).cast("double") / F.lit(100.0)).alias("x1"),
        ((F.lit(1200) + F.floor(n / 5.0).cast("bigint") * 50).cast("double") / F.lit(1000.0)).alias("y0"),
        ((F.lit(1245) + F.floor(n / 5.0).cast("bigint") * 50).cast("double") / F.lit(1000.0)).alias("y1"),
    )


def anchors_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read_table(spark, sf_dir, "supplier").select(
        k.alias("anchor_id"),
        ((F.lit(10360000) + (k * 7919) % 45000).cast("double") / F.lit(100000.0)).alias("longitude"),
        ((F.lit(115000) + (k * 104729) % 30000).cast("double") / F.lit(100000.0)).alias("latitude"),
    )
