"""GeoJSON and KML sources, and the source fallback chain.

All readers are Spark's own (text, JSON and XML data sources), so files are
split across tasks, one large document too, and nothing passes through the
driver. Geometry coordinates are read as raw JSON text and parsed per
geometry type (Polygon and MultiPolygon nest differently).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from residuum.functions import constants as K
from residuum.operators.ordering import global_row_number
from residuum.session import materialize
from residuum.sources.scan import path_exists
from residuum.sources.schema import ANCHORS

FEATURE = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("coordinates", T.StringType()),
    ])),
])
RING = T.ArrayType(T.ArrayType(T.DoubleType()))


def scan_geojson(spark: SparkSession, path: str, collection: bool = True) -> DataFrame:
    """(properties MAP<STRING,STRING>, geom_type, coordinates JSON, position) per feature.

    ``collection=True`` reads FeatureCollection documents, ``False`` newline-delimited
    features (GeoJSON text sequences); either way a large file is read by many tasks.
    ``position`` counts the features from 0 in the order of the files and of each
    document, however the files are split.
    """
    if collection:
        feats = _collection_features(spark, path)
    else:
        feats = spark.read.schema(FEATURE).json(path).select(
            F.struct(*FEATURE.fieldNames()).alias("f"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    feats = feats.where("f.type = 'Feature'")
    numbered = global_row_number(feats, ["file", "block", "at"], out="position")
    return numbered.select("f.properties", F.col("f.geometry.type").alias("geom_type"),
                           F.col("f.geometry.coordinates").alias("coordinates"), (F.col("position") - 1).alias("position"))


def _before(df: DataFrame, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all earlier pieces of the file.

    Inside a split by a window (a split is bounded), across splits by their totals (a row for each split).
    """
    split = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    files = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = df.groupBy("file", "block").agg(F.sum(value).alias("_t")).select("file", "block", F.coalesce(F.sum("_t").over(files), F.lit(0)).alias("_off"))
    return (df.withColumn("_in", F.coalesce(F.sum(value).over(split), F.lit(0))).join(F.broadcast(earlier), ["file", "block"])
            .withColumn(out, F.col("_in") + F.col("_off")).drop("_in", "_off"))


def _collection_features(spark: SparkSession, path: str) -> DataFrame:
    """(f, file, block, at): the members of depth two of JSON documents that are features, read in byte ranges.

    Spark's text source cuts the bytes at closing braces, in as many tasks as the file has splits. Whether a piece begins
    inside a string follows from the quotes before it, its depth from the braces outside of strings before it; both are
    running sums over the splits. A feature ends where the depth falls back to one; its pieces are gathered and parsed.
    """
    count = lambda text, ch: F.length(text) - F.length(F.replace(text, F.lit(ch)))
    pieces = spark.read.option("lineSep", "}").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # an escape never crosses a closing brace, so pairs can be left out piece by piece
    pieces = materialize(pieces.withColumn("bare", F.regexp_replace("value", r"(?s)\\.", "")).withColumn("quotes", count(F.col("bare"), '"')))
    in_string = F.col("quotes_before") % 2 == 1
    rest = F.when(in_string & ~F.col("bare").contains('"'), F.lit("")).when(in_string, F.regexp_replace("bare", '^[^"]*+"', "")).otherwise(F.col("bare"))
    outside = F.regexp_replace(F.regexp_replace(rest, '"[^"]*+"', ""), '"[^"]*+$', "")
    closes = ((F.col("quotes_before") + F.col("quotes")) % 2 == 0).cast("int")
    pieces = _before(pieces, "quotes", "quotes_before").withColumns({"opens": count(outside, "{"), "closes": closes})
    pieces = _before(pieces.withColumn("deeper", F.col("opens") - F.col("closes")).select("file", "block", "at", "value", "opens", "closes", "deeper"), "deeper", "depth")
    ends = (F.col("closes") == 1) & (F.col("depth") + F.col("deeper") == 1)
    pieces = _before(pieces.withColumn("ends", ends.cast("int")), "ends", "number")
    whole = pieces.groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("block", "at", "value", "depth"))).alias("p"), F.max("ends").alias("ended")).where("ended = 1")
    text = F.concat(F.array_join(F.transform("p", lambda x: x["value"]), "}"), F.lit("}"))
    upto_brace = r'^(?:[^"{]++|"(?:[^"\\]|\\.)*+")*+\{'
    first = F.regexp_replace(text, upto_brace, "")
    member = F.concat(F.lit("{"), F.when(F.col("p")[0]["depth"] < 1, F.regexp_replace(first, upto_brace, "")).otherwise(first))
    return whole.select(F.from_json(member, FEATURE).alias("f"), "file", F.col("p")[0]["block"].alias("block"), F.col("p")[0]["at"].alias("at"))


def geojson_rings(features: DataFrame, name_prop: str = "name") -> DataFrame:
    """Polygon / MultiPolygon features → (area, area_ord, rings ARRAY<ring>) for ``edges_from_rings``."""
    poly = F.from_json(F.col("coordinates"), T.ArrayType(RING))
    multi = F.from_json(F.col("coordinates"), T.ArrayType(T.ArrayType(RING)))
    rings = F.when(F.col("geom_type") == "Polygon", poly) \
             .when(F.col("geom_type") == "MultiPolygon", F.flatten(multi))
    return (features.where(F.col("geom_type").isin("Polygon", "MultiPolygon"))
            .select(F.col("properties")[name_prop].alias("area"),
                    F.col("position").alias("area_ord"), rings.alias("rings")))


def geojson_points(features: DataFrame, id_prop: str | None = None) -> DataFrame:
    """Point features → (anchor_id, longitude, latitude)."""
    xy = F.from_json(F.col("coordinates"), T.ArrayType(T.DoubleType()))
    ident = (F.col("properties")[id_prop].cast("bigint") if id_prop
             else F.col("position"))
    return (features.where(F.col("geom_type") == "Point")
            .select(ident.alias("anchor_id"), xy[0].alias("longitude"), xy[1].alias("latitude")))


def scan_kml(spark: SparkSession, path: str) -> DataFrame:
    """KML Placemarks → (attributes MAP<STRING,STRING>, longitude, latitude, altitude).

    Spark's XML source with ``rowTag=Placemark``; ``SimpleData`` elements
    become a map from their ``name`` attribute to their text.
    """
    raw = (spark.read.format("xml").option("rowTag", "Placemark")
           .option("valueTag", "_VALUE").option("attributePrefix", "_")
           .schema(_KML_SCHEMA).load(path))
    sd = F.col("ExtendedData.SchemaData.SimpleData")
    parts = F.split(F.trim(F.col("Point.coordinates")), ",")
    return raw.select(
        F.map_from_arrays(F.transform(sd, lambda e: e["_name"]), F.transform(sd, lambda e: e["_VALUE"]))
         .alias("attributes"),
        parts[0].cast("double").alias("longitude"), parts[1].cast("double").alias("latitude"),
        F.when(F.size(parts) > 2, parts[2].cast("double")).alias("altitude"))


_KML_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("ExtendedData", T.StructType([
        T.StructField("SchemaData", T.StructType([
            T.StructField("SimpleData", T.ArrayType(T.StructType([
                T.StructField("_name", T.StringType()),
                T.StructField("_VALUE", T.StringType()),
            ]))),
        ])),
    ])),
    T.StructField("Point", T.StructType([T.StructField("coordinates", T.StringType())])),
])


def anchors_from_kml(kml: DataFrame) -> DataFrame:
    return kml.select(F.monotonically_increasing_id().alias("anchor_id"), "longitude", "latitude")


def load_anchors(spark: SparkSession, geojson_path: str | None, kml_path: str | None) -> DataFrame | None:
    """GeoJSON if present, else KML, else None (no anchors ⇒ distance 9999, flag false)."""
    if geojson_path and path_exists(spark, geojson_path):
        return geojson_points(scan_geojson(spark, geojson_path))
    if kml_path and path_exists(spark, kml_path):
        return anchors_from_kml(scan_kml(spark, kml_path))
    return None


def load_areas(spark: SparkSession, geojson_path: str | None) -> DataFrame | None:
    """Area polygons as rings, or None (⇒ every row's area is 'Unknown')."""
    if geojson_path and path_exists(spark, geojson_path):
        return geojson_rings(scan_geojson(spark, geojson_path))
    return None


def load_seeds(spark: SparkSession, geojson_path: str | None) -> DataFrame:
    """Search seeds from GeoJSON points, else the single default centre point."""
    if geojson_path and path_exists(spark, geojson_path):
        return geojson_points(scan_geojson(spark, geojson_path)).withColumnRenamed("anchor_id", "seed_id")
    lat, lon = K.DEFAULT_CENTRE
    return spark.createDataFrame([(0, lon, lat)], "seed_id long, longitude double, latitude double")


def empty_anchors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ANCHORS)


# --- writers used to build file fixtures from tables ------------------------

def write_feature_collection(points: DataFrame, path: str, order: str, lon: str = "longitude", lat: str = "latitude") -> str:
    """``points`` as one FeatureCollection document (one file, so one writing task), features in the order of ``order``."""
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*[F.col(c) for c in points.columns if c not in (lon, lat)]).alias("properties"),
                                 F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry")))
    rows = points.select(F.lit(1).alias("part"), F.col(order).alias("o"), F.row_number().over(Window.orderBy(order)).alias("n"), feature.alias("f"))
    lines = rows.select("part", "o", F.concat(F.when(F.col("n") > 1, ",").otherwise(""), "f").alias("value"))
    frame = points.sparkSession.range(1).select(F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.lit('{"type": "FeatureCollection", "features": [').alias("value")),
        F.struct(F.lit(2).alias("part"), F.lit("]}").alias("value")))).alias("x")).select("x.part", F.lit(None).cast(rows.schema["o"].dataType).alias("o"), "x.value")
    lines.unionByName(frame).coalesce(1).sortWithinPartitions("part", "o").select("value").write.text(path)
    return path


def write_geojson_seq(polys: DataFrame, path: str) -> str:
    """Rectangles (area, x0, x1, y0, y1) → one GeoJSON Polygon feature per line."""
    ring = F.array(*[F.array(F.col(a), F.col(b)) for a, b in
                     [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0")]])
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.create_map(F.lit("name"), F.col("area")).alias("properties"),
                    F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    polys.select(F.to_json(feat).alias("value")).write.mode("overwrite").text(path)
    return path


def write_kml_placemarks(points: DataFrame, path: str, id_col: str = "anchor_id",
                         per_file: int = 1000) -> str:
    """Points → KML documents of at most ``per_file`` Placemarks, one document per file.

    Each document is assembled by one task from a bounded chunk of rows and
    written under ``chunk=<n>/``; the KML reader scans the folder recursively.
    """
    sid = F.col(id_col).cast("string")
    pm = F.concat(
        F.lit('<Placemark id="p'), sid, F.lit('"><name>'), sid,
        F.lit('</name><ExtendedData><SchemaData schemaUrl="#s"><SimpleData name="ANCHOR_ID">'), sid,
        F.lit('</SimpleData></SchemaData></ExtendedData><Point><coordinates>'),
        F.col("longitude").cast("string"), F.lit(","), F.col("latitude").cast("string"),
        F.lit(",0.0</coordinates></Point></Placemark>"))
    head = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
    docs = (points.select(F.floor(F.col(id_col) / per_file).alias("chunk"), F.col(id_col).alias("_id"), pm.alias("pm"))
            .groupBy("chunk")
            .agg(F.array_sort(F.collect_list(F.struct("_id", "pm"))).alias("_p"))
            .select("chunk", F.concat(F.lit(head), F.array_join(F.transform("_p", lambda e: e["pm"]), ""),
                                      F.lit("</Document></kml>")).alias("value")))
    docs.repartition("chunk").write.mode("overwrite").partitionBy("chunk").text(path)
    return path
