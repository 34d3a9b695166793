"""A FeatureCollection read in many byte ranges equals the read in one, whatever strings and nesting it has."""

import json
import os

from pyspark.sql import functions as F

from residuum.session import shared_path
from residuum.sources import geo_files as G


def _document():
    odd = ['a "quoted" } name', "{", "}{", "back\\slash\\", 'end\\"', "é😀\u2028", "line\nbreak", "", "]}", None]
    feats = []
    for i in range(120):
        ring = [[float(i), 0.0], [i + 1.0, 0.0], [i + 1.0, 1.0], [float(i), 0.0]]
        geometry = [{"type": "Point", "coordinates": [i + 0.5, 1.25]}, {"type": "Polygon", "coordinates": [ring]}, None][i % 3]
        feats.append({"type": "Feature", "id": i, "properties": {"name": odd[i % len(odd)], "i": str(i)}, "geometry": geometry})
    return {"type": "FeatureCollection", "name": "odd } { name", "crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs"}}, "features": feats,
            "bbox": [0, 0, 1, 1], "note": {"type": "Feature?"}}


def _read(spark, path, size):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        tasks = spark.read.text(path).rdd.getNumPartitions()
        return tasks, [(r.position, r.properties, r.geom_type, r.coordinates and json.loads(r.coordinates))
                       for r in G.scan_geojson(spark, path).orderBy("position").collect()]
    finally:
        for k, v in zip(("maxPartitionBytes", "openCostInBytes"), before):
            spark.conf.set(f"spark.sql.files.{k}", v)


def test_many_ranges_equal_one(spark):
    doc = _document()
    root = shared_path(spark, "t_ranges")
    os.makedirs(root)
    for name, indent in (("wide.json", 1), ("narrow.json", None)):
        with open(f"{root}/{name}", "w") as f:
            json.dump(doc, f, indent=indent, ensure_ascii=indent is None)
        want = [(i, f["properties"], f["geometry"] and f["geometry"]["type"], f["geometry"] and f["geometry"]["coordinates"]) for i, f in enumerate(doc["features"])]
        for size in (10_000_000, 3000, 400):
            tasks, got = _read(spark, f"{root}/{name}", size)
            assert tasks >= 3 or size == 10_000_000
            assert got == want, (name, size)
    # two documents: positions go on in the order of the files
    _, both = _read(spark, root, 3000)
    assert [g[0] for g in both] == list(range(240)) and [g[1:] for g in both[:120]] == [w[1:] for w in want]
    rings = G.geojson_rings(G.scan_geojson(spark, f"{root}/wide.json"))
    assert [r.area_ord for r in rings.orderBy("area_ord").collect()] == list(range(1, 120, 3))


def test_empty_collection(spark):
    root = shared_path(spark, "t_no_features")
    os.makedirs(root)
    with open(f"{root}/x.json", "w") as f:
        f.write('{"type": "FeatureCollection", "features": []}\n')
    assert G.scan_geojson(spark, root).count() == 0
