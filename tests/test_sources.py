"""Codecs and readers by round trip."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import labels
from orbitframe.sources import geojson, geotiff, png


def test_geotiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    bands = rng.integers(0, 256, (4, 70, 33)).astype(np.uint8)
    t = (4.78, 0.0, 100.5, 0.0, -4.78, 200.25)
    folder = tmp_path / "A_1" / "images"
    folder.mkdir(parents=True)
    data = geotiff.write_bands(bands, t)
    (folder / "m_2018_01.tif").write_bytes(data)
    (folder / "broken.tif").write_bytes(b"II*\0nonsense")
    assert (geotiff.read_bands(data) == bands).all() and geotiff.read_header(data).transform == t
    rows = geotiff.read_scenes(spark, str(tmp_path), on_error="zero").orderBy("file").collect()
    assert [r["width"] for r in rows] == [None, 33] and rows[1]["epsg"] == 3857
    assert (np.frombuffer(rows[1]["a"], np.uint8).reshape(70, 33) == bands[3]).all()
    assert "r" not in geotiff.read_metadata(spark, str(folder), "m_*.tif").columns
    heads = geotiff.read_metadata(spark, str(tmp_path), on_error="zero")
    assert "content" not in heads._jdf.queryExecution().executedPlan().toString()
    assert heads.exceptAll(geotiff.read_scenes(spark, str(tmp_path), payload=False, on_error="zero")).isEmpty() and heads.count() == 2
    (folder / "nothing.tif").touch()  # Spark lists no row for a file of no bytes
    assert geotiff.read_metadata(spark, str(tmp_path), on_error="zero").count() == geotiff.read_scenes(spark, str(tmp_path), on_error="zero").count() == 2
    (folder / "nothing.tif").unlink()
    for _ in range(2):  # a second run leaves the same files
        sizes = geotiff.write_files(geotiff.read_scenes(spark, str(folder), "m_*.tif"), f"{tmp_path}/single ones")
    assert {p.name: p.stat().st_size for p in (tmp_path / "single ones").iterdir()} == {r["file"]: r["bytes"] for r in sizes.collect()}
    assert (geotiff.read_bands((tmp_path / "single ones" / "m_2018_01.tif").read_bytes()) == bands).all()
    assert geotiff.read_metadata(spark, f"{tmp_path}/single ones").first()["transform"]["f"] == 200.25
    (tmp_path / "single ones" / "m_2018_01.tif").unlink()
    with pytest.raises(Exception, match="TIFF|unpack"):
        geotiff.read_scenes(spark, str(tmp_path)).collect()
    assert [r[0] for r in geotiff.discover_cities(spark, str(tmp_path), prefix="A").collect()] == ["A_1"]
    back = geotiff.write_scenes(geotiff.read_scenes(spark, str(folder), "m_*.tif"), str(tmp_path / "out"))
    assert (geotiff.read_bands(back.first()["content"]) == bands).all()


def test_png_round_trip():
    rng = np.random.default_rng(2)
    for shape in ((5, 7), (9, 4, 3)):
        image = rng.integers(0, 256, shape).astype(np.uint8)
        assert (png.read_png(png.write_png(image)).reshape(shape) == image).all()
    m = rng.integers(0, 2, (3, 8, 8))
    assert (png.decode_fbc(png.encode_fbc(*m)) == m.transpose(1, 2, 0)).all()
    assert png.decode_fbc(png.encode_mask(m[0])).shape == (8, 8, 3)
    assert not png.decode_fbc(png.empty_fbc(4, 4)).any()


def test_geojson(spark, tmp_path):
    ring = [[0.25, 0.25], [3.75, 0.25], [3.75, 3.75], [0.25, 3.75], [0.25, 0.25]]
    hole = [[1.25, 1.25], [2.75, 1.25], [2.75, 2.75], [1.25, 2.75], [1.25, 1.25]]
    features = [
        {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring, hole]}},
        {"type": "Feature", "geometry": None},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [hole]]}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "x_2018_02.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    found = geojson.read_polygons(spark, str(tmp_path))
    assert sorted((r["poly_id"], r["part"], len(r["rings"])) for r in found.collect()) == [(0, 0, 2), (2, 0, 1), (2, 1, 1)]
    rings = geojson.ring_rows(found.where("poly_id = 0")).select(F.lit(0).alias("city"), F.lit(0).alias("month_idx"), "poly_id", "ring")
    grid = spark.range(25).select(F.lit(0).alias("city"), F.lit(0).alias("month_idx"), F.floor(F.col("id") / 5).cast("int").alias("y"), (F.col("id") % 5).cast("int").alias("x"))
    burnt = {(r["y"], r["x"]) for r in labels.rasterize(grid, rings).where("footprint = 1").collect()}
    assert burnt == {(y, x) for y in range(4) for x in range(4)} - {(y, x) for y in (1, 2) for x in (1, 2)}


def test_label_resolution(spark):
    cars = spark.createDataFrame([("a", "2018_01", "l/x.geojson"), ("a", "2018_02", None), ("b", "2018_03", None)], "city_id string, month_name string, labels_geojson string")
    files = spark.createDataFrame([("/t/l/x.geojson", "a"), ("/t/k/q_2018_02_z.geojson", "a"), ("/t/k/p_2018_02_z.geojson", "a")], "path string, city_id string")
    got = {r["month_name"]: r["label_path"] for r in geojson.resolve_label(cars, files, "/t", "/u").collect()}
    assert got == {"2018_01": "/t/l/x.geojson", "2018_02": "/t/k/p_2018_02_z.geojson", "2018_03": None}
