"""Footprint labels from GeoJSON and patch descriptions as JSON, parsed by Spark's own functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GEOMETRY = "struct<type:string,coordinates:string>"
_COLLECTION = f"struct<type:string,features:array<struct<geometry:{_GEOMETRY}>>>"
_POLYGON = "array<array<array<double>>>"

SIDECAR = (
    "patch_id string, city_id string, city_id_short string, month_idx int, month_name string, row int, col int, patch_size_px int, row_offset_px int, col_offset_px int, "
    "bounds_epsg3857 struct<left:double,right:double,top:double,bottom:double>, labels_geojson string, pipeline_version string"
)


def read_polygons(spark: SparkSession, path: str, glob: str = "*.geojson") -> DataFrame:
    """``file, poly_id, part, rings`` of all Polygons and MultiPolygons; null and other geometries are left out."""
    texts = spark.read.option("wholetext", "true").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
    return parse_polygons(texts.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")))


def parse_polygons(texts: DataFrame) -> DataFrame:
    """From ``file, text``: each polygon with its rings, the outer one first."""
    features = texts.select("file", F.posexplode(F.from_json("text", _COLLECTION)["features"]).alias("poly_id", "f"))
    shapes = features.where(F.col("f.geometry").isNotNull()).select("file", "poly_id", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("text"))
    single = F.array(F.from_json("text", _POLYGON))
    many = F.from_json("text", f"array<{_POLYGON}>")
    parts = F.when(F.col("kind") == "Polygon", single).when(F.col("kind") == "MultiPolygon", many)
    exploded = shapes.select("file", "poly_id", F.posexplode(parts).alias("part", "raw"))
    points = lambda ring: F.transform(F.filter(ring, lambda p: F.size(p) >= 2), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return exploded.where(F.col("raw").isNotNull()).select("file", "poly_id", "part", F.transform("raw", points).alias("rings"))


def ring_rows(polygons: DataFrame) -> DataFrame:
    """One row per ring: holes take part in the crossing count like outer rings."""
    return polygons.select("file", "poly_id", "part", F.posexplode("rings").alias("ring_idx", "ring"))


def write_sidecars(described: DataFrame, path: str) -> None:
    described.select("sidecar.*").write.mode("overwrite").json(path)


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SIDECAR).json(path)


def resolve_label(sidecars: DataFrame, available: DataFrame, root: str, parent: str) -> DataFrame:
    """``label_path``: the named file under the first root, under its parent, or the first whose name has the month."""
    have = lambda prefix, out: available.select(F.col("path").alias(out))
    rows = sidecars.withColumns({"_a": F.concat(F.lit(root + "/"), "labels_geojson"), "_b": F.concat(F.lit(parent + "/"), "labels_geojson")})
    first = rows.join(have(root, "_pa"), F.col("_a") == F.col("_pa"), "left")
    second = first.join(have(parent, "_pb"), F.col("_b") == F.col("_pb"), "left")
    by_month = available.select(F.nullif(F.regexp_extract("path", r"(\d{4}_\d{2})", 1), F.lit("")).alias("_m"), F.col("path").alias("_pm"), F.col("city_id").alias("_c"))
    third = by_month.where("_m is not null").groupBy("_c", "_m").agg(F.min("_pm").alias("_pm"))
    joined = second.join(third, (F.col("city_id") == F.col("_c")) & (F.col("month_name") == F.col("_m")), "left")
    return joined.withColumn("label_path", F.coalesce("_pa", "_pb", "_pm")).select(*sidecars.columns, "label_path")
