"""Cutting scenes into patches, keeping the useful ones, and describing them."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitframe.functions import constants as K
from orbitframe.functions import pixel as P

PATCH = ("city", "month_idx", "prow", "pcol")


def chip(px: DataFrame, size: int = K.PATCH_SIZE) -> DataFrame:
    """Each pixel with its patch: ``prow, pcol`` on a regular grid."""
    return px.withColumn("prow", F.floor(F.col("y") / size).cast("int")).withColumn("pcol", F.floor(F.col("x") / size).cast("int"))


def patch_summary(px: DataFrame, size: int = K.PATCH_SIZE) -> DataFrame:
    """One row per patch: pixel count, transparent pixels, sum of the three bands."""
    return chip(px, size).groupBy(*PATCH).agg(
        F.count("*").alias("n_px"), F.sum((F.col("a") == 0).cast("int")).alias("n_transparent"), F.sum(F.col("r") + F.col("g") + F.col("b")).alias("brightness")
    )


def mostly_nodata(share: float = K.NODATA_SHARE) -> Column:
    return F.col("n_transparent") / F.col("n_px") > share


def spectral_buildings(threshold: float = K.SPECTRAL_THRESHOLD) -> Column:
    """Mean of the three bands at or above the threshold, without a division."""
    return F.col("brightness") >= F.lit(3.0 * threshold) * F.col("n_px")


def draws(spark: SparkSession, n: int, seed: int = K.SAMPLE_SEED) -> DataFrame:
    """The first ``n`` numbers of the Mersenne twister's stream: ``k`` from 1, ``u``."""
    stream = random.Random(seed)
    return spark.createDataFrame([(k + 1, stream.random()) for k in range(n)], "k int, u double")


def select_patches(summary: DataFrame, buildings: DataFrame | None = None, exact: bool = False, spectral: float = K.SPECTRAL_THRESHOLD, keep: float = K.BACKGROUND_KEEP, seed: int = K.SAMPLE_SEED) -> DataFrame:
    """Patches with ``keep_reason``: nodata, building, background (kept) or sampled_out.

    ``buildings`` lists patches that a polygon touches, and scenes that have
    labels at all by ``labelled``; others fall back to the spectral test. Every
    background patch has a uniform draw: by a hash of its key, or, with
    ``exact``, the next number of a seeded stream that each city consumes in
    (month, row, column) order. The stream has at most one number per patch of
    the largest city, counted before it is made.
    """
    if buildings is None:
        rows = summary.withColumn("has_buildings", spectral_buildings(spectral))
    else:
        known = buildings.select(*PATCH).distinct().withColumn("touched", F.lit(True))
        labelled = buildings.select("city", "month_idx").distinct().withColumn("labelled", F.lit(True))
        rows = summary.join(known, list(PATCH), "left").join(labelled, ["city", "month_idx"], "left")
        rows = rows.withColumn("has_buildings", F.when(F.col("labelled").isNotNull(), F.col("touched").isNotNull()).otherwise(spectral_buildings(spectral))).drop("touched", "labelled")
    rows = rows.withColumn("nodata", mostly_nodata())
    asks = ~F.col("nodata") & ~F.col("has_buildings")
    if exact:
        order = Window.partitionBy("city", asks).orderBy("month_idx", "prow", "pcol")
        numbered = rows.withColumn("k", F.when(asks, F.row_number().over(order)))
        most = numbered.agg(F.max("k")).first()[0] or 0
        rows = numbered.join(draws(summary.sparkSession, most, seed), "k", "left")
    else:
        u = F.pmod(F.xxhash64(*PATCH, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.withColumn("k", F.lit(None).cast("int")).withColumn("u", F.when(asks, u))
    reason = F.when(F.col("nodata"), "nodata").when(F.col("has_buildings"), "building").when(F.col("u") < keep, "background").otherwise("sampled_out")
    return rows.withColumn("keep_reason", reason)


def kept(selected: DataFrame) -> DataFrame:
    return selected.where(F.col("keep_reason").isin("building", "background"))


def chip_summary(selected: DataFrame) -> DataFrame:
    """Per city: patches by what became of them."""
    names = ("nodata", "building", "background", "sampled_out")
    return selected.groupBy("city").agg(F.count("*").alias("n_patches"), *[F.count_if(F.col("keep_reason") == n).alias(f"n_{n}") for n in names])


def scene_transform(scene: DataFrame) -> DataFrame:
    """``scene`` (``city, month_idx``) with an affine ``transform`` of surrogate scenes."""
    return scene.withColumn(
        "transform", P.affine(a=F.lit(1.25), b=F.lit(0.0), c=F.col("city") * 1000.5, d=F.lit(0.0), e=F.lit(-1.25), f=F.lit(5000.25) - F.col("month_idx") * 10)
    )


def patch_bounds(patches: DataFrame, scenes: DataFrame, size: int = K.PATCH_SIZE) -> DataFrame:
    """Patches with offsets, their window's transform and its bounds."""
    moved = patches.join(scenes.select("city", "month_idx", "transform"), ["city", "month_idx"])
    moved = moved.withColumn("row_offset_px", F.col("prow") * size).withColumn("col_offset_px", F.col("pcol") * size)
    moved = moved.withColumn("transform", P.affine_move(F.col("transform"), F.col("col_offset_px"), F.col("row_offset_px")))
    return moved.withColumn("bounds", P.bounds(F.col("transform"), F.lit(size), F.lit(size)))


def sidecars(patches: DataFrame, size: int = K.PATCH_SIZE, labels: Column | None = None) -> DataFrame:
    """The thirteen-field description of each patch, as a struct ``sidecar``.

    Needs ``city_id, month_idx, month_name, prow, pcol, bounds`` and offsets.
    """
    city = F.col("city_id")
    fields = F.struct(
        P.patch_name(P.short_city(city), F.col("month_idx"), F.col("prow"), F.col("pcol")).alias("patch_id"),
        city.alias("city_id"),
        P.short_city(city).alias("city_id_short"),
        F.col("month_idx").alias("month_idx"),
        F.coalesce("month_name", F.format_string("month_%02d", "month_idx")).alias("month_name"),
        F.col("prow").alias("row"),
        F.col("pcol").alias("col"),
        F.lit(size).alias("patch_size_px"),
        F.col("row_offset_px").alias("row_offset_px"),
        F.col("col_offset_px").alias("col_offset_px"),
        F.col("bounds").alias("bounds_epsg3857"),
        (F.lit(None).cast("string") if labels is None else labels).alias("labels_geojson"),
        F.lit(K.PIPELINE_VERSION).alias("pipeline_version"),
    )
    return patches.withColumn("sidecar", fields)


def label_file(months: DataFrame, labels: DataFrame) -> DataFrame:
    """``months`` (``city, month_name``) with the first label file that names the month.

    A name matches with the month as it is or without its underscore; the first
    in order wins.
    """
    right = labels.select(F.col("city").alias("_c"), "label_file")
    plain = F.replace("month_name", F.lit("_"), F.lit(""))
    hit = F.contains(F.col("label_file"), F.col("month_name")) | F.contains(F.replace(F.col("label_file"), F.lit("_"), F.lit("")), plain)
    joined = months.join(right, (F.col("city") == F.col("_c")) & hit, "left")
    return joined.groupBy(*months.columns).agg(F.min("label_file").alias("label_file"))
