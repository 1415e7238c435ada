"""Quality masks: fused per-pixel predicates, external mask matching, shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import pixel as P

CELL = ("city", "month_idx", "y", "x")


def quality_masks(px: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """``px`` with booleans ``cloud, shadow, veg, combined``; one projection, no join unless given.

    ``external`` (``city, month_idx, y, x, value``) overrides the spectral cloud
    test wherever its scene has a mask: any non-zero value is cloud.
    """
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    clouds = P.cloud(r, g, b)
    if external is not None:
        px = px.join(external.select(*CELL, (F.col("value") > 0).alias("masked")), list(CELL), "left")
        clouds = F.coalesce("masked", clouds)
    marked = px.withColumn("cloud", clouds).withColumn("shadow", P.shadow(r, g, b, F.col("cloud"))).withColumn("veg", P.vegetation(r, g))
    return marked.withColumn("combined", F.col("cloud") | F.col("shadow") | F.col("veg"))


def quality_summary(quality: DataFrame) -> DataFrame:
    """Counts and percentages of each mask by scene, in one pass."""
    n = F.count("*")
    share = lambda c: F.sum(F.col(c).cast("int"))
    names = ("cloud", "shadow", "veg", "combined")
    sums = quality.groupBy("city", "month_idx").agg(n.alias("n_px"), *[share(c).alias(f"n_{c}") for c in names])
    return sums.select("city", "month_idx", "n_px", *[f"n_{c}" for c in names], (F.col("n_px") - F.col("n_combined")).alias("n_usable"), *[(F.lit(100.0) * F.col(f"n_{c}") / F.col("n_px")).alias(f"pct_{c}") for c in names])


def match_masks(scenes: DataFrame, masks: DataFrame, strict: bool = True, prefix: int = 20) -> DataFrame:
    """``scenes`` (``city, month_idx, file``) with the ``mask_file`` that belongs to each, or null.

    Strict: the same year and month in the name. Otherwise the order of a lenient
    search: equal stems first, then a mask whose stem is part of the scene's, or
    holds its first ``prefix`` characters; names in order, the first one wins.
    Both are equi-joins on the city, so a pair is only formed within one.
    """
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    left = scenes.withColumn("_s", stem(F.col("file")))
    right = masks.select(F.col("city").alias("_c"), F.col("mask_file"), stem(F.col("mask_file")).alias("_m"))
    if strict:
        hit = P.month_name(F.col("_s")) == P.month_name(F.col("_m"))
        rank = F.lit(0)
    else:
        loose = F.contains(F.col("_s"), F.col("_m")) | F.contains(F.col("_m"), F.substring("_s", 1, prefix))
        hit = (F.col("_s") == F.col("_m")) | loose
        rank = F.when(F.col("_s") == F.col("_m"), 0).otherwise(1)
    found = left.join(right, (F.col("city") == F.col("_c")) & hit, "left")
    best = Window.partitionBy("city", "month_idx", "file").orderBy(rank, "mask_file")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(*scenes.columns, "mask_file")


def month_index(files: DataFrame) -> DataFrame:
    """``city, file`` -> the place of each file among its city's names, from 0."""
    return files.withColumn("month_idx", F.row_number().over(Window.partitionBy("city").orderBy("file")) - 1)
