"""Label engineering: polygons to footprints, boundaries, contacts and instances."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import constants as K
from orbitframe.operators import kernels

SCENE = ("city", "month_idx")
#: Labels are made patch by patch: what lies in the next patch neither erodes nor connects.
PATCH = (*SCENE, "prow", "pcol")


def scale_ring(ring: Column, by: float) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] * by).alias("x"), (p["y"] * by).alias("y")))


def shift_ring(ring: Column, left: Column, top: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((p["x"] - left).alias("x"), (p["y"] - top).alias("y")))


def edges(polygons: DataFrame) -> DataFrame:
    """``city, month_idx, poly_id, seq, x1, y1, x2, y2``: one row per side of each closed ring."""
    sides = F.transform(
        F.sequence(F.lit(0), F.size("ring") - 2),
        lambda i: F.struct(i.alias("seq"), F.get("ring", i)["x"].alias("x1"), F.get("ring", i)["y"].alias("y1"), F.get("ring", i + 1)["x"].alias("x2"), F.get("ring", i + 1)["y"].alias("y2")),
    )
    return polygons.where(F.size("ring") > 1).select(*SCENE, "poly_id", F.explode(sides).alias("s")).select(*SCENE, "poly_id", "s.*")


def patch_touch(polygons: DataFrame, size: int, grid: int) -> DataFrame:
    """Patches that a polygon's bounding box touches (an edge in common counts): the candidates of the exact tests.

    Each box lists the few cells it covers, so the join with patches is an
    equi-join on the cell and never a scan of polygons for every patch.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    first = lambda lo: F.greatest(F.lit(0), F.ceil(lo / size) - 1).cast("int")
    last = lambda hi: F.least(F.lit(grid - 1), F.floor(hi / size)).cast("int")
    boxed = polygons.withColumns({"c0": first(F.array_min(xs)), "c1": last(F.array_max(xs)), "r0": first(F.array_min(ys)), "r1": last(F.array_max(ys))})
    inside = boxed.where("c0 <= c1 and r0 <= r1")
    rows = inside.withColumn("prow", F.explode(F.sequence("r0", "r1")))
    return rows.withColumn("pcol", F.explode(F.sequence("c0", "c1"))).select(*SCENE, "prow", "pcol", "poly_id", "ring")


def polygon_patches(polygons: DataFrame, size: int, grid: int) -> DataFrame:
    """Distinct patches that some polygon intersects, touching included; the boxes are tested exactly by clipping."""

    def exact(batches):
        for pdf in batches:
            hit = [
                bool(kernels.clip_ring([(p["x"], p["y"]) for p in ring][:-1], (c * size, r * size, (c + 1) * size, (r + 1) * size)))
                for ring, r, c in zip(pdf["ring"], pdf["prow"], pdf["pcol"], strict=True)
            ]
            yield pdf.loc[hit, [*SCENE, "prow", "pcol"]]

    found = patch_touch(polygons, size, grid).mapInPandas(exact, "city int, month_idx int, prow int, pcol int")
    return found.distinct()


def rasterize(px: DataFrame, polygons: DataFrame) -> DataFrame:
    """``px`` (``city, month_idx, y, x``) with ``footprint``: the centre lies in some polygon.

    A side meets only the pixel rows its height spans: it is listed by row and
    joined on (city, month, row).
    """
    sides = edges(polygons).where("y1 <> y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    first, last = F.ceil(low - 0.5).cast("int"), (F.ceil(high - 0.5) - 1).cast("int")
    rows = sides.withColumns({"r0": first, "r1": last}).where("r0 <= r1").withColumn("y", F.explode(F.sequence("r0", "r1")))
    at = (F.col("x2") - F.col("x1")) * (F.col("y") + 0.5 - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossings = rows.select(*SCENE, "y", "poly_id", at.alias("cross"))
    hits = px.select(*SCENE, "y", "x").join(crossings, [*SCENE, "y"]).where(F.col("x") + 0.5 < F.col("cross"))
    odd = hits.groupBy(*SCENE, "y", "x", "poly_id").agg((F.count("*") % 2).alias("odd")).where("odd = 1").select(*SCENE, "y", "x").distinct()
    return px.join(odd.withColumn("_in", F.lit(1)), [*SCENE, "y", "x"], "left").withColumn("footprint", F.coalesce("_in", F.lit(0))).drop("_in")


def _frame(by: tuple[str, ...], order: str, radius: int) -> Window:
    return Window.partitionBy(*by).orderBy(order).rangeBetween(-radius, radius)


def boundary(px: DataFrame, radius: int = K.BOUNDARY_PX, key: tuple[str, ...] = PATCH) -> DataFrame:
    """``px`` with ``boundary``: footprint off its square erosion; frames ignore what is outside, so borders of a patch do not erode."""
    along = px.withColumn("_m", F.min("footprint").over(_frame((*key, "y"), "x", radius)))
    eroded = along.withColumn("_e", F.min("_m").over(_frame((*key, "x"), "y", radius)))
    return eroded.withColumn("boundary", F.col("footprint") * (1 - F.col("_e"))).drop("_m", "_e")


def per_patch(px: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], out: str, value: str = "footprint", key: tuple[str, ...] = PATCH) -> DataFrame:
    """A numpy kernel over each patch's dense ``value``; one task holds one patch, whose size is bounded by the tiling."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"] - pdf["y"].min(), pdf["x"] - pdf["x"].min()
        dense = np.zeros((y.max() + 1, x.max() + 1), np.int64)
        dense[y, x] = pdf[value]
        return pdf[[*key, "y", "x"]].assign(**{out: kernel(dense)[y, x].astype(np.int64)})

    kinds = dict(px.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*key, "y", "x")) + f", {out} long"
    return px.select(*key, "y", "x", value).groupBy(*key).applyInPandas(run, schema)


def component_labels(px: DataFrame, diagonal: bool = True, key: tuple[str, ...] = PATCH) -> DataFrame:
    """``label``: the smallest flat index, in its patch, of a pixel's component; -1 off the footprint."""
    return per_patch(px, lambda m: kernels.components(m, diagonal), "label", key=key)


def contact(px: DataFrame, radius: int = K.CONTACT_PX, key: tuple[str, ...] = PATCH) -> DataFrame:
    return per_patch(px, lambda m: kernels.contact(m, radius), "contact", key=key)


def watershed(px: DataFrame, apart: int = K.PEAK_DISTANCE, split: bool = False, key: tuple[str, ...] = PATCH) -> DataFrame:
    """``watershed`` 0/1 of components with an interior peak, or, with ``split``, a label per building."""
    return per_patch(px, lambda m: kernels.watershed_split(m, apart) if split else kernels.watershed_keep(m, apart), "watershed", key=key)


def fbc(px: DataFrame, key: tuple[str, ...] = PATCH) -> DataFrame:
    """Footprint, boundary and contact channels of each pixel, in one pass over a patch."""
    at = [*key, "y", "x"]
    return boundary(px, key=key).join(contact(px, key=key), at).select(*at, "footprint", "boundary", "contact")


def present_sidecars(sidecars: DataFrame, patches: DataFrame) -> DataFrame:
    """``sidecars`` with ``present``: whether the patch they describe exists; masks are made for those only."""
    have = patches.select(*PATCH).distinct().withColumn("_there", F.lit(True))
    return sidecars.join(have, list(PATCH), "left").withColumn("present", F.col("_there").isNotNull()).drop("_there")


def mask_summary(flagged: DataFrame, footprints: DataFrame) -> DataFrame:
    """Per city: sidecars, missing patches, masks to write, and how many of them are empty (no building pixel)."""
    filled = footprints.where("footprint = 1").select(*PATCH).distinct().withColumn("_full", F.lit(True))
    rows = flagged.join(filled, list(PATCH), "left")
    return rows.groupBy("city").agg(
        F.count("*").alias("n_sidecars"),
        F.count_if(~F.col("present")).alias("n_missing"),
        F.count_if("present").alias("n_written"),
        F.count_if(F.col("present") & F.col("_full").isNull()).alias("n_empty"),
    )
