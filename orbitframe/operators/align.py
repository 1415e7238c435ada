"""Alignment: reprojection, whole-pixel registration, upsampling; kernels per scene, metadata as expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import constants as K
from orbitframe.functions import pixel as P
from orbitframe.operators import kernels
from orbitframe.operators.reproject import to_mercator

#: A scene as a row: one byte payload per band.
SCENE = "city int, month_idx int, height int, width int, r binary, g binary, b binary, a binary"
_PAYLOADS = ("r", "g", "b", "a")


def to_scenes(px: DataFrame) -> DataFrame:
    """Pixels gathered to one row per scene; a scene's size is fixed by its sensor grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
        out = {"city": [pdf["city"].iloc[0]], "month_idx": [pdf["month_idx"].iloc[0]], "height": [h], "width": [w]}
        for band in ("r", "g", "b", "a"):
            dense = np.zeros((h, w), np.uint8)
            dense[pdf["y"], pdf["x"]] = pdf[band]
            out[band] = [dense.tobytes()]
        return pd.DataFrame(out)

    return px.groupBy("city", "month_idx").applyInPandas(run, SCENE)


def to_pixels(scenes: DataFrame) -> DataFrame:
    """The logical pixel view of scene rows."""

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples():
                y, x = np.divmod(np.arange(row.height * row.width), row.width)
                bands = {b: np.frombuffer(getattr(row, b), np.uint8).astype(np.int32) for b in ("r", "g", "b", "a")}
                yield pd.DataFrame({"city": np.int32(row.city), "month_idx": np.int32(row.month_idx), "y": y.astype(np.int32), "x": x.astype(np.int32), **bands})

    return scenes.mapInPandas(run, "city int, month_idx int, y int, x int, r int, g int, b int, a int")


def _map_bands(scenes: DataFrame, change) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                shape = (row["height"], row["width"])
                for band in ("r", "g", "b", "a"):
                    made = change(np.frombuffer(row[band], np.uint8).reshape(shape), band)
                    row[band] = made.tobytes()
                row["height"], row["width"] = made.shape
                rows.append(row)
            yield pd.DataFrame(rows, columns=pdf.columns)

    return scenes.mapInPandas(run, SCENE)


def pad_scenes(scenes: DataFrame, least: int = K.BASE_SIZE) -> DataFrame:
    return _map_bands(scenes, lambda band, _: kernels.edge_pad(band, least))


def upsample(scenes: DataFrame, size: int = K.TARGET_SIZE, least: int = K.BASE_SIZE) -> DataFrame:
    """Edge-padded to ``least``, then cubic to ``size`` squared."""
    return _map_bands(scenes, lambda band, _: kernels.resize_cubic(kernels.edge_pad(band, least), size, size))


def resize_mask(scenes: DataFrame, size: int) -> DataFrame:
    return _map_bands(scenes, lambda band, _: kernels.resize_nearest(band, size, size))


def nearest_pixels(px: DataFrame, source: int, target: int) -> DataFrame:
    """Nearest-neighbour resize as an index join: every target pixel names its source pixel."""
    spark = px.sparkSession
    axis = spark.range(target).select(F.col("id").cast("int").alias("to"), F.floor((2 * F.col("id") + 1) * source / (2 * target)).cast("int").alias("at"))
    rows = axis.select(F.col("to").alias("ty"), F.col("at").alias("y"))
    cols = axis.select(F.col("to").alias("tx"), F.col("at").alias("x"))
    return px.join(rows, "y").join(cols, "x").drop("y", "x").withColumnsRenamed({"ty": "y", "tx": "x"})


def phase_shifts(scenes: DataFrame, band: str = "r") -> DataFrame:
    """``city, month_idx, drow, dcol`` of every month against month 0, which gives 0, 0."""
    ref = scenes.where("month_idx = 0").select("city", F.col(band).alias("ref"), F.col("height").alias("rh"), F.col("width").alias("rw"))
    pairs = scenes.select("city", "month_idx", "height", "width", F.col(band).alias("mov")).join(ref, "city")

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                a = np.frombuffer(row.ref, np.uint8).reshape(row.rh, row.rw)
                b = np.frombuffer(row.mov, np.uint8).reshape(row.height, row.width)
                h, w = min(row.rh, row.height), min(row.rw, row.width)
                out.append((row.city, row.month_idx, *(kernels.phase_shift(a[:h, :w], b[:h, :w]) if row.month_idx else (0, 0))))
            yield pd.DataFrame(out, columns=["city", "month_idx", "drow", "dcol"])

    return pairs.mapInPandas(run, "city int, month_idx int, drow int, dcol int")


def apply_shifts(scenes: DataFrame, most: int = K.MAX_SHIFT_PIXELS) -> DataFrame:
    """Scenes with ``drow, dcol, transform`` -> the moved transform and a ``status``; a shift beyond ``most`` counts as none."""
    large = F.hypot(F.col("drow").cast("double"), F.col("dcol").cast("double")) > most
    rows = scenes.withColumn("large_shift", large)
    rows = rows.withColumns({"drow": F.when(large, 0).otherwise(F.col("drow")), "dcol": F.when(large, 0).otherwise(F.col("dcol"))})
    status = F.when(F.col("month_idx") == 0, "reference").when((F.col("drow") != 0) | (F.col("dcol") != 0), "shifted").otherwise("no_shift")
    return rows.withColumn("transform", P.affine_move(F.col("transform"), F.col("dcol"), F.col("drow"))).withColumn("status", status)


def shift_summary(applied: DataFrame) -> DataFrame:
    """Per city: scenes by status, refused shifts, and the largest that was applied."""
    size = F.hypot(F.col("drow").cast("double"), F.col("dcol").cast("double"))
    count = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return applied.groupBy("city").agg(F.count("*").alias("n_scenes"), count("shifted"), count("no_shift"), F.count_if("large_shift").alias("n_refused"), F.max(size).alias("most"))


def needs_reprojection() -> Column:
    """Scenes whose grid is not the target's; an unknown one needs it too."""
    return ~F.col("epsg").eqNullSafe(F.lit(K.TARGET_EPSG))


def reproject(scenes: DataFrame, transform_col: str = "transform") -> DataFrame:
    """Scenes in degrees (EPSG 4326) or metres of a zone (326xx, 327xx) to Mercator; those in it already pass unchanged.

    Needs ``epsg`` and ``transform``. Any other system, an unknown one included,
    is an error: its pixels have no place on the target grid.
    """
    fields = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    schema = f"{SCENE}, epsg int, {transform_col} {fields}"

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                if row["epsg"] != K.TARGET_EPSG:
                    epsg = None if pd.isna(row["epsg"]) else int(row["epsg"])
                    bands = [np.frombuffer(row[n], np.uint8).reshape(row["height"], row["width"]) for n in _PAYLOADS]
                    made, moved = to_mercator(bands, tuple(row[transform_col][k] for k in P.AFFINE), epsg)
                    row |= {n: band.tobytes() for n, band in zip(_PAYLOADS, made, strict=True)}
                    row |= {"height": made[0].shape[0], "width": made[0].shape[1], "epsg": K.TARGET_EPSG, transform_col: dict(zip(P.AFFINE, moved, strict=True))}
                rows.append(row)
            yield pd.DataFrame(rows, columns=pdf.columns)

    names = ["city", "month_idx", "height", "width", *_PAYLOADS, "epsg", transform_col]
    return scenes.select(*names).mapInPandas(run, schema)
