"""The physical form for full-size scenes: byte payloads by block, kernels over whole payloads.

A block is ``city, month_idx, brow, bcol, height, width, r, g, b, a``. Every
operator here is the pixel form's formula on arrays and is tested to agree with
it; statistics are 256-bin histograms, which add up over blocks in any order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.functions import constants as K
from orbitframe.operators import kernels

KEY = "city int, month_idx int, brow int, bcol int"
BLOCK = f"{KEY}, height int, width int, r binary, g binary, b binary, a binary"
_NAMES = ["city", "month_idx", "brow", "bcol"]


def cut(scenes: DataFrame, size: int = K.PATCH_SIZE) -> DataFrame:
    """Scene rows (``align.SCENE``) to blocks; the last row and column may be smaller."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                bands = {b: np.frombuffer(row[b], np.uint8).reshape(row["height"], row["width"]) for b in "rgba"}
                out = []
                for y in range(0, row["height"], size):
                    for x in range(0, row["width"], size):
                        part = {b: v[y : y + size, x : x + size] for b, v in bands.items()}
                        h, w = part["r"].shape
                        out.append((row["city"], row["month_idx"], y // size, x // size, h, w, *(np.ascontiguousarray(part[b]).tobytes() for b in "rgba")))
                yield pd.DataFrame(out, columns=[*_NAMES, "height", "width", *"rgba"])

    return scenes.mapInPandas(run, BLOCK)


def write_blocks(blocks: DataFrame, path: str) -> None:
    """By city and month, rows in block order: a window read touches one folder and few row groups."""
    blocks.repartition("city", "month_idx").sortWithinPartitions("city", "month_idx", "brow", "bcol").write.mode("overwrite").partitionBy("city", "month_idx").parquet(path)


def read_window(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int], bands: tuple[str, ...] = tuple("rgba")) -> DataFrame:
    """Blocks within row and column ranges (ends included), only the asked bands; all pruned at the scan."""
    at = F.col("brow").between(*rows) & F.col("bcol").between(*cols)
    return spark.read.parquet(path).where(at).select(*_NAMES, "height", "width", *bands)


def _bands(row: dict, names: str = "rgba") -> dict[str, np.ndarray]:
    return {b: np.frombuffer(row[b], np.uint8) for b in names}


def mask_counts(blocks: DataFrame) -> DataFrame:
    """Per block: pixels and pixels of each quality mask."""
    names = ("cloud", "shadow", "veg", "combined")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                found = kernels.quality(**_bands(row, "rgb"))
                out.append((*(row[n] for n in _NAMES), row["height"] * row["width"], *(int(found[n].sum()) for n in names)))
            yield pd.DataFrame(out, columns=[*_NAMES, "n_px", *(f"n_{n}" for n in names)])

    schema = f"{KEY}, n_px long, " + ", ".join(f"n_{n} long" for n in names)
    return blocks.select(*_NAMES, "height", "width", *"rgb").mapInPandas(run, schema)


def mask_payloads(blocks: DataFrame) -> DataFrame:
    """Blocks with a ``quality`` payload: bits 1 cloud, 2 shadow, 4 vegetation."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = []
            for row in pdf.to_dict("records"):
                q = kernels.quality(**_bands(row, "rgb"))
                made.append((q["cloud"] + 2 * q["shadow"] + 4 * q["veg"]).astype(np.uint8).tobytes())
            yield pdf.assign(quality=made)

    return blocks.mapInPandas(run, f"{BLOCK}, quality binary")


def summarize(counts: DataFrame) -> DataFrame:
    """Block counts to the pixel form's scene summary."""
    sums = counts.groupBy("city", "month_idx").agg(*[F.sum(c).alias(c) for c in counts.columns if c.startswith("n_")])
    names = ("cloud", "shadow", "veg", "combined")
    return sums.select(
        "city", "month_idx", "n_px", *[f"n_{n}" for n in names], (F.col("n_px") - F.col("n_combined")).alias("n_usable"), *[(F.lit(100.0) * F.col(f"n_{n}") / F.col("n_px")).alias(f"pct_{n}") for n in names]
    )


def histograms(blocks: DataFrame) -> DataFrame:
    """``city, month_idx, band, v, n``: usable pixels by value, added up inside each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for row in pdf.to_dict("records"):
                bands = _bands(row, "rgb")
                usable = ~kernels.quality(**bands)["combined"]
                for band, v in bands.items():
                    key = (row["city"], row["month_idx"], band)
                    held[key] = held.get(key, 0) + np.bincount(v[usable], minlength=256)
            if len(held) > 3000:  # scenes of one task: keep what is held small
                yield _flat(held)
                held = {}
        yield _flat(held)

    parts = blocks.select(*_NAMES, "height", "width", *"rgb").mapInPandas(run, "city int, month_idx int, band string, v int, n long")
    return parts.groupBy("city", "month_idx", "band", "v").agg(F.sum("n").alias("n"))


def _flat(held: dict[tuple, np.ndarray]) -> pd.DataFrame:
    out = [(*key, v, int(n)) for key, counts in held.items() for v, n in enumerate(counts) if n or v == 0]
    return pd.DataFrame(out, columns=["city", "month_idx", "band", "v", "n"])


def stats(hist: DataFrame, least: int = K.MIN_ZSCORE_VALUES) -> DataFrame:
    """``n, mean, std`` of each scene and band, exactly as from the pixels."""
    v, k = F.col("v").cast("long"), F.col("n")
    sums = hist.groupBy("city", "month_idx", "band").agg(F.sum(k).alias("n"), F.sum(k * v).alias("s1"), F.sum(k * v * v).alias("s2"))
    n, some = F.col("n").cast("double"), F.col("n") >= least
    variance = F.try_divide((F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double"), n * n)
    return sums.select(
        "city", "month_idx", "band", "n", F.when(some, F.try_divide(F.col("s1"), n)).otherwise(0.0).alias("mean"), F.when(some, F.sqrt(variance) + K.STD_EPSILON).otherwise(1.0).alias("std")
    )


def rescale(blocks: DataFrame, statistics: DataFrame, min_usable: int = K.MIN_USABLE_PIXELS) -> DataFrame:
    """Blocks moved to month 0's mean and spread by a 256-entry table per scene and band.

    The tables are a few rows per scene; they are joined on (city, month), never
    the pixels.
    """
    wide = statistics.groupBy("city", "month_idx").agg(*[F.max(F.when(F.col("band") == b, F.struct("n", "mean", "std"))).alias(f"st_{b}") for b in K.BANDS])
    ref = wide.where("month_idx = 0").select("city", *[F.col(f"st_{b}").alias(f"ref_{b}") for b in K.BANDS])
    joined = blocks.join(wide, ["city", "month_idx"]).join(ref, "city")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        value = np.arange(256, dtype=float)
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                if row["month_idx"] and row["st_r"]["n"] >= min_usable:
                    for b in K.BANDS:
                        s, f = row[f"st_{b}"], row[f"ref_{b}"]
                        table = np.clip((value - s["mean"]) / s["std"] * f["std"] + f["mean"], 0, 255).astype(np.uint8)
                        row[b] = table[np.frombuffer(row[b], np.uint8)].tobytes()
                rows.append(tuple(row[c] for c in (*_NAMES, "height", "width", *"rgba")))
            yield pd.DataFrame(rows, columns=[*_NAMES, "height", "width", *"rgba"])

    return joined.mapInPandas(run, BLOCK)


def to_pixels(blocks: DataFrame, size: int = K.PATCH_SIZE) -> DataFrame:
    """The logical pixel view of blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                y, x = np.divmod(np.arange(row["height"] * row["width"]), row["width"])
                yield pd.DataFrame(
                    {"city": np.int32(row["city"]), "month_idx": np.int32(row["month_idx"]), "y": (y + row["brow"] * size).astype(np.int32), "x": (x + row["bcol"] * size).astype(np.int32)}
                    | {b: v.astype(np.int32) for b, v in _bands(row).items()}
                )

    return blocks.mapInPandas(run, "city int, month_idx int, y int, x int, r int, g int, b int, a int")
