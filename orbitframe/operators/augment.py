"""Augmentation with draws that depend on a seed and the window only."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitframe.functions import constants as K
from orbitframe.functions import pixel as P

#: Chances of the four geometric steps, in order of application.
FLIP_H, FLIP_V, ROT90, TRANSPOSE = 0.5, 0.5, 0.75, 0.3


def draw(seed: int, name: str, *key: str) -> Column:
    """A uniform number of [0, 1) by a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), *key), F.lit(1 << 30)) / float(1 << 30)


def geometry(windows: DataFrame, key: tuple[str, ...], seed: int = 0) -> DataFrame:
    """Windows with ``flip_h, flip_v, turns, transposed``: one draw for all their images and masks."""
    turns = F.when(draw(seed, "turn", *key) < ROT90, F.floor(draw(seed, "turns", *key) * 4)).otherwise(0).cast("int")
    return windows.withColumns(
        {
            "flip_h": draw(seed, "h", *key) < FLIP_H,
            "flip_v": draw(seed, "v", *key) < FLIP_V,
            "turns": turns,
            "transposed": draw(seed, "t", *key) < TRANSPOSE,
        }
    )


def apply_geometry(px: DataFrame, side: int) -> DataFrame:
    """Moves pixels of square patches by the window's draws: an index remap, values untouched."""
    last = side - 1
    x = F.when(F.col("flip_h"), last - F.col("x")).otherwise(F.col("x"))
    y = F.when(F.col("flip_v"), last - F.col("y")).otherwise(F.col("y"))
    moved = px.withColumns({"_y": y, "_x": x})
    turns = F.col("turns")
    ty = F.when(turns == 1, last - F.col("_x")).when(turns == 2, last - F.col("_y")).when(turns == 3, F.col("_x")).otherwise(F.col("_y"))
    tx = F.when(turns == 1, F.col("_y")).when(turns == 2, last - F.col("_x")).when(turns == 3, last - F.col("_y")).otherwise(F.col("_x"))
    turned = moved.withColumns({"_ty": ty, "_tx": tx})
    flip = F.col("transposed")
    return turned.withColumns({"y": F.when(flip, F.col("_tx")).otherwise(F.col("_ty")), "x": F.when(flip, F.col("_ty")).otherwise(F.col("_tx"))}).drop("_y", "_x", "_ty", "_tx")


def photometric(image: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Brightness and contrast, noise, gamma, blur, dropout and colour shift on one (H, W, 3) byte image."""
    out = image.astype(np.float32)
    if rng.random() < 0.7:
        out = out * (1 + rng.uniform(-0.25, 0.25)) + 255 * rng.uniform(-0.25, 0.25)
    if rng.random() < 0.5:
        out += rng.normal(0, np.sqrt(rng.uniform(10, 50)), out.shape)
    out = np.clip(out, 0, 255)
    if rng.random() < 0.5:
        out = 255 * (out / 255) ** (rng.uniform(80, 120) / 100)
    if rng.random() < 0.5:
        out = _blur(out, int(rng.choice([3, 5, 7])))
    if rng.random() < 0.4:
        h, w = out.shape[:2]
        for _ in range(int(rng.integers(1, 9))):
            y, x = rng.integers(0, h), rng.integers(0, w)
            out[y : y + max(1, h // 16), x : x + max(1, w // 16)] = 0
    out = out.astype(np.uint8)
    if rng.random() < 0.3:
        out = shift_hsv(out, *(rng.uniform(-limit, limit) for limit in HSV_LIMITS))
    return out


#: Largest shifts of hue (of 180), saturation and value (of 255).
HSV_LIMITS = (10.0, 20.0, 10.0)


def shift_hsv(image: np.ndarray, hue: float, saturation: float, value: float) -> np.ndarray:
    """A byte image with its hue turned and its saturation and value moved; hue counts half degrees, the others bytes."""
    rgb = image.astype(np.float64)
    top, low = rgb.max(axis=2), rgb.min(axis=2)
    span = np.where(top > low, top - low, 1)
    lead = rgb.argmax(axis=2)
    nxt, far = (np.take_along_axis(rgb, ((lead + k) % 3)[..., None], axis=2)[..., 0] for k in (1, 2))
    sixth = np.where(top > low, 2 * lead + (nxt - far) / span, 0)
    s = np.clip(np.where(top > 0, (top - low) / np.maximum(top, 1), 0) + saturation / 255, 0, 1)
    v = np.clip(top + value, 0, 255)
    sixth = (sixth + hue / 30) % 6
    away = np.stack([(5 + sixth) % 6, (3 + sixth) % 6, (1 + sixth) % 6], axis=2)  # how far each band is from its own peak
    part = np.clip(np.minimum(away, 4 - away), 0, 1)
    return np.clip(np.rint(v[..., None] * (1 - s[..., None] * part)), 0, 255).astype(np.uint8)


def photometric_patches(px: DataFrame, key: tuple[str, ...] = ("city", "month_idx", "prow", "pcol"), epoch: int = 0) -> DataFrame:
    """``key, y, x, r, g, b`` after ``photometric``; the draws of a patch come from a hash of its key and the epoch."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"] - pdf["y"].min(), pdf["x"] - pdf["x"].min()
        image = np.zeros((y.max() + 1, x.max() + 1, 3), np.uint8)
        image[y, x] = pdf[list(K.BANDS)]
        rng = np.random.default_rng(int(pdf["_seed"].iloc[0]) & (2**63 - 1))
        return pdf[[*key, "y", "x"]].assign(**dict(zip(K.BANDS, photometric(image, rng)[y, x].T.astype(np.int32), strict=True)))

    kinds = dict(px.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*key, "y", "x")) + ", r int, g int, b int"
    return px.select(*key, "y", "x", *K.BANDS, F.xxhash64(F.lit(epoch), *key).alias("_seed")).groupBy(*key).applyInPandas(run, schema)


def _blur(image: np.ndarray, size: int) -> np.ndarray:
    at = np.arange(size) - size // 2
    kernel = np.exp(-(at**2) / (2 * (0.3 * ((size - 1) * 0.5 - 1) + 0.8) ** 2))
    kernel /= kernel.sum()
    for axis in (0, 1):
        pad = [(0, 0)] * image.ndim
        pad[axis] = (size // 2, size // 2)
        view = np.lib.stride_tricks.sliding_window_view(np.pad(image, pad, mode="reflect" if image.shape[axis] > size else "edge"), size, axis=axis)
        image = view @ kernel.astype(np.float32)
    return image


def normalized(px: DataFrame) -> DataFrame:
    """``r, g, b`` as the network's inputs."""
    return px.withColumns({b: P.standardize(F.col(b), i) for i, b in enumerate(K.BANDS)})


def stack_months(px: DataFrame, key: tuple[str, ...], values: tuple[str, ...] = K.BANDS) -> DataFrame:
    """``key, image``: all values of a window in (month, band, y, x) order, months concatenated as channels.

    ``month_pos`` is the month's place in the window. A window is a few patches,
    so what one row gathers is bounded.
    """
    channels = F.array(*[F.struct(F.lit(i).alias("band"), F.col(v).cast("float").alias("v")) for i, v in enumerate(values)])
    flat = px.select(*key, "month_pos", "y", "x", F.explode(channels).alias("c"))
    cell = F.struct("month_pos", "c.band", "y", "x", "c.v")
    return flat.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["v"]).alias("image"))


def every_channel(values: Column, step: int, offset: int = 0) -> Column:
    """The strided selection ``values[offset::step]``."""
    return F.filter(values, lambda _, i: i % step == offset)
