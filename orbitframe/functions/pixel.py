"""Per-pixel expressions: all built-in Catalyst functions, integer wherever the data are bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orbitframe.functions import constants as K


def cloud(r: Column, g: Column, b: Column) -> Column:
    """Mean brightness above the threshold, as an exact integer test."""
    return (r + g + b) > 3 * K.CLOUD_BRIGHTNESS


def shadow(r: Column, g: Column, b: Column, clouds: Column) -> Column:
    """Dark, bluish (``b / mean > 1.1`` without the division) and not cloud."""
    total = r + g + b
    return (total < 3 * K.SHADOW_DARK) & (30 * b > 11 * total) & ~clouds


def vegetation(r: Column, g: Column) -> Column:
    """``(g - r) / (g + r) > 0.10`` without the division."""
    return 10 * (g - r) > (g + r)


def clip_byte(x: Column) -> Column:
    """To 0..255, then toward zero."""
    return F.greatest(F.least(x, F.lit(255.0)), F.lit(0.0)).cast("int")


def rescale(x: Column, mean: Column, std: Column, to_mean: Column, to_std: Column) -> Column:
    return (x - mean) / std * to_std + to_mean


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(t: float) -> float:
    """``sigmoid(x) > t`` is ``x > logit(t)``."""
    import math

    return math.log(t / (1 - t))


def standardize(x: Column, channel: int) -> Column:
    return (x / 255.0 - K.CHANNEL_MEAN[channel]) / K.CHANNEL_STD[channel]


def cosine_schedule(step: Column, warmup: int, total: int) -> Column:
    """Linear warm-up, then half a cosine down to zero."""
    progress = (step - warmup) / float(max(1, total - warmup))
    return F.when(step < warmup, (step + 1) / float(max(1, warmup))).otherwise(0.5 * (1 + F.cos(F.pi() * F.least(F.lit(1.0), progress))))


# --------------------------------------------------------------- colour


def _linear(c: Column) -> Column:
    v = c / 255.0
    return F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, 2.4)).otherwise(v / 12.92)


def _lab_f(t: Column) -> Column:
    return F.when(t > K.LAB_SPLIT, F.cbrt(t)).otherwise(K.LAB_SLOPE * t + K.LAB_SHIFT)


def rgb_to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    lin = [_linear(c) for c in (r, g, b)]
    fx, fy, fz = (_lab_f((m[0] * lin[0] + m[1] * lin[1] + m[2] * lin[2]) / w) for m, w in zip(K.RGB_TO_XYZ, K.WHITE, strict=True))
    return 116.0 * fy - 16.0, 500.0 * (fx - fy), 200.0 * (fy - fz)


def _lab_back(t: Column) -> Column:
    return F.when(t > 0.2068966, t * t * t).otherwise((t - K.LAB_SHIFT) / K.LAB_SLOPE)


def _inverse() -> list[list[float]]:
    import numpy as np

    return np.linalg.inv(np.array(K.RGB_TO_XYZ)).tolist()


def lab_to_rgb(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Back to 0..255, unrounded; out-of-gamut values are clipped."""
    fy = (lightness + 16.0) / 116.0
    fx, fz = fy + a / 500.0, F.greatest(fy - b / 200.0, F.lit(0.0))
    xyz = [_lab_back(f) * w for f, w in zip((fx, fy, fz), K.WHITE, strict=True)]
    out = []
    for row in _inverse():
        v = row[0] * xyz[0] + row[1] * xyz[1] + row[2] * xyz[2]
        v = F.when(v > 0.0031308, 1.055 * F.pow(F.greatest(v, F.lit(0.0)), 1.0 / 2.4) - 0.055).otherwise(12.92 * v)
        out.append(F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0)) * 255.0)
    return tuple(out)


# ---------------------------------------------------------------- names


def short_city(city: Column) -> Column:
    """The part before the first underscore, or the first twelve characters."""
    return F.when(F.instr(city, "_") > 0, F.substring_index(city, "_", 1)).otherwise(F.substring(city, 1, 12))


def month_name(file: Column) -> Column:
    """The first ``YYYY_MM`` of a file name, or null."""
    return F.nullif(F.regexp_extract(file, r"(\d{4}_\d{2})", 1), F.lit(""))


def patch_name(city: Column, month: Column, row: Column, col: Column) -> Column:
    return F.format_string("%s_m%02d_r%02d_c%02d.tif", city, month, row, col)


_PATCH = r"^(.+)_m(\d{2})_r(\d{2})_c(\d{2})(?:\.tif)?$"


def parse_patch(name: Column) -> Column:
    """``struct<city, month_idx, prow, pcol>``, or null where the name does not parse."""
    part = lambda i: F.regexp_extract(name, _PATCH, i)
    whole = F.struct(part(1).alias("city"), *(part(i).try_cast("int").alias(n) for i, n in ((2, "month_idx"), (3, "prow"), (4, "pcol"))))
    return F.when(name.rlike(_PATCH), whole)


def mask_name(name: Column, old: str = "_fbc.png", new: str = "_watershed.png") -> Column:
    return F.when(name.endswith(old), F.concat(F.substring(name, F.lit(1), F.length(name) - len(old)), F.lit(new))).otherwise(name)


def cache_key(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 10)


def clock(seconds: Column) -> Column:
    """``m:ss``."""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60), s % 60)


# --------------------------------------------------------------- affine

AFFINE = ("a", "b", "c", "d", "e", "f")


def affine(**parts: Column) -> Column:
    return F.struct(*[parts[n].cast("double").alias(n) for n in AFFINE])


def affine_move(t: Column, dcol: Column, drow: Column) -> Column:
    """The transform whose origin lies ``dcol, drow`` pixels further."""
    return affine(a=t["a"], b=t["b"], c=t["c"] + dcol * t["a"] + drow * t["b"], d=t["d"], e=t["e"], f=t["f"] + dcol * t["d"] + drow * t["e"])


def affine_resize(t: Column, width: Column, height: Column, to: int) -> Column:
    return affine(a=t["a"] * width / to, b=t["b"] * height / to, c=t["c"], d=t["d"] * width / to, e=t["e"] * height / to, f=t["f"])


def bounds(t: Column, width: Column, height: Column, digits: int = 2) -> Column:
    at = lambda x: F.bround(x, digits)
    return F.struct(
        at(t["c"]).alias("left"), at(t["c"] + width * t["a"]).alias("right"), at(t["f"]).alias("top"), at(t["f"] + height * t["e"]).alias("bottom")
    )
