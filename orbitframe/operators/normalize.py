"""Radiometric normalisation to the first month: z-score, invariant pixels, CIELab.

Bytes make every statistic an exact integer sum or a 256-bin histogram, so one
mergeable aggregate per (city, month, band) carries the whole scene. Month-0
statistics are a few rows; whole pixels of month 0 are met by an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitframe.functions import constants as K
from orbitframe.functions import pixel as P

CELL = ("city", "month_idx", "y", "x")


def long_bands(px: DataFrame, bands: tuple[str, ...] = K.BANDS) -> DataFrame:
    """One row per pixel and band: ``city, month_idx, y, x, usable, band, v``."""
    usable = ~F.coalesce("combined", F.lit(False)) if "combined" in px.columns else F.lit(True)
    pairs = F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).alias("v")) for b in bands])
    return px.select(*CELL, usable.alias("usable"), F.explode(pairs).alias("p")).select(*CELL, "usable", "p.band", "p.v")


def _moments(v: Column, usable: Column) -> list[Column]:
    x = F.when(usable, v.cast("long"))
    return [F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0)).alias("s1"), F.coalesce(F.sum(x * x), F.lit(0)).alias("s2")]


def band_stats(px: DataFrame, least: int = K.MIN_ZSCORE_VALUES) -> DataFrame:
    """``city, month_idx, band, n, mean, std`` of usable pixels; too few give 0 and 1."""
    sums = long_bands(px).groupBy("city", "month_idx", "band").agg(*_moments(F.col("v"), F.col("usable")))
    n = F.col("n").cast("double")
    variance = (F.col("n") * F.col("s2") - F.col("s1") * F.col("s1")).cast("double") / (n * n)
    some = F.col("n") >= least
    return sums.select(
        "city", "month_idx", "band", "n", F.when(some, F.col("s1") / n).otherwise(0.0).alias("mean"), F.when(some, F.sqrt(variance) + K.STD_EPSILON).otherwise(1.0).alias("std")
    )


def zscore_normalize(px: DataFrame, min_usable: int = K.MIN_USABLE_PIXELS) -> DataFrame:
    """Months moved to month 0's mean and spread; month 0 and scarcely usable months are copied."""
    stats = band_stats(px)
    wide = stats.groupBy("city", "month_idx").pivot("band", list(K.BANDS)).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("std").alias("std"))
    ref = wide.where("month_idx = 0").select("city", *[F.col(f"{b}_{s}").alias(f"ref_{b}_{s}") for b in K.BANDS for s in ("mean", "std")])
    joined = px.join(wide, ["city", "month_idx"]).join(ref, "city")
    copied = (F.col("month_idx") == 0) | (F.col("r_n") < min_usable)

    def moved(b: str) -> Column:
        out = P.clip_byte(P.rescale(F.col(b), F.col(f"{b}_mean"), F.col(f"{b}_std"), F.col(f"ref_{b}_mean"), F.col(f"ref_{b}_std")))
        return F.when(copied, F.col(b)).otherwise(out).alias(b)

    more = [c for c in px.columns if c not in (*CELL, *K.BANDS)]
    return joined.select(*CELL, *[moved(b) for b in K.BANDS], *more)


def reference_pairs(px: DataFrame) -> DataFrame:
    """Every later pixel with month 0's at its place: ``city, month_idx, y, x, band, ref, mov``, usable in both."""
    long = long_bands(px).where("usable")
    ref = long.where("month_idx = 0").select("city", "y", "x", "band", F.col("v").alias("ref"))
    return long.where("month_idx > 0").withColumnRenamed("v", "mov").join(ref, ["city", "y", "x", "band"]).select(*CELL, "band", "ref", "mov")


def difference_percentile(pairs: DataFrame, share: float = K.PIF_PERCENTILE) -> DataFrame:
    """Exact linear-interpolated percentile of ``|ref - mov|`` by scene and band, from a 256-bin histogram."""
    key = ["city", "month_idx", "band"]
    bins = pairs.groupBy(*key, F.abs(F.col("ref") - F.col("mov")).alias("d")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key)
    run = bins.withColumn("cum", F.sum("n").over(w.orderBy("d"))).withColumn("tot", F.sum("n").over(w))
    at = F.lit(share) * (F.col("tot") - 1)
    placed = run.withColumn("lo", F.floor(at)).withColumn("hi", F.least(F.floor(at) + 1, F.col("tot") - 1)).withColumn("frac", at - F.floor(at))
    low, high = F.min(F.when(F.col("cum") > F.col("lo"), F.col("d"))), F.min(F.when(F.col("cum") > F.col("hi"), F.col("d")))
    return placed.groupBy(*key).agg(F.first("tot").alias("n_pairs"), (low + F.first("frac") * (high - low)).alias("p30"))


def invariant_pixels(px: DataFrame, share: float = K.PIF_PERCENTILE) -> DataFrame:
    """Pairs of middling brightness whose difference is within the percentile."""
    pairs = reference_pairs(px)
    limit = difference_percentile(pairs, share)
    return pairs.join(limit, ["city", "month_idx", "band"]).where(
        (F.col("ref") + F.col("mov")).between(2 * K.PIF_LOW, 2 * K.PIF_HIGH) & (F.abs(F.col("ref") - F.col("mov")) <= F.col("p30"))
    )


def pif_regression(px: DataFrame, least: int = K.MIN_PIF_PIXELS) -> DataFrame:
    """``city, month_idx, band, n, slope, intercept``; identity where there are too few or constant pixels."""
    x, y = F.col("mov").cast("long"), F.col("ref").cast("long")
    sums = (
        invariant_pixels(px)
        .groupBy("city", "month_idx", "band")
        .agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    )
    flat = (F.col("n") < least) | (F.col("lo") == F.col("hi"))
    slope = F.try_divide((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).cast("double"), (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double"))
    fitted = sums.withColumn("slope", F.when(flat, 1.0).otherwise(slope))
    return fitted.select(
        "city", "month_idx", "band", "n", "slope", F.when(flat, 0.0).otherwise((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept")
    )


def pif_apply(px: DataFrame, fitted: DataFrame) -> DataFrame:
    """Bands moved along their lines; a band without a line, and month 0, stay."""
    wide = fitted.groupBy("city", "month_idx").pivot("band", list(K.BANDS)).agg(F.first("slope").alias("slope"), F.first("intercept").alias("intercept"))
    joined = px.join(wide, ["city", "month_idx"], "left")
    line = lambda b: P.clip_byte(F.coalesce(f"{b}_slope", F.lit(1.0)) * F.col(b) + F.coalesce(f"{b}_intercept", F.lit(0.0))).alias(b)
    return joined.select(*CELL, *[line(b) for b in K.BANDS], *[c for c in px.columns if c not in (*CELL, *K.BANDS)])


def prefer(first: DataFrame, second: DataFrame, key: tuple[str, ...] = CELL, values: tuple[str, ...] = K.BANDS) -> DataFrame:
    """The first input's pixels where it has them, else the second's."""
    other = second.select(*key, *[F.col(v).alias(f"_{v}") for v in values])
    return other.join(first.select(*key, *values), list(key), "left").select(*key, *[F.coalesce(v, f"_{v}").alias(v) for v in values])


LAB = ("l", "a_", "b_")


def to_lab(px: DataFrame) -> DataFrame:
    lab = P.rgb_to_lab(F.col("r"), F.col("g"), F.col("b"))
    return px.withColumns(dict(zip(LAB, lab, strict=True)))


def lab_stats(px: DataFrame, least: int = K.MIN_LAB_VALUES) -> DataFrame:
    """Mean and spread of each Lab channel over usable pixels, or over all where those are too few."""
    usable = ~F.col("combined")
    per = []
    for c in LAB:
        some = F.count(F.when(usable, F.col(c))) >= least
        x = F.when(usable, F.col(c))
        per += [
            F.when(some, F.avg(x)).otherwise(F.avg(c)).alias(f"{c}_mean"),
            (F.when(some, F.stddev_pop(x)).otherwise(F.stddev_pop(c)) + K.STD_EPSILON).alias(f"{c}_std"),
        ]
    return to_lab(px).groupBy("city", "month_idx").agg(*per)


def lab_match(px: DataFrame, least: int = K.MIN_LAB_VALUES) -> DataFrame:
    """Months moved to month 0's Lab statistics and back to bytes; month 0 is copied."""
    stats = lab_stats(px, least)
    ref = stats.where("month_idx = 0").select("city", *[F.col(f"{c}_{s}").alias(f"ref_{c}_{s}") for c in LAB for s in ("mean", "std")])
    joined = to_lab(px).join(stats, ["city", "month_idx"]).join(ref, "city")
    moved = [P.rescale(F.col(c), F.col(f"{c}_mean"), F.col(f"{c}_std"), F.col(f"ref_{c}_mean"), F.col(f"ref_{c}_std")) for c in LAB]
    back = P.lab_to_rgb(*moved)
    out = [F.when(F.col("month_idx") == 0, F.col(b)).otherwise(P.clip_byte(v)).alias(b) for b, v in zip(K.BANDS, back, strict=True)]
    return joined.select(*CELL, *out, *[m.alias(f"lab_{c}") for m, c in zip(moved, ("l", "a", "b"), strict=True)], *[c for c in px.columns if c not in (*CELL, *K.BANDS)])
